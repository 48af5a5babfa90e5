"""Fill-in-middle: piece tables against plain strings, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from hiremill.llm import fim
from tests.llm.data import clashing, documents, rows_of


def plain(text, doc_id):
    """(n, form, prefix, middle, output) by slicing and joining."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(lines)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:low], lines[low:high], lines[high:]))
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_texts():
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab\n<>PSM😀é") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    return texts + [None, "", "\n", "\n\n\n", "x", "a<P>b", "<S", "<", "S>\n<M", "é" * 70_000 + "\n" + "b" * 1_500_000, "\r\n\r"]


def test_digests_by_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "a\nb"), (-5, "a\nb"), (3, "same\n"), (3, "same\n")]
    expected = []
    for doc_id, text in rows:
        n, form, p, m, output = plain(text, doc_id)
        expected.append((doc_id, n, form, p, m, sha(output), sha(text or "")))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(fim.transform_digests(table)) == sorted(expected, key=repr)
    assert rows_of(fim.transform_digests(clashing(table))) == sorted(expected, key=repr)
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}


def test_operator_round_trip(spark):
    docs = documents(spark)
    made = fim.with_fim(clashing(docs))
    assert made.columns == [*clashing(docs).columns, "fim"]
    back = fim.with_restored(made.select("doc_id", "text", "fim.*"))
    assert back.where(F.col("restored") != F.coalesce("text", F.lit(""))).count() == 0
    for row in back.collect():
        assert (row["lines"], row["form"], row["output"]) == tuple(plain(row["text"], row["doc_id"])[i] for i in (0, 1, 4))
        spelled = "".join(
            (row["text"] or "", fim.SENTINELS)[p["buffer"]][p["start"] : p["start"] + p["length"]] for p in row["pieces"]
        )
        assert spelled == row["output"]


def test_cutting_keeps_the_contents():
    rng = random.Random(3)
    for _ in range(200):
        table = fim.PieceTable.of("".join(rng.choice("abc") for _ in range(rng.randint(0, 20))))
        places = sorted(rng.randint(0, len(table.text)) for _ in range(rng.randint(0, 4)))
        cut = table.cut(places)
        assert cut.content() == table.text and len(cut.pieces) == len(places) + 1
        assert cut.digest() == sha(table.text)


def test_rates(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc") for i in range(400)], "doc_id long, text string")
    forms = {r["form"]: r["count"] for r in fim.with_fim(docs, rate=50, spm_rate=100).groupBy("fim.form").count().collect()}
    assert set(forms) == {"plain", "spm"} and 150 < forms["plain"] < 250
    assert fim.with_fim(docs.limit(0)).count() == 0 and fim.transform_digests(docs.limit(0)).count() == 0
