"""Conversation repair against all edit sequences and a plain program over whole conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from hiremill.llm import repair
from tests.llm.data import clashing, rows_of

GRAMMAR = re.compile(r"(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        if not bare:
            out.append("b")
        elif (role, text) in seen:
            out.append("d")
        else:
            out.append("t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def all_repairs(rows, faults, most):
    """Every edit sequence of at most `most` cost: (cost, audit, repaired)."""
    todo = [(0, "", 0, ())]
    while todo:
        cost, audit, at, out = todo.pop()
        if cost > most:
            continue
        if at == len(rows) and GRAMMAR.fullmatch("".join(r[:1] for r, _ in out)):
            yield cost, audit, out
        for role in ("user", "assistant"):
            todo.append((cost + 2, audit + "I", at, (*out, (role, ""))))
        if at < len(rows):
            _, _, role, text = rows[at]
            todo.append((cost + 3, audit + "D", at + 1, out))
            if faults[at] in "t-":
                more = int(faults[at] == "t")
                todo.append((cost + more, audit + "K", at + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    todo.append((cost + 2 + more, audit + "R", at + 1, (*out, (new, text))))


def plain_best(rows, faults):
    """The same by a table over (rows read, state), from the last row to the first; weights compare whole."""
    inf = (10**9, "")
    n = len(rows)
    best = [[inf] * 4 for _ in range(n + 1)]
    for at in range(n, -1, -1):
        for _ in range(5):  # insertions follow each other inside a column
            for state in range(4):
                found = [(0, "")] if at == n and state in (0, 3) else []
                for role, to in repair.MOVES[state].items():
                    if role != "s":
                        cost, audit = best[at][to]
                        found.append((cost + 2, "I" + audit))
                if at < n:
                    cost, audit = best[at + 1][state]
                    found.append((cost + 3, "D" + audit))
                    if faults[at] in "t-":
                        more = int(faults[at] == "t")
                        for role, to in repair.MOVES[state].items():
                            cost, audit = best[at + 1][to]
                            if rows[at][2][:1] == role:
                                found.append((cost + more, "K" + audit))
                            if role != "s":
                                found.append((cost + 2 + more, "R" + audit))
                best[at][state] = min([best[at][state], *found])
    return best[0][0]


def written(rows, audit):
    """The repaired rows of an audit: the one role string it can stand for."""
    letters = [e for e in audit if e != "D"]
    kept = iter([r for r, e in zip(rows, [e for e in audit if e != "I"], strict=True) if e != "D"])
    out = []
    for edit in letters:
        system = bool(out) and out[0][0][:1] == "s"
        turn = "user" if (len(out) - system) % 2 == 0 else "assistant"
        if edit == "I":
            out.append((turn, ""))
        else:
            _, _, role, text = next(kept)
            out.append((role if edit == "K" else turn, text))
    return out


def plain_report(rows):
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of damaged rows of one conversation."""
    faults = faults_of(rows)
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, audit = plain_best(rows, faults)
    text = "\n".join(f"{r}:{t}" for r, t in written(rows, audit))
    counts = [faults.count(f) for f in "bdt"]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def plain_table(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    groups = {conv: [] for conv, *_ in rows}
    for row in plain_damage(rows):
        groups[row[0]].append(row)
    return sorted(((conv, *plain_report(sorted(own, key=order))) for conv, own in groups.items()), key=repr)


def report_rows(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def random_rows(rng, n, conv=0):
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why?", "Yes."]
    return [
        (conv, i if rng.random() > 0.1 else None, rng.choice(["user", "assistant", "system", "user", "assistant", "tool"]), rng.choice(texts) + (str(i) if rng.random() < 0.4 else ""))
        for i in range(n)
    ]


def test_agenda_finds_the_least_of_all_edits():
    rng = random.Random(13)
    for _ in range(150):
        rows = random_rows(rng, rng.randint(0, 5))
        faults = faults_of(rows)
        items = [r[2][:1] + f for r, f in zip(rows, faults, strict=True)]
        cost, audit = min(repair.lightest(items, repair.START, repair.GOALS).values())
        every = min(all_repairs(rows, faults, cost))
        assert (cost, audit) == every[:2]
        assert list(every[2]) == written(rows, audit)


def test_chunks_compose():
    rng = random.Random(14)
    for _ in range(100):
        rows = random_rows(rng, rng.randint(1, 30))
        faults = faults_of(rows)
        items = [r[2][:1] + f for r, f in zip(rows, faults, strict=True)]
        whole = plain_best(rows, faults)
        assert min(repair.lightest(items, repair.START, repair.GOALS).values()) == whole
        cuts = sorted(rng.sample(range(1, len(items)), min(3, len(items) - 1))) if len(items) > 1 else []
        parts = [items[a:b] for a, b in itertools.pairwise([0, *cuts, len(items)])]
        sofar = {repair.START: (0, "")}
        for number, part in enumerate(parts):
            sofar = repair.followed(sofar, repair.chunk_weights(tuple(part), number == 0, number == len(parts) - 1))
        assert min(sofar.values()) == whole


@pytest.mark.parametrize("chunk", [3, 512])
def test_report_by_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rng = random.Random(15)
    rows = [row for conv in range(40) for row in random_rows(rng, rng.randint(1, 12), conv)]
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (77, None, None, "x"), (78, 1, "assistant", None), (79, 5, "", "?")]
    rows += [(80, i // 2, "user" if i % 2 else "assistant", "Again." if i % 3 else f"Line {i}.") for i in range(1500)]
    rows += [rows[0], rows[0], (81, 10**12, "user", "Far."), (81, 1, "user", "long " * 50_000)]
    table = spark.createDataFrame(rows, SCHEMA)
    expected = plain_table(rows)
    assert report_rows(repair.repair_conversations(table)) == expected
    assert report_rows(repair.repair_conversations(clashing(table))) == expected


def test_given_table(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert report_rows(repair.repair_conversations(table)) == plain_table(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "B?"), (1, 2, "user", "B?"), (2, 0, None, None), (3, 0, "user", "Q?"), (3, 1, "assistant", "R.")]
    table = spark.createDataFrame(rows, SCHEMA)
    found = [tuple(r) for r in repair.repaired(table).orderBy("conv_id", "place").collect()]
    assert [r for r in found if r[0] == 1] == [
        (1, 0, "user", "", "insert"), (1, 1, "assistant", "A.", "keep"), (1, 2, "user", "B?", "keep"), (1, 3, "assistant", "", "insert")
    ]
    for conv in (1, 3):
        assert GRAMMAR.fullmatch("".join(r[2][0] for r in found if r[0] == conv))
    assert [r for r in found if r[0] == 3] == [(3, 0, "user", "Q?", "keep"), (3, 1, "assistant", "R.", "keep")]
    assert not [r for r in found if r[0] == 2]
    assert repair.repaired(table.limit(0)).count() == 0


def test_empty_table(spark):
    assert repair.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert rows_of(repair.repair_conversations(spark.createDataFrame([], SCHEMA))) == []
