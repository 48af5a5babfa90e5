"""Licence scans: the rules, their gates, and the resolution of overlaps."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hiremill.llm import licenses
from hiremill.llm.licenserules import BASE, KINDS, Rule, all_rules, spaced
from tests.llm.data import clashing, documents, rows_of

WORD = re.compile(r"[0-9a-z\x80-\U0010FFFF]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(UPPER))


def plain_scan(text, rules):
    """The detections of one text by loops over words, rules and pairs of matches."""
    words = plain_words(text)
    spelled = " " + "  ".join(words) + " "
    found = []
    for rule in rules:
        for m in re.finditer(rule.pattern, spelled):
            start = spelled[: m.start()].count(" ") // 2
            found.append((start, start + m[0].count(" ") // 2, rule))
    outer = [
        a for a in found
        if not any(
            b is not a and b[0] <= a[0] and a[1] <= b[1] and ((b[0], b[1]) != (a[0], a[1]) or b[2].number < a[2].number) for b in found
        )
    ]
    first = {}
    for start, end, rule in outer:
        for word in range(start, end):
            first[word] = min(first.get(word, (rule.number, start)), (rule.number, start))
    kept = [a for a in outer if all(first[w] == (a[2].number, a[0]) for w in range(a[0], a[1]))]
    return words, [a for a in found if a[2].kind == "base"] + [a for a in kept if a[2].kind != "base"]


def plain_row(doc_id, text, rules):
    words, kept = plain_scan(text, rules)
    base = [a for a in kept if a[2].kind == "base"]
    starts = [a[0] for a in base]
    return (
        doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({a[2].label for a in base})), ",".join(sorted({a[2].label for a in kept})),
        max((a[2].confidence for a in kept), default=0.0),
    )


def test_there_are_hundreds_of_rules():
    rules = all_rules()
    assert len(rules) > 400
    assert [r.number for r in rules] == list(range(len(rules)))
    assert [list(KINDS).index(r.kind) for r in rules] == sorted(list(KINDS).index(r.kind) for r in rules)
    assert {r.label for r in rules if r.kind == "base"} == set(BASE.values())


def gate_losses(rule):
    """Generated matches of a rule that its own gates keep from it."""
    lost = []

    @settings(max_examples=8, database=None, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(rule.pattern.replace("[^ ]", "[0-9a-z]"), re.ASCII), fullmatch=True))
    def run(match):
        words = set(match.split())
        if not all(words & set(gate) for gate in rule.gates):
            lost.append((rule.label, rule.kind, match))

    run()
    return lost


def test_gates_let_every_match_through():
    assert [lost for rule in all_rules() for lost in gate_losses(rule)] == []


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Released under the MIT License.", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"),
        ("see https://www.mozilla.org/MPL/2.0/", "mpl-2"),
        ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"),
        ("GNU Affero General Public License v3 and the Boost Software License 1.0", "agpl-3,boost"),
        ("free and unencumbered: This is free and unencumbered software released into the public domain", "unlicense"),
        ("a licence to kill, mit freundlichen Grüßen", ""),
    ],
)
def test_known_texts(spark, text, labels):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == labels
    assert (row["score"] > 0) == bool(labels)


def test_scan_by_brute_force(spark):
    rules = [
        Rule(0, "base", "base", 1.0, [["b"]], spaced("a b")),
        Rule(1, "long", "notice", 0.9, [["b", "c"]], spaced("(?:b c|c) d")),
        Rule(2, "short", "name", 0.6, [["d"]], spaced("d")),
        Rule(3, "pair", "name", 0.5, [["c"], ["a"]], spaced("c a")),
        Rule(4, "gap", "name", 0.4, [["e"]], spaced("e (?:[a-e] ){0,2}?e")),
    ]
    import random

    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    texts += [None, "", "A-B!c, D.", "aKb ab", "é a b", "a b a b", "x" * 50_000 + " a b", "a b " * 3000]
    rows = list(enumerate(texts))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), rules)
    assert rows_of(found) == sorted((plain_row(i, t, rules) for i, t in rows), key=repr)


def test_whole_rules_by_brute_force(spark):
    docs = documents(spark, 30)
    extra = [
        (2000, "Under the MIT License. under the mit license; Apache License, Version 2; cc-by-nc", None, None, 1),
        (2001, "Copyright (c) 2020 X. All rights reserved. Dual licensed under the terms of the GNU GPL v2 and the MIT license", None, None, 1),
    ]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    expected = [plain_row(r["doc_id"], r["text"], all_rules()) for r in docs.collect()]
    assert rows_of(licenses.scan(docs)) == sorted(expected, key=repr)
    assert rows_of(licenses.scan(clashing(docs))) == sorted(expected, key=repr)


def test_detections_keep_columns(spark):
    docs = clashing(documents(spark, 4, extra=False))
    marked = docs.withColumn("text", docs["text"]).unionByName(
        docs.limit(1).selectExpr(*[f"'under the MIT License' AS {c}" if c == "text" else c for c in docs.columns])
    )
    found = licenses.detections(marked, keep=["doc_id", "source"])
    row = found.collect()
    assert {(r["label"], r["kind"], r["first_word"], r["words"]) for r in row} >= {("mit", "base", 0, 4)}
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.detections(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(documents(spark, 5))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
