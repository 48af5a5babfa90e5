"""Decontamination: items cut off at the end of a document, and recall of edited items by size."""

from __future__ import annotations

import random

import pytest

from hiremill.llm import decontam


def words(rng: random.Random, n: int) -> list[str]:
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_an_item_without_its_tail_ends_a_document():
    rng = random.Random(21)
    item = words(rng, 120)
    index = decontam.build_index([(1, " ".join(item))])
    cut = " ".join(words(rng, 30) + item[:-22])
    other = " ".join(words(rng, 60))
    assert [[hit[0] for hit in found] for found in index.search([cut, other, cut, other])] == [[0], [], [0], []]
    head = " ".join(item[22:] + words(rng, 30))
    assert [len(found) for found in index.search([other, head, other, head])] == [0, 1, 0, 1]


def edited(rng: random.Random, item: list[str], edits: int, evenly: bool) -> list[str]:
    out = list(item)
    places = [int((i + 0.5) * len(item) / edits) for i in range(edits)] if evenly else rng.sample(range(len(item)), edits)
    for at in sorted(places, reverse=True):
        out[at : at + 1] = rng.choice(([], ["changed"], [out[at], "added"]))
    return out


@pytest.mark.parametrize("size", [5, 6, 8, 10, 12, 15, 16, 20, 25, 30, 39, 60, 100])
@pytest.mark.parametrize("evenly", [False, True])
def test_recall_of_edited_items(size, evenly):
    """Items with exactly the allowed edits only, none left as they are."""
    rng = random.Random(size)
    items = [words(rng, size) for _ in range(200)]
    index = decontam.build_index([(i, " ".join(item)) for i, item in enumerate(items)])
    texts = [" ".join([*words(rng, 20), *edited(rng, item, size // 5, evenly), *words(rng, 20)]) for item in items]
    found = sum(any(hit[0] == i for hit in hits) for i, hits in enumerate(index.search(texts)))
    print(size, evenly, found / len(items))
    assert found >= decontam.RECALL * len(items)


def test_blocks_leave_out_copies(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 5)
    sizes = []
    build = decontam.build_index
    monkeypatch.setattr(decontam, "build_index", lambda items: sizes.append(len(items)) or build(items))
    rows = [(1, "a repeated item")] * 50 + [(i, f"item number {i}") for i in range(2, 6)]
    list(decontam.item_blocks(spark.createDataFrame(rows, "item_id long, text string")))
    assert sizes == [5]
