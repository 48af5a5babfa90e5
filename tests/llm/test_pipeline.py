"""The pipeline's stages against their operators, on the small tables."""

from __future__ import annotations

import itertools
from collections import Counter

import corpus_pipeline
from hiremill.llm import decontam, mixing, toxicity
from tests.llm.test_brute import reachable
from tests.llm.test_nearcopies import plain_shingles, similarity


def first_of_near_copies(rows):
    """The smallest id of each group, by the exact similarity of the five-word shingles of all pairs."""
    sets = {r["doc_id"]: plain_shingles(r["text"]) for r in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if similarity(sets[a], sets[b]) >= 0.8]
    return set(reachable(list(sets), links))


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "decontamination", "mix", "shards"]
    one, two, three, four, five = (stage for _, stage in corpus_pipeline.STAGES)

    clean = one(spark, docs, small).cache()
    kept = {r["doc_id"] for r in toxicity.score_documents(docs, labels).collect() if not r["predicted"]}
    assert {r["doc_id"] for r in clean.collect()} == kept

    single = two(spark, clean, small).cache()
    assert {r["doc_id"] for r in single.collect()} == first_of_near_copies(clean.collect())
    assert single.count() == single.select("doc_id").distinct().count()

    unleaked = three(spark, single, small).cache()
    leaks = {r["doc_id"] for r in decontam.find_leaks(single, benchmark).collect()}
    assert {r["doc_id"] for r in unleaked.collect()} == {r["doc_id"] for r in single.collect()} - leaks

    mixed = four(spark, unleaked, small).cache()
    copies = {r["doc_id"]: r["copies"] for r in mixing.allocate(unleaked).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})
    for stage in (clean, single, unleaked, mixed):
        assert stage.columns == docs.columns

    placed = five(spark, mixed, small)
    assert placed.columns == [*docs.columns, "shard", "slot"]
    assert Counter(r["doc_id"] for r in placed.collect()) == Counter(r["doc_id"] for r in mixed.collect())
