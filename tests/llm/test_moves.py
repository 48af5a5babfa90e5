"""Whole texts stay where they are: what the pipeline's stages store and shuffle."""

from __future__ import annotations

from hiremill.llm import common, kdtree, mixing, simhash
from tests.llm.data import SCHEMA, documents
from tests.test_plans import plan_of


def test_sifted_rows_hold_every_key(spark):
    rows = spark.range(5000).selectExpr("id", "xxhash64(id) h", "'t' filter_word_")
    keys = rows.where("id % 500 = 7").select("h")
    near, far = common.sifted(rows, keys, "h")
    found = {r["id"] for r in near.collect()}
    assert found >= {7 + 500 * i for i in range(10)} and len(found) < 20
    assert {r["id"] for r in far.collect()} == set(range(5000)) - found
    assert near.columns == far.columns == rows.columns


def test_slots_move_no_text(spark):
    placed = kdtree.with_shard(documents(spark, 300))
    assert "hashpartitioning" not in plan_of(placed)


def test_mix_stores_texts_of_ties_only(spark, monkeypatch):
    wide = {}
    kept = common.stored

    def stored(df, label):
        out = kept(df, label)
        if {"row_", "text"} & set(df.columns):
            wide[label] = out.count()
        return out

    monkeypatch.setattr(mixing, "stored", stored)
    docs = documents(spark, 300)
    assert mixing.mix(docs).count() > 300
    assert set(wide) <= {"mix-ties"} and sum(wide.values()) <= 12


def test_kept_rows_are_not_joined(spark, monkeypatch):
    moved = []
    kept = common.sifted

    def sifted(*args):
        near, far = kept(*args)
        moved.append(near.count())
        return near, far

    monkeypatch.setattr(simhash, "sifted", sifted)
    texts = [" ".join(f"w{i * 50 + j}" for j in range(50)) for i in range(200)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([*texts, *texts[:5], texts[9]])] + [(9, texts[9], "en", "s", 1)]
    found = sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == list(range(200))
    assert len(moved) == 1 and moved[0] <= 12
