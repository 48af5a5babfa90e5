"""The library's data source, files and sources that fail, tables that change, and large inputs of set-wise operators."""

from __future__ import annotations

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from hiremill.operators import discovery, joins, profiles
from hiremill.session import work_folder
from hiremill.sources import files, keyed, landed
from hiremill.sources.registry import SourceRegistry


# ---------------------------------------------------------------- landed payloads
def land(folder, name, lines, end="\n"):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + end, encoding="utf-8")


def test_landed_files_are_partitions(spark, tmp_path):
    landed.register(spark)
    land(tmp_path, "b/2.txt", ["x", "", "é 😀"], end="")
    land(tmp_path, "a.txt", [str(i) for i in range(10_000)])
    land(tmp_path, "_hidden", ["no"])
    land(tmp_path, "c/.mark", ["no"])
    (tmp_path / "empty").write_text("")
    rows = spark.read.format("landed").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3
    found = {(r.file, r.position): r.payload for r in rows.collect()}
    assert len(found) == 10_003 and found["a.txt", 9_999] == "9999"
    assert [found["b/2.txt", i] for i in range(3)] == ["x", "", "é 😀"]
    none = spark.read.format("landed").load(str(tmp_path / "nothing"))
    assert none.count() == 0


def test_landed_stream_goes_on_behind_its_last_file(spark, tmp_path):
    landed.register(spark)
    source, target = tmp_path / "in", work_folder(spark, "landed")
    expected = []
    for number in range(3):
        land(source, f"{number:03d}.txt", [f"{number}-{i}" for i in range(4)])
        expected += [f"{number}-{i}" for i in range(4)]
        for _ in range(2):  # a run without new files adds nothing
            stream = spark.readStream.format("landed").load(str(source)).writeStream.format("parquet")
            stream.option("path", f"{target}/rows").option("checkpointLocation", f"{target}/checkpoint").trigger(
                availableNow=True
            ).start().awaitTermination()
            assert sorted(r.payload for r in spark.read.parquet(f"{target}/rows").collect()) == expected


# ---------------------------------------------------------------- what cannot be read
def test_a_corrupt_file_costs_its_own_rows(spark, tmp_path):
    for number in range(10):
        spark.range(5 * number, 5 * number + 5).coalesce(1).write.parquet(str(tmp_path / f"part={number}"))
    spark.range(0).coalesce(1).write.parquet(str(tmp_path / "part=10"))
    victim = next((tmp_path / "part=3").glob("*.parquet"))
    victim.write_bytes(b"no table")
    (tmp_path / "part=3" / f".{victim.name}.crc").unlink()
    (tmp_path / "part=11").mkdir()
    (tmp_path / "part=11" / "none.parquet").write_bytes(b"")
    rows, errors = files.read_files(spark, str(tmp_path), "id bigint")
    assert sorted(r.id for r in rows.collect()) == [i for i in range(50) if i // 5 != 3]
    told = {r.file.split("part=")[1].split("/")[0]: (r.error, r.records) for r in errors.collect()}
    assert set(told) == {"3"} and told["3"][1] == 0


def test_malformed_records_are_counted(spark, tmp_path):
    land(tmp_path, "a.json", ['{"id": 1}', "{", '{"id": "x"}', '{"id": 2}'])
    land(tmp_path, "b.json", ['{"id": 3}'])
    rows, errors = files.read_files(spark, str(tmp_path), "id bigint", "json")
    assert sorted(r.id for r in rows.collect()) == [1, 2, 3]
    assert [(r.file.rsplit("/", 1)[1], r.error, r.records) for r in errors.collect()] == [("a.json", files.MALFORMED, 2)]


def test_failing_sources_stop_nothing(spark, tmp_path):
    registry = SourceRegistry()
    registry.register("gone", lambda s, p: s.read.parquet(p))
    registry.register("late", lambda s, p: s.range(9).selectExpr("if(id = 7, raise_error('x'), id) AS k"))
    registry.register("good", lambda s, p: s.range(3).selectExpr("id AS k", "'t' AS title", "1 AS extra"))
    paths = {name: str(tmp_path / name) for name in registry.names}
    rows, errors = registry.collect(spark, paths, "k bigint, title string, url string")
    assert sorted(map(tuple, rows.collect())) == [(i, "t", None, 2, "good") for i in range(3)]
    assert {r.source: r.path for r in errors.collect()} == {n: paths[n] for n in ("gone", "late")}
    rows, errors = registry.collect(spark, {"gone": paths["gone"]}, "k bigint")
    assert rows.columns == ["k", "source_rank", "source"] and rows.count() == 0 and errors.count() == 1


# ---------------------------------------------------------------- tables that change
def test_a_change_rewrites_its_bucket(spark, tmp_path):
    path = str(tmp_path / "profiles")
    schema = "operator_user_id bigint, name string, created_version bigint, updated_version bigint"
    first = spark.range(200).selectExpr("id AS operator_user_id", "'old' AS name", "0L AS created_version", "0L AS updated_version")
    keyed.write_keyed(first, path, "operator_user_id", 8)

    def names():
        return {str(p.relative_to(path)) for p in (tmp_path / "profiles").rglob("*.parquet")}

    before = names()
    changes = spark.createDataFrame([(7, 1, "new"), (7, 2, "newer"), (999, 3, "added")], "operator_user_id bigint, version bigint, name string")
    merge = lambda rows, new: profiles.merge_profiles(rows, new, ["name"])
    touched = keyed.change_keyed(spark, path, schema, "operator_user_id", changes, merge, 8)
    assert 1 <= len(touched) <= 2
    assert {n for n in before if n not in names()} == {n for n in before if int(n.split("=")[1].split("/")[0]) in touched}
    table = {r.operator_user_id: (r.name, r.created_version, r.updated_version) for r in keyed.read_keyed(spark, path, schema).collect()}
    assert len(table) == 201 and table[7] == ("newer", 0, 2) and table[999] == ("added", 3, 3)
    assert sum(v == ("old", 0, 0) for v in table.values()) == 199
    # the same changes again leave the same rows
    keyed.change_keyed(spark, path, schema, "operator_user_id", changes, merge, 8)
    again = {r.operator_user_id: (r.name, r.created_version, r.updated_version) for r in keyed.read_keyed(spark, path, schema).collect()}
    assert again == table
    assert keyed.change_keyed(spark, path, schema, "operator_user_id", changes.limit(0), merge, 8) == []


# ---------------------------------------------------------------- the one-shot cap
def plain_one_shot(posts, seen, cap):
    published, out = set(), []
    for rank in sorted({p[0] for p in posts}):
        own = sorted(p for p in posts if p[0] == rank)
        for _, position, fingerprint in own[: cap - len(published)]:
            if fingerprint not in seen and fingerprint not in published:
                published.add(fingerprint)
                out.append((rank, position, fingerprint))
    return sorted(out)


@pytest.mark.parametrize("cap", [1, 7, 40, 400])
def test_one_shot_cap_over_many_sources(spark, cap):
    rng = random.Random(cap)
    posts = [(r, p, f"f{rng.randrange(300)}") for r in range(60) for p in range(rng.randrange(1, 25))]
    seen = {f"f{i}" for i in range(0, 300, 4)}
    table = spark.createDataFrame(posts, "source_rank int, position int, fingerprint string")
    ledger = spark.createDataFrame([(f,) for f in seen], "fingerprint string")
    found = discovery.cap_then_dedupe(table, ledger, cap)
    assert sorted(map(tuple, found.collect())) == plain_one_shot(posts, seen, cap)


def test_one_shot_cap_over_ten_thousand_sources(spark):
    posts = spark.range(30_000).selectExpr(
        "CAST(id % 10000 AS INT) AS source_rank", "CAST(id div 10000 AS INT) AS position", "CAST(id % 17000 AS STRING) AS fingerprint"
    )
    ledger = spark.range(100).selectExpr("CAST(id AS STRING) AS fingerprint")
    found = discovery.cap_then_dedupe(posts, ledger, 5000)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        found.explain()
    assert "Pandas" not in out.getvalue() and "Python" not in out.getvalue()
    rows = [tuple(r) for r in posts.collect()]
    assert sorted(map(tuple, found.collect())) == plain_one_shot(rows, {str(i) for i in range(100)}, 5000)


# ---------------------------------------------------------------- term search
def test_terms_of_every_length(spark):
    rng = random.Random(8)
    letters = "abcé😀 1"
    texts = [(i, "".join(rng.choices(letters, k=rng.randrange(0, 40)))) for i in range(120)] + [(120, None), (121, "ABC" * 2000)]
    words = {"".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(150)} | {"abcabcabcabcabc", "AbC", "", "é"}
    found = joins.term_match(
        spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame([(w,) for w in words], "term string"), key="k"
    )
    expected = {(k, w) for k, t in texts for w in words if t and w and w.lower() in t.lower()}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    nothing = spark.createDataFrame([], "term string")
    assert joins.term_match(spark.createDataFrame(texts, "k int, text string"), nothing, key="k").count() == 0


def test_few_sequences_leave_the_scan(spark):
    texts = spark.range(300).selectExpr("id AS k", "concat(repeat('lorem ipsum dolor ', 20), id, ' kubernetes') AS text")
    terms = spark.createDataFrame([("kubernetes",), ("terraform",), ("zig",)], "term string")
    known = joins._gram_filter(terms.selectExpr("'ube' AS _gram").unionByName(terms.selectExpr("term AS _gram").where("term = 'zig'")))
    grams = joins._filtered(joins._sequences(F.col("text"), 3), known[3])
    assert texts.select(F.explode(F.array_distinct(grams)).alias("g")).groupBy("g").count().collect()[0]["g"] == "ube"
    assert joins.term_match(texts, terms, key="k").count() == 300
