"""Streams over several batches against their batch twins, and batches run again after a failure."""

from __future__ import annotations

import random
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hiremill import terms
from hiremill.operators import applications
from hiremill.operators.dedupe import with_fingerprint
from hiremill.session import work_folder
from hiremill.streaming import applications as application_stream
from hiremill.sources import runs
from hiremill.streaming import application_state, publish
from hiremill.streaming.localize import stream_localized

NOW = datetime(2026, 7, 20, tzinfo=UTC)
POSTS = (
    "position int, source_rank int, title string, description string, source string, url string, company string, "
    "location string, published_at timestamp"
)


def post(position, *, url=None, title="Backend Developer", age_hours=1, rank=0):
    published = None if age_hours is None else NOW - timedelta(hours=age_hours)
    return (position, rank, title, f"text {position}", "s", url or f"https://a.b/{position}", None, None, published)


def drop_files(spark, batches, schema, folder):
    """One file per batch, later batches with later file times."""
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema).coalesce(1)
        frame.write.mode("append").parquet(folder)
        assert number >= 0


def stream_of(spark, folder, schema):
    return application_stream.read_update_feed(spark, folder, schema, files_per_batch=1)


def run_publish(spark, source, target, **options):
    settings = {"max_age_hours": 48, "max_posts": 0, "clock": lambda: NOW, "interval_seconds": None, **options}
    publish.stream_publish(stream_of(spark, source, POSTS), target, **settings).awaitTermination()


def positions(df):
    return sorted(r.position for r in df.collect())


def test_publishing_dedupes_across_batches(spark):
    source, target = work_folder(spark, "in"), work_folder(spark, "out")
    batches = [
        [post(1), post(2, title="Product Manager"), post(3, url="https://a.b/1"), post(4, age_hours=48)],
        [post(5, url="https://A.B/1"), post(6, age_hours=49), post(7, age_hours=None), post(8)],
    ]
    drop_files(spark, batches, POSTS, source)
    run_publish(spark, source, target)
    assert positions(publish.read_cards(spark, target)) == [1, 4, 7, 8]
    assert publish.read_published(spark, target).select("fingerprint").distinct().count() == 4
    # nothing new: a second run publishes nothing
    run_publish(spark, source, target)
    assert publish.read_cards(spark, target).count() == 4


def test_posts_beyond_the_cap_come_back(spark):
    source, target = work_folder(spark, "in"), work_folder(spark, "out")
    drop_files(spark, [[post(i) for i in range(1, 6)], [post(9, rank=1)], [post(10, rank=1)]], POSTS, source)
    run_publish(spark, source, target, max_posts=2)
    cards = publish.read_cards(spark, target)
    by_batch = {b: positions(cards.filter(F.col("batch") == b)) for b in range(3)}
    assert by_batch == {0: [1, 2], 1: [3, 4], 2: [5, 9]}
    assert positions(publish.read_pending(spark, target, 2)) == [10]


def test_waiting_posts_grow_stale(spark):
    source, target = work_folder(spark, "in"), work_folder(spark, "out")
    clock = iter([NOW, NOW + timedelta(hours=60)])
    drop_files(spark, [[post(1), post(2)], [post(3, age_hours=-30)]], POSTS, source)
    run_publish(spark, source, target, max_posts=1, clock=lambda: next(clock))
    assert positions(publish.read_cards(spark, target)) == [1, 3]
    assert publish.read_pending(spark, target, 1).count() == 0


def test_a_repeated_batch_gives_the_same_result(spark):
    target = work_folder(spark, "out")
    first = spark.createDataFrame([post(i) for i in range(1, 5)], POSTS)
    second = spark.createDataFrame([post(2), post(7)], POSTS)
    options = {"now": NOW, "max_age_hours": 48, "max_posts": 3, "order": ("source_rank", "position")}
    publish.publish_batch(first, 0, target, **options)
    publish.publish_batch(second, 1, target, **options)
    before = positions(publish.read_cards(spark, target))
    publish.publish_batch(second, 1, target, **options)
    assert positions(publish.read_cards(spark, target)) == before == [1, 2, 3, 4, 7]


def test_interval_zero_disables(spark):
    source = work_folder(spark, "in")
    drop_files(spark, [[post(1)]], POSTS, source)
    stream = stream_of(spark, source, POSTS)
    assert publish.stream_publish(stream, source, max_age_hours=1, max_posts=1, interval_seconds=0) is None


def test_permanent_dedupe(spark):
    source, target = work_folder(spark, "in"), work_folder(spark, "out")
    drop_files(spark, [[post(1), post(2)], [post(3, url="https://a.b/1")], [post(4), post(2)]], POSTS, source)
    publish.stream_dedupe(stream_of(spark, source, POSTS), target, ["position"]).awaitTermination()
    rows = publish.read_published(spark, target)
    assert rows.count() == rows.select("fingerprint").distinct().count() == 3


def test_cards_are_written_with_the_ledger(spark):
    source, target = work_folder(spark, "in"), work_folder(spark, "out")
    drop_files(spark, [[post(1), post(2)], [post(2), post(3, title="Anything")]], POSTS, source)
    publish.stream_cards(stream_of(spark, source, POSTS), target, ["position"]).awaitTermination()
    cards = publish.read_cards(spark, target)
    assert positions(cards) == [1, 2, 3]
    assert all(r.card.startswith("💼 <b>") for r in cards.collect())
    assert {r.fingerprint for r in cards.collect()} == {r.fingerprint for r in publish.read_published(spark, target).collect()}


UPDATES = "update_id bigint, operator_user_id bigint, kind string, vacancy_id string, upload_reason string, outcome string"


@pytest.mark.parametrize("seed", [1, 2])
def test_application_stream_equals_batch(spark, seed):
    rng = random.Random(seed)
    posts = with_fingerprint(spark.createDataFrame([post(i) for i in range(6)], POSTS))
    ledger = posts.select("fingerprint", "title", "source", "url")
    ids = [r.fingerprint for r in ledger.collect()]
    outcomes = ["submitted", "loading", "submitting", "failed", "queued", "manual_required", "queued", "loading"]
    rows = []
    for i in range(240):
        kind = rng.choice(["apply"] * 6 + ["resume", "other"])
        reason = "bad_name" if kind == "resume" and i < 40 else None
        rows.append((i, rng.randrange(3), kind, rng.choice([*ids, ids[0], "nope"]), reason, rng.choice(outcomes)))
    source, target = work_folder(spark, "in"), work_folder(spark, "out")
    drop_files(spark, [rows[a : a + 60] for a in range(0, 240, 60)], UPDATES, source)
    feed = stream_of(spark, source, UPDATES)
    application_stream.stream_applications(feed, lambda: ledger, target, operators=[0, 1]).awaitTermination()
    columns = ["update_id", "decision", "processed", "status_after"]
    streamed = application_stream.read_decisions(spark, target).select(columns)
    batch = applications.decide_updates(spark.createDataFrame(rows, UPDATES), ledger, operators=[0, 1])
    expected = sorted(tuple(r) for r in batch.select(columns).collect())
    assert sorted(tuple(r) for r in streamed.collect()) == expected
    statuses = application_stream.latest_statuses(spark, target).collect()
    final = applications.final_statuses(batch).collect()
    assert {tuple(r) for r in statuses} == {tuple(r) for r in final}
    assert {r.status for r in final} <= set(terms.APPLICATION_STATUSES)
    tally = applications.queue_tally(batch).collect()[0]
    assert tally.updates_seen == 240 and tally.resumes_updated > 0 and tally.manual_required > 0


def test_bounded_dedupe(spark):
    source, target = work_folder(spark, "in"), work_folder(spark, "out")
    schema = "fingerprint string, ts timestamp"
    start = datetime(2026, 7, 1)
    batches = [
        [("a", start), ("b", start)],
        [("a", start + timedelta(hours=3)), ("c", start + timedelta(hours=3))],
        [("a", start + timedelta(hours=4))],
    ]
    drop_files(spark, batches, schema, source)
    kept = publish.dedupe_within(stream_of(spark, source, schema), "ts", "30 hours")
    kept.writeStream.format("parquet").option("path", f"{target}/rows").option(
        "checkpointLocation", f"{target}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.fingerprint for r in spark.read.parquet(f"{target}/rows").collect()) == ["a", "b", "c"]


def test_capped_posts_are_published_without_new_input(spark):
    source, target = work_folder(spark, "in"), work_folder(spark, "out")
    drop_files(spark, [[post(i) for i in range(1, 6)]], POSTS, source)
    run_publish(spark, source, target, max_posts=2)
    published = [publish.read_published(spark, target).count()]
    settings = {"now": NOW, "max_age_hours": 48, "max_posts": 2}
    while publish.publish_pending(spark, target, **settings):
        published.append(publish.read_published(spark, target).count())
    assert published == [2, 4, 5]
    # a later run of the stream knows what those polls published
    drop_files(spark, [[post(4), post(9)]], POSTS, source)
    run_publish(spark, source, target, max_posts=2)
    assert positions(publish.read_cards(spark, target)) == [1, 2, 3, 4, 5, 9]


@pytest.mark.parametrize("name", ["stream_dedupe", "stream_update_feed", "stream_late_data"])
def test_streams_read_a_table_in_a_folder(spark, small, tmp_path, name):
    import os

    from hiremill.catalog import QUERIES

    for table in ("orders", "events", "customer", "nation"):
        rows = spark.read.parquet(f"{small}/{table}.parquet")
        rows.repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert os.path.isdir(tmp_path / "orders.parquet")
    one = {tuple(r) for r in QUERIES[name](spark, small).collect()}
    assert {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()} == one and one


# ---------------------------------------------------------------- localization in the flow
ACCENTS = {"script": "À-ÿ", "letters": "A-Za-zÀ-ÿ", "min_ratio": 0.05}
SEEN = POSTS + ", seen_at timestamp"
OFFERS = "position int, model_rank int, text string, offered_at timestamp"


def minute(n):
    return NOW.replace(tzinfo=None) + timedelta(minutes=n)


def seen(position, at, **options):
    return (*post(position, **options), minute(at))


TICK = (None, 0, None, None, None, None, None, None, None, minute(10_000))


def localized(spark, posts, offers, **options):
    return stream_localized(
        stream_of(spark, posts, SEEN), stream_of(spark, offers, OFFERS), "position", wait="15 minutes", **ACCENTS, **options
    )


def drain(stream, target):
    run = stream.writeStream.format("parquet").option("path", f"{target}/rows")
    run.option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def test_posts_wait_for_their_texts(spark):
    posts, offers, target = (work_folder(spark, n) for n in ("in", "texts", "out"))
    drop_files(spark, [[seen(1, 0), seen(2, 1)], [seen(3, 10), seen(4, 10)]], SEEN, posts)
    early = [[(1, 2, "Éà ô deux ïé", minute(2)), (1, 1, "", minute(1))], [(3, 1, "still plain", minute(12)), (3, 4, "ÉÀÉ trois", minute(20))]]
    drop_files(spark, early, OFFERS, offers)
    drain(localized(spark, posts, offers), target)
    first = {r.position for r in spark.read.parquet(f"{target}/rows").collect()}
    # a restart goes on with what waits in the state
    drop_files(spark, [[seen(5, 100)], [TICK]], SEEN, posts)
    drop_files(spark, [[(2, 1, "ÉÀÉ too late", minute(60)), (5, 1, "ÉÀÉ cinq", minute(101))], [(None, None, None, minute(10_000))]], OFFERS, offers)
    drain(localized(spark, posts, offers), target)
    found = {r.position: r.localized for r in spark.read.parquet(f"{target}/rows").collect()}
    assert found == {1: "Éà ô deux ïé", 2: None, 3: "ÉÀÉ trois", 4: None, 5: "ÉÀÉ cinq"}
    assert first < set(found)
    assert spark.read.parquet(f"{target}/rows").count() == 5


def test_localized_posts_are_published(spark):
    posts, offers, target = (work_folder(spark, n) for n in ("in", "texts", "out"))
    drop_files(spark, [[seen(1, 0), seen(2, 0), seen(3, 0, title="Product Manager")], [TICK]], SEEN, posts)
    drop_files(spark, [[(1, 1, "Écrit à neuf", minute(1))], [(None, None, None, minute(10_000))]], OFFERS, offers)
    publish.stream_publish(
        localized(spark, posts, offers), target, max_age_hours=48, max_posts=0, clock=lambda: NOW, interval_seconds=None
    ).awaitTermination()
    cards = {r.position: (r.fingerprint, r.card) for r in publish.read_cards(spark, target).collect()}
    assert set(cards) == {1, 2}
    assert "Écrit à neuf" in cards[1][1] and "text 1" not in cards[1][1] and "text 2" in cards[2][1]
    originals = with_fingerprint(spark.createDataFrame([post(1), post(2)], POSTS)).collect()
    assert {r.position: r.fingerprint for r in originals} == {k: v[0] for k, v in cards.items()}


def test_a_running_stream_publishes_what_waits(spark):
    source, target = work_folder(spark, "in"), work_folder(spark, "out")
    drop_files(spark, [[post(i) for i in range(1, 6)]], POSTS, source)
    run = publish.stream_publish(
        stream_of(spark, source, POSTS), target, max_age_hours=48, max_posts=2, clock=lambda: NOW, interval_seconds=1
    )
    try:
        until = time.monotonic() + 120
        while time.monotonic() < until and not (run.exception()):
            if runs.parts_of(spark, f"{target}/published") and publish.read_published(spark, target).count() == 5:
                break
            time.sleep(1)
    finally:
        run.stop()
    assert positions(publish.read_cards(spark, target)) == [1, 2, 3, 4, 5]


# ---------------------------------------------------------------- batches and runs
ROWS = "fingerprint string, title string"


def keys(spark, low, high):
    return spark.range(low, high).selectExpr("sha2(cast(id as string), 256) fingerprint", "cast(id as string) title")


def test_runs_keep_the_table_small(spark, monkeypatch):
    monkeypatch.setattr(runs, "FAN", 3)
    monkeypatch.setattr(runs, "BUCKETS", 4)
    path = work_folder(spark, "table")
    rng = random.Random(3)
    highest = 0
    for batch in range(16):
        keys(spark, 10 * batch, 10 * batch + 10 * (batch % 7 > 0)).coalesce(1).write.parquet(f"{path}/batch={batch}")
        runs.compact(spark, path, ROWS, "fingerprint", batch)
        highest = max(highest, len(runs.parts_of(spark, path)))
    live = runs.parts_of(spark, path)
    assert highest <= 8 and {p.level for p in live} == {0, 1, 2}
    assert len(runs._names(spark, path)) == sum(not p.level for p in live)
    rows = runs.read_parts(spark, path, ROWS, live)
    expected = {10 * b + i for b in range(16) if b % 7 for i in range(10)}
    assert sorted(int(r.title) for r in rows.collect()) == sorted(expected)
    assert {r.batch for r in rows.select("batch").distinct().collect()} == {b for b in range(16) if b % 7}
    asked = rng.sample(range(320), 60)
    wanted = spark.createDataFrame([(str(i),) for i in asked], "id string").selectExpr("sha2(id, 256) fingerprint", "id")
    met = {r.fingerprint for r in runs.keys_met(wanted.select("fingerprint"), "fingerprint", path, ROWS).collect()}
    assert met == {r.fingerprint for r in wanted.collect() if int(r.id) in expected}
    # what stands in runs that end before a batch
    early = {r.title for r in runs.read_parts(spark, path, ROWS, runs.parts_of(spark, path, 9)).collect()}
    assert early == {str(i) for i in expected if i < 90}


def test_a_lookup_reads_the_buckets_it_meets(spark, monkeypatch):
    monkeypatch.setattr(runs, "BUCKETS", 16)
    path = work_folder(spark, "table")
    part = runs.Part(1, 0, 7)
    runs.write_run(keys(spark, 0, 2000).selectExpr("*", "0 batch"), path, part, "fingerprint")
    one = keys(spark, 77, 78).select("fingerprint")
    folders = runs.bucket_folders(one, "fingerprint", path, [part])
    assert len(folders) == 1
    met = runs.keys_met(one, "fingerprint", path, ROWS)
    assert met.count() == 1
    plain = lambda path: path.split(":")[-1].lstrip("/")
    assert {plain(f.rsplit("/", 1)[0]) for f in met.inputFiles() if "bucket=" in f} == {plain(folders[0])}
    unknown = keys(spark, 10_000, 12_000).select("fingerprint")
    hits = sum(len(runs.bucket_folders(unknown.limit(n), "fingerprint", path, [part])) for n in (1, 2, 3))
    assert hits <= 1
    assert runs.keys_met(unknown, "fingerprint", path, ROWS).count() == 0


def test_an_interrupted_merge_leaves_the_table(spark, monkeypatch):
    monkeypatch.setattr(runs, "FAN", 2)
    path = work_folder(spark, "table")
    for batch in range(3):
        keys(spark, 5 * batch, 5 * batch + 5).write.parquet(f"{path}/batch={batch}")
    # the rows of a run without its filters do not count
    runs.write_run(keys(spark, 0, 10).selectExpr("*", "0 batch"), path, runs.Part(1, 0, 1), "fingerprint")
    runs.delete(spark, f"{runs._filters(path)}/run=1_0_1/_SUCCESS")
    count = lambda: runs.read_parts(spark, path, ROWS, runs.parts_of(spark, path)).count()
    assert count() == 15
    # a complete run counts before its batches are deleted, and after
    monkeypatch.setattr(runs, "remove_covered", lambda *_: None)
    runs.compact(spark, path, ROWS, "fingerprint", 2)
    assert {p.name for p in runs.parts_of(spark, path)} == {"batch=2", "run=1_0_1"} and len(runs._names(spark, path)) == 3
    assert count() == 15


def test_old_batches_of_a_stream_are_merged(spark, monkeypatch):
    monkeypatch.setattr(runs, "FAN", 3)
    target = work_folder(spark, "out")
    options = {"now": NOW, "max_age_hours": 48, "max_posts": 2, "order": ("source_rank", "position")}
    for batch in range(8):
        rows = [post(10 * batch + i) for i in range(3)] + [post(1)]
        publish.publish_batch(spark.createDataFrame(rows, POSTS), batch, target, **options)
    assert len(runs.parts_of(spark, f"{target}/published")) <= 5
    assert positions(publish.read_cards(spark, target)) == sorted(publish.read_cards(spark, target).select("position").distinct().toPandas()["position"])
    assert publish.read_published(spark, target).count() == 16
    again = publish.read_published(spark, target).select("fingerprint").collect()
    publish.publish_batch(spark.createDataFrame([post(70 + i) for i in range(3)] + [post(1)], POSTS), 7, target, **options)
    assert sorted(publish.read_published(spark, target).select("fingerprint").collect()) == sorted(again)
    for name in ("unique", "eligible", "pending"):
        assert len(runs._names(spark, f"{target}/{name}")) <= 3


# ---------------------------------------------------------------- applications on keyed state
@pytest.fixture()
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    application_state.use_state_store(spark)
    yield
    spark.conf.set(name, before)


def application_rows(seed, ids, n=240):
    rng = random.Random(seed)
    outcomes = ["submitted", "loading", "submitting", "failed", "queued", "manual_required", "queued", "loading"]
    rows = []
    for i in range(n):
        kind = rng.choice(["apply"] * 6 + ["resume", "other"])
        reason = "bad_name" if kind == "resume" and i < 40 else None
        rows.append((i, rng.randrange(3), kind, rng.choice([*ids, ids[0], "nope"]), reason, rng.choice(outcomes)))
    return rows


def test_keyed_state_equals_batch_over_restarts(spark, state_store):
    ledger = with_fingerprint(spark.createDataFrame([post(i) for i in range(6)], POSTS)).select("fingerprint", "title", "source", "url")
    rows = application_rows(5, [r.fingerprint for r in ledger.collect()])
    source, target = work_folder(spark, "in"), work_folder(spark, "out")
    columns = ["update_id", "decision", "processed", "status_after", "error_after"]
    for low in range(0, 240, 80):  # each poll starts both streams anew from their checkpoints
        drop_files(spark, [rows[a : a + 40] for a in range(low, low + 80, 40)], UPDATES, source)
        application_state.poll_applications(stream_of(spark, source, UPDATES), lambda: ledger, target, operators=[0, 1])
        got = application_state.read_polled_decisions(spark, target).select(columns)
        batch = applications.decide_updates(spark.createDataFrame(rows[: low + 80], UPDATES), ledger, operators=[0, 1])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(columns).collect()))


def test_a_settled_pair_expires(spark, state_store):
    ledger = with_fingerprint(spark.createDataFrame([post(i) for i in range(2)], POSTS)).select("fingerprint", "title", "source", "url")
    one, other = (r.fingerprint for r in ledger.orderBy("url").collect())
    source, target = work_folder(spark, "in"), work_folder(spark, "out")
    options = {"operators": [0], "default_resume": True, "settled_for": 1}
    for number, vacancy in enumerate([one, other, one]):
        drop_files(spark, [[(number, 0, "apply", vacancy, None, "submitted")]], UPDATES, source)
        application_state.poll_applications(stream_of(spark, source, UPDATES), lambda: ledger, target, **options)
        time.sleep(0.2)
    assert {r.update_id: r.processed for r in application_state.read_polled_decisions(spark, target).collect()} == {0: True, 1: True, 2: True}


def test_a_hot_pair_is_decided_in_one_pass():
    import numpy as np

    n = 1_000_000
    rng = np.random.default_rng(1)
    ids = rng.permutation(n).astype(np.int64)
    outcomes = np.where(ids == n // 2, "submitting", "queued").astype(object)
    start = time.process_time()
    found, status, error = application_state.decide(ids, outcomes, np.full(n, None, dtype=object), None, None)
    assert time.process_time() - start < 10
    assert (status, error) == ("manual_required", terms.INTERRUPTED_ERROR)
    assert found["processed"].sum() == n // 2 + 1
    assert (found["decision"] == "manual_required").sum() == 1 and found["decision"][ids == n // 2 + 1] == ["manual_required"]


def test_batches_of_several_files(spark, small, monkeypatch):
    """No task writes a batch of a stream alone: each lies in as many files as its rows ask for, and is one trigger."""
    from hiremill.catalog import streams

    monkeypatch.setattr(streams, "FILE_ROWS", 30)
    monkeypatch.setattr(streams, "LEAST_FILE_ROWS", 5)
    rows = spark.range(400).withColumn("batch", F.col("id") % streams.BATCHES)
    seen = []
    feed = streams._in_batches(spark, rows, F.col("batch"), "test")
    run = feed.writeStream.foreachBatch(lambda df, n: seen.append((len(df.inputFiles()), sorted(r["id"] for r in df.select("id").collect()))))
    run.option("checkpointLocation", streams.work_folder(spark, "test-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert [ids for _, ids in seen] == [list(range(n, 400, 3)) for n in range(3)]
    assert streams._files(rows, F.col("batch")) == 5


def test_localized_in_several_files(spark, small, duck, monkeypatch):
    from hiremill.catalog import ORACLES, streams

    monkeypatch.setattr(streams, "FILE_ROWS", 60)
    monkeypatch.setattr(streams, "LEAST_FILE_ROWS", 20)
    found = {(r["doc_id"], r["description"]) for r in streams.stream_localized_strict(spark, small).collect()}
    assert found == set(duck.execute(ORACLES["stream_localized_strict"]).fetchall())


def test_polls_in_several_files(spark, small, duck, monkeypatch):
    from hiremill.catalog import ORACLES, streams

    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    monkeypatch.setattr(streams, "LEAST_FILE_ROWS", 20)
    names = ["update_id", "decision", "processed", "status_after", "error_after"]
    found = {tuple(r[n] for n in names) for r in streams.keyed_application_decisions(spark, small).collect()}
    own = duck.execute(ORACLES["keyed_application_decisions"])
    assert found == set(own.fetchall())
