"""Shape of the physical plans: what must and must not be in them."""

from __future__ import annotations

import contextlib
import io
from datetime import UTC, datetime

import pytest

from hiremill.catalog import ORACLES, QUERIES
from hiremill.operators.dedupe import drop_seen_batch
from hiremill.operators.filters import filter_fresh

# queries whose rules need Python batches; everything else stays in the JVM
PYTHON = {
    "first_provider_with_news", "discovery_queue", "scan_result_pages", "page_main_text",
    "requires_manual_access", "page_links", "validate_localized", "localization_errors", "localization_gate",
    "localization_gate_strict", "page_posts", "scan_result_tiers", "page_main_text_ranks",
}


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("stream_", "keyed_", "isolated_"))))
def test_no_cross_join_and_no_hidden_python(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    has_python = any(node in plan for node in ("ArrowEvalPython", "BatchEvalPython", "InPandas", "PythonUDF"))
    assert has_python == (name in PYTHON)


@pytest.mark.parametrize("name", ["first_wins", "per_source_head", "publishable_posts", "append_published", "top_urls"])
def test_ranks_are_cut_before_the_shuffle(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert plan.count("Partial") >= 1 and "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", ["publishable_posts", "top_urls", "limit_wanted", "publish_cap", "show_with_omitted"])
def test_caps_take_ordered(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("name", ["drop_seen", "only_new", "publishable_posts"])
def test_ledger_checks_are_anti_joins(spark, small, name):
    assert "LeftAnti" in plan_of(QUERIES[name](spark, small))


def test_windows_are_partitioned(spark, small):
    for name, run in QUERIES.items():
        if name.startswith(("stream_", "keyed_", "isolated_")):
            continue
        plan = plan_of(run(spark, small))
        if "Window [" in plan:
            assert "SinglePartition" not in plan.split("Window [", 1)[1].split("Exchange", 2)[1][:40], name


def test_scans_read_only_needed_columns(spark, small):
    plan = plan_of(QUERIES["cycle_bucket"](spark, small))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("required", [True, False])
def test_freshness_reaches_the_scan(spark, tmp_path, kind, required):
    path = str(tmp_path / "posts")
    spark.range(3).selectExpr("id", f"CAST('2026-07-20 00:00:00' AS {kind}) AS published_at").write.parquet(path)
    now = datetime(2026, 7, 20, tzinfo=UTC)
    fresh = filter_fresh(spark.read.parquet(path), now=now, max_age_hours=48, require_published_at=required)
    pushed = plan_of(fresh.select("id")).split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "GreaterThanOrEqual(published_at,2026-07-18" in pushed


def test_small_batches_leave_the_ledger_in_place(spark, tmp_path):
    for name in ("batch", "ledger"):
        spark.range(1000).selectExpr("CAST(id AS STRING) AS fingerprint").write.parquet(str(tmp_path / name))
    plan = plan_of(drop_seen_batch(*(spark.read.parquet(str(tmp_path / n)) for n in ("batch", "ledger"))))
    assert "LeftSemi, BuildRight" in plan and "hashpartitioning" not in plan


def test_computed_filters_run_once(spark, small):
    plan = plan_of(QUERIES["scan_search_results"](spark, small))
    assert plan.count("from_json(StructField(title") == 1


@pytest.mark.parametrize("name", sorted(PYTHON - {"first_provider_with_news", "discovery_queue"}))
def test_python_runs_once(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert plan.count("ArrowEvalPython") + plan.count("MapInPandas") == 1


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
