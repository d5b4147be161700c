"""Plan-shape checks: the physical plans are the ones the design relies on."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL_SF

FORBIDDEN = ["BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["survey_clean", "rake_month_weights", "track_vote_month", "intervals_score_month",
                                  "report_weight_summary", "test_stats_first_last_week", "survey_normalize_bsas"])
def test_no_row_udf_or_product(spark, name):
    text = plan(entry.queries()[name](spark, SMALL_SF))
    for bad in FORBIDDEN:
        assert bad not in text, (name, bad)


def test_rake_joins_back_by_broadcast_and_pushes_filters(spark):
    df = entry.queries()["rake_month_weights"](spark, SMALL_SF)
    text = plan(df)
    assert "BroadcastHashJoin" in text
    assert "PushedFilters" in df._jdf.queryExecution().executedPlan().toString() or "Filter" in text


def test_aggregations_are_partial(spark):
    from tallyrake.operators.tracking import score_sums
    from tallyrake.plans.queries import _prepared
    df, _ = _prepared(spark, SMALL_SF)
    text = score_sums(df, "win_m", None)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in text


def test_scan_reads_only_needed_columns(spark):
    from tallyrake.sources.driver_view import survey_view
    df = survey_view(spark, SMALL_SF).select("encuesta", "edad")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in text and "o_totalprice" not in text


def test_lines_per_task_are_bounded(spark, monkeypatch):
    """Tasks that sort lines with their interview's columns are dealt by lines, not by file size."""
    from tallyrake.sources import driver_view as V
    monkeypatch.setattr(V, "LINES_PER_TASK", 100)
    n = V.read_table(spark, SMALL_SF, "lineitem").count()
    text = V.survey_with_duplicates(spark, SMALL_SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in text and f", {-(-n // 100)}" in text
