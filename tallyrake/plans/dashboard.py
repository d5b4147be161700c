"""Entry 2 of the reference (the analytic dashboard) as independent DataFrames.

Every table is its own aggregation over the weighted survey (no ordering between
them, no in-place columns): tracking, the melted vote table for charts, the
whole-survey calibration report, intervals and the test of change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallyrake.operators import tracking as trk
from tallyrake.operators.hypothesis import test_change
from tallyrake.operators.report import asmd, report_rake, sample_vs_population, weight_metrics, weight_summary

UNIT = {"d": ("win_d", "peso_d"), "s": ("win_s", "peso_s"), "m": ("win_m", "peso_m")}


@dataclass
class Dashboard:
    tracking_score: DataFrame
    tracking_vote: DataFrame
    tracking_vote_long: DataFrame
    report_metrics: DataFrame
    report_asmd: DataFrame
    report_sample_vs_target: DataFrame
    report_weights: DataFrame
    intervals_score: DataFrame
    intervals_vote: DataFrame
    test: DataFrame


def dashboard(weighted: DataFrame, variables: list[str], targets, unit: str = "s",
              test_pairs: str = "first_last", test_window: str = "win_s") -> Dashboard:
    """``unit`` in d / s / m selects the window and weight columns (``tipo_track``).

    The test defaults to the reference's choice (first vs last weekly window,
    unweighted) whatever the unit; ``test_pairs='consecutive'`` tests every window."""
    win, w = UNIT[unit]
    wide = trk.vote_wide(weighted, win, w)
    rep = report_rake(weighted, variables, targets)
    return Dashboard(
        tracking_score=trk.track_score(weighted, win, w),
        tracking_vote=wide,
        tracking_vote_long=trk.melt_wide(wide, win),
        report_metrics=weight_metrics(rep),
        report_asmd=asmd(rep),
        report_sample_vs_target=sample_vs_population(rep),
        report_weights=weight_summary(rep),
        intervals_score=trk.score_intervals(weighted, win, w),
        intervals_vote=trk.vote_intervals(weighted, win, w),
        test=test_change(weighted, test_window, "imagen_del_candidato", test_pairs),
    )
