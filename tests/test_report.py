import numpy as np
import pytest

from tallyrake.operators.report import asmd, report_rake, sample_vs_population, weight_metrics, weight_summary
from tests.test_rake import TGT, frame


def test_report_metrics_match_rows(spark):
    df = frame(spark, {("f", "a"): 60, ("f", "b"): 5, ("m", "a"): 10, ("m", "b"): 25})
    rep = report_rake(df, ["sexo", "edad_cat"], TGT)
    w = np.array([r["peso_reporte"] for r in rep.weighted.collect()])
    assert w.mean() == pytest.approx(1.0)
    m = weight_metrics(rep).first()
    assert m["deff"] == pytest.approx(1 + w.var(ddof=1) / w.mean() ** 2)
    assert m["ess"] == pytest.approx(w.sum() ** 2 / (w ** 2).sum())
    s = {r["stat"]: r["value"] for r in weight_summary(rep).collect()}
    for name, q in (("q25", 25), ("median", 50), ("q75", 75)):
        assert s[name] == pytest.approx(np.percentile(w, q))
    assert s["prop(w < 1.0)"] == pytest.approx((w < 1.0).mean())
    assert s["max"] == pytest.approx(w.max())
    svp = {(r["variable"], r["level"]): r for r in sample_vs_population(rep).collect()}
    assert svp[("sexo", "f")]["sample_prop"] == pytest.approx(0.65)
    assert svp[("sexo", "f")]["weighted_prop"] == pytest.approx(0.5, abs=1e-3)
    a = {r["variable"]: r for r in asmd(rep).collect()}
    assert a["mean(asmd)"]["asmd_after"] < a["mean(asmd)"]["asmd_before"]


def test_single_interview_and_equal_weight_windows(spark):
    from tallyrake.operators.report import report_rake, weight_metrics, weight_summary
    rows = [("m1", "a")] + [("m2", "a"), ("m2", "b")] * 3
    df = spark.createDataFrame(rows, "win string, v string")
    rep = report_rake(df, ["v"], {"v": {"a": 0.5, "b": 0.5}}, window_col="win")
    met = {r["win"]: r for r in weight_metrics(rep).collect()}
    assert met["m1"]["deff"] is None and met["m1"]["n"] == 1
    assert met["m2"]["deff"] == 1.0 and met["m2"]["ess"] == 6.0
    summary = {(r["win"], r["stat"]): r["value"] for r in weight_summary(rep).collect()}
    assert summary["m2", "std"] == 0.0 and summary["m2", "n"] == 6.0 and summary["m1", "std"] is None


def test_a_target_share_of_one_is_left_out_of_the_averages(spark):
    from tallyrake.operators.report import asmd, report_rake
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x")], "v string, u string")
    rep = report_rake(df, ["v", "u"], {"v": {"a": 0.5, "b": 0.5}, "u": {"x": 1.0}})
    got = {r["variable"]: r["asmd_before"] for r in asmd(rep).collect()}
    assert got["u"] is None and got["v"] > 0
