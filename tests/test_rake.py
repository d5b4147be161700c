import math

import pytest
from pyspark.sql import functions as F

from tallyrake.operators.rake import rake

TGT = {"sexo": {"f": 0.5, "m": 0.5}, "edad_cat": {"a": 0.5, "b": 0.5}}


def frame(spark, cells, window="w1"):
    rows = []
    i = 0
    for (s, e), n in cells.items():
        for _ in range(n):
            rows.append((str(i), window, s, e))
            i += 1
    return spark.createDataFrame(rows, "id string, win string, sexo string, edad_cat string")


def weights(res):
    return {(r["sexo"], r["edad_cat"]): r["peso"] for r in res.weighted.select("sexo", "edad_cat", "peso").distinct().collect()}


def test_two_by_two_golden(spark):
    df = frame(spark, {("f", "a"): 30, ("f", "b"): 10, ("m", "a"): 20, ("m", "b"): 40})
    res = rake(df, "win", ["sexo", "edad_cat"], TGT, weight_col="peso", tol=1e-12, max_iter=1000)
    w = weights(res)
    x = 0.5 * math.sqrt(6) / (1 + math.sqrt(6))          # odds ratio 6 is preserved
    assert w[("f", "a")] == pytest.approx(x * 100 / 30, rel=1e-9)
    assert w[("f", "b")] == pytest.approx((0.5 - x) * 100 / 10, rel=1e-9)
    assert w[("m", "a")] == pytest.approx((0.5 - x) * 100 / 20, rel=1e-9)
    assert w[("m", "b")] == pytest.approx(x * 100 / 40, rel=1e-9)
    d = res.diagnostics.first()
    assert d["status"] == "ok" and d["n"] == 100


def test_sum_to_n_and_margins(spark):
    df = frame(spark, {("f", "a"): 7, ("f", "b"): 3, ("m", "a"): 2, ("m", "b"): 13}, "w1").unionByName(
        frame(spark, {("f", "a"): 4, ("f", "b"): 9, ("m", "a"): 6, ("m", "b"): 5}, "w2"))
    res = rake(df, "win", ["sexo", "edad_cat"], TGT, weight_col="peso", trim_ratio=None, tol=1e-9)
    tot = {r["win"]: (r["s"], r["n"]) for r in res.weighted.groupBy("win").agg(
        F.sum("peso").alias("s"), F.count("*").alias("n")).collect()}
    for s, n in tot.values():
        assert s == pytest.approx(n, rel=1e-12)
    marg = res.weighted.groupBy("win", "sexo").agg(F.sum("peso").alias("s")).collect()
    for r in marg:
        assert r["s"] / tot[r["win"]][1] == pytest.approx(0.5, abs=1e-6)
    assert all(r["peso"] > 0 for r in res.weighted.collect())


def test_sample_at_target_gets_weight_one(spark):
    df = frame(spark, {("f", "a"): 25, ("f", "b"): 25, ("m", "a"): 25, ("m", "b"): 25})
    res = rake(df, "win", ["sexo", "edad_cat"], TGT, weight_col="peso")
    assert all(v == pytest.approx(1.0) for v in weights(res).values())


def test_fallbacks(spark):
    empty = frame(spark, {("f", "a"): 5, ("f", "b"): 5}, "w_empty")            # no 'm' case
    notarget = frame(spark, {("f", "a"): 5, ("m", "b"): 5, ("f", None): 1}, "w_nan")  # 'nan' level
    res = rake(empty.unionByName(notarget), "win", ["sexo", "edad_cat"], TGT, weight_col="peso")
    st = {r["win"]: r["status"] for r in res.diagnostics.collect()}
    assert st == {"w_empty": "fallback_empty_level", "w_nan": "fallback_no_target"}
    assert {r["peso"] for r in res.weighted.collect()} == {1.0}
    assert all(r["warn_fallback"] for r in res.diagnostics.collect())


def test_cells_and_native_agree(spark):
    df = frame(spark, {("f", "a"): 17, ("f", "b"): 3, ("m", "a"): 9, ("m", "b"): 31})
    a = weights(rake(df, "win", ["sexo", "edad_cat"], TGT, weight_col="peso", sweeps=4))
    b = weights(rake(df, "win", ["sexo", "edad_cat"], TGT, weight_col="peso", sweeps=4, method="native"))
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-12)


def test_trim_bounds_and_deff(spark):
    df = frame(spark, {("f", "a"): 90, ("f", "b"): 2, ("m", "a"): 2, ("m", "b"): 6})
    res = rake(df, "win", ["sexo", "edad_cat"], TGT, weight_col="peso")
    ws = [r["peso"] for r in res.weighted.collect()]
    assert max(ws) / min(ws) <= 9.0 + 1e-9            # [mean/3, 3*mean] before rescaling
    d = res.diagnostics.first()
    assert d["deff_pop"] > 2.5 and d["warn_deff"]


def test_partitioning_does_not_change_results(spark):
    df = frame(spark, {("f", "a"): 11, ("f", "b"): 23, ("m", "a"): 5, ("m", "b"): 8})
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = weights(rake(df, "win", ["sexo", "edad_cat"], TGT, weight_col="peso"))
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        b = weights(rake(df.repartition(5), "win", ["sexo", "edad_cat"], TGT, weight_col="peso"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-12)


def test_whole_survey_window(spark):
    df = frame(spark, {("f", "a"): 30, ("f", "b"): 10, ("m", "a"): 20, ("m", "b"): 40})
    res = rake(df, None, ["sexo", "edad_cat"], TGT, weight_col="peso")
    assert res.weighted.agg(F.sum("peso")).first()[0] == pytest.approx(100.0)
    assert "win" in res.weighted.columns


def test_windows_are_independent(spark):
    a = frame(spark, {("f", "a"): 17, ("f", "b"): 3, ("m", "a"): 9, ("m", "b"): 31}, "w1")
    b = frame(spark, {("f", "a"): 2, ("f", "b"): 40, ("m", "a"): 12, ("m", "b"): 6}, "w2")
    together = rake(a.unionByName(b), "win", ["sexo", "edad_cat"], TGT, weight_col="peso")
    alone = rake(a, "win", ["sexo", "edad_cat"], TGT, weight_col="peso")
    wt = {(r["win"], r["sexo"], r["edad_cat"]): r["peso"] for r in together.weighted.collect()}
    for r in alone.weighted.collect():
        assert wt[("w1", r["sexo"], r["edad_cat"])] == pytest.approx(r["peso"], rel=1e-12)
    it = {r["win"]: r["iterations"] for r in together.diagnostics.collect()}
    assert it["w1"] == alone.diagnostics.first()["iterations"]


def test_vectorised_ipf_equals_single_window_definition():
    import numpy as np
    import pandas as pd

    from tallyrake.operators.rake import _WIN, _ipf_numpy, _ipf_partition_fn, _lv

    rng = np.random.default_rng(5)
    tgt = {"sexo": {"f": 0.52, "m": 0.48}, "edad_cat": {"a": 0.2, "b": 0.3, "c": 0.5}}
    rows = []
    for w in range(6):
        for s in ("f", "m"):
            for e in ("a", "b", "c"):
                rows.append((w, s, e, int(rng.integers(1, 40)), "ok"))
    pdf = pd.DataFrame(rows, columns=[_WIN, _lv("sexo"), _lv("edad_cat"), "n", "status"])
    out = next(_ipf_partition_fn(["sexo", "edad_cat"], tgt, 1000, 1e-9)(iter([pdf])))
    for w in range(6):
        sub = pdf[pdf[_WIN] == w]
        codes = [sub[_lv("edad_cat")].map({"a": 0, "b": 1, "c": 2}).to_numpy(),
                 sub[_lv("sexo")].map({"f": 0, "m": 1}).to_numpy()]
        ref, sweeps, conv = _ipf_numpy(sub["n"].to_numpy(float), codes,
                                       [np.array([0.2, 0.3, 0.5]), np.array([0.52, 0.48])], 1000, 1e-9)
        got = out[out[_WIN] == w]
        assert np.allclose(got["w_raw"].to_numpy(), ref / sub["n"].to_numpy(float), rtol=1e-10)
        assert (got["iterations"] == sweeps).all() and conv


def test_lump_below_merges_small_levels(spark):
    tgt = {"sexo": {"f": 0.5, "m": 0.5}, "edad_cat": {"a": 0.9, "b": 0.06, "c": 0.04}}
    df = frame(spark, {("f", "a"): 30, ("f", "b"): 4, ("m", "a"): 40, ("m", "c"): 6})
    # without lumping: ('f','c') and ('m','b') exist neither; levels b and c each present -> raked
    res = rake(df, "win", ["sexo", "edad_cat"], tgt, weight_col="peso", lump_below=0.05 + 0.02)
    marg = {r["edad_cat"]: r["s"] for r in res.weighted.groupBy("edad_cat").agg(F.sum("peso").alias("s")).collect()}
    assert (marg["b"] + marg["c"]) / 80 == pytest.approx(0.10, abs=1e-3)
    assert marg["a"] / 80 == pytest.approx(0.90, abs=1e-3)
    assert res.diagnostics.first()["status"] == "ok"
