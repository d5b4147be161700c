import pytest

from pyspark.sql import functions as F

from tallyrake.operators import tracking as trk


def data(spark):
    rows = [("w1", 10.0, "a", 1.0), ("w1", 20.0, "b", 3.0), ("w1", None, "a", 2.0),
            ("w2", 30.0, "b", 1.0), ("w2", 50.0, None, 1.0)]
    return spark.createDataFrame(rows, "win string, imagen_del_candidato double, voto string, peso double")


def test_weighted_mean_and_intervals(spark):
    df = data(spark)
    t = {r["win"]: r["trackeo"] for r in trk.track_score(df, "win", "peso").collect()}
    assert t["w1"] == pytest.approx((10 + 60) / 4)
    iv = {r["win"]: r for r in trk.score_intervals(df, "win", "peso").collect()}
    m = 17.5
    sd = ((1 * (10 - m) ** 2 + 3 * (20 - m) ** 2) / 4) ** 0.5
    neff = 16 / 10
    assert iv["w1"]["imagen_media"] == pytest.approx(m)
    assert iv["w1"]["moe_95"] == pytest.approx(1.96 * sd / neff ** 0.5)
    assert iv["w1"]["n_eff"] == pytest.approx(neff)


def test_vote_share_zero_fill_and_nulls(spark):
    df = data(spark)
    v = {(r["win"], r["candidate"]): r["share"] for r in trk.track_vote(df, "win", "peso").collect()}
    assert v[("w1", "a")] == pytest.approx(300 / 6 / 1)   # (1+2)/6*100
    assert v[("w2", "a")] == 0.0                          # absent candidate -> 0
    assert v[("w2", "b")] == pytest.approx(50.0)          # null vote stays in the total
    assert ("w2", None) not in v
    wide = trk.vote_wide(df, "win", "peso").collect()
    assert set(wide[0].asDict()) == {"win", "vota_a", "vota_b"}
    melted = {(r["win"], r["candidate"]): r["share"] for r in trk.melt_wide(trk.vote_wide(df, "win", "peso"), "win").collect()}
    assert melted == pytest.approx(v)


def test_vote_intervals(spark):
    df = data(spark)
    iv = {(r["win"], r["candidate"]): r for r in trk.vote_intervals(df, "win", "peso").collect()}
    p, neff = 0.5, 36 / 14
    assert iv[("w1", "a")]["moe"] == pytest.approx(100 * 1.96 * (p * (1 - p) / neff) ** 0.5)


def test_no_candidates(spark):
    df = spark.createDataFrame([("w1", 1.0, None, 1.0)], "win string, imagen_del_candidato double, voto string, peso double")
    assert trk.vote_intervals(df, "win", "peso").count() == 0
    assert trk.track_vote(df, "win", "peso").count() == 0


def test_spread_keeps_its_digits_far_from_zero(spark):
    from tallyrake.operators.tracking import score_intervals
    rows = [(w, far + v, wt) for w, far in (("a", 0.0), ("b", 1e9), ("c", -3e12), ("d", 5e4)) for v, wt in
            ((0.0, 1.0), (1.0, 2.0), (2.0, 0.5), (3000.0, 0.25))] + [("e", None, 1.0), ("f", 7.0, 0.0)]
    got = {r["win"]: r for r in score_intervals(spark.createDataFrame(rows, "win string, imagen_del_candidato double, peso double"),
                                                "win", "peso").collect()}
    for w, far in (("b", 1e9), ("c", -3e12), ("d", 5e4)):
        assert abs(got[w]["moe_95"] / got["a"]["moe_95"] - 1) < 1e-12
        assert abs(got[w]["imagen_media"] - far - got["a"]["imagen_media"]) < 1e-3
    assert got["e"]["n"] == 0 and got["e"]["moe_95"] is None
    assert got["f"]["n"] == 1 and got["f"]["imagen_media"] is None
    near = score_intervals(spark.createDataFrame([("a", 1e9 + i % 3, 1.0) for i in range(300)], "win string, imagen_del_candidato double, peso double"),
                           "win", "peso").first()
    assert abs(near["moe_95"] - 1.96 * (2 / 3) ** 0.5 / 300 ** 0.5) < 1e-12


def test_wide_votes_of_very_many_candidates(spark):
    df = spark.range(120_000).select((F.col("id") % 3).alias("win"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("c"), F.col("id") % 5))
                                     .when(F.col("id") % 4 < 3, F.concat(F.lit("rare"), F.col("id"))).alias("voto"), F.lit(2.0).alias("peso"))
    wide = trk.vote_wide(df, "win", "peso", max_columns=5)
    assert wide.columns == ["win", *[f"vota_c{i}" for i in range(5)], "vota_otros candidatos"]
    for r in wide.collect():
        assert abs(r["vota_otros candidatos"] - 50) < 1e-9 and abs(sum(r[1:6]) - 25) < 1e-9
    with pytest.raises(ValueError, match="long form"):
        trk.candidates(df)
    assert trk.candidates(df.filter("id % 4 = 0")) == [f"c{i}" for i in range(5)]
    few = trk.vote_wide(df.filter("id % 4 = 0 and id < 8"), "win", None, max_columns=5).orderBy("win").collect()
    assert [tuple(r) for r in few] == [(0, 100.0, 0.0), (1, 0.0, 100.0)]


def test_vote_shares_read_the_rows_once(spark):
    rows = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([("w1", "a", 1.0), ("w1", "b", 3.0), ("w2", None, 2.0)], "win string, voto string, peso double")

    def count(row):
        rows.add(1)
        return row
    got = trk.vote_intervals(spark.createDataFrame(df.rdd.map(count), df.schema), "win", "peso").collect()
    assert len(got) == 4 and rows.value == 3
