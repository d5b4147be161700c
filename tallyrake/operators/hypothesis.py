"""Two-sample tests of change between windows: H1-H5, F19, A16.

The reference compares the first and the last weekly window (unweighted):
Levene (mean-centred) -> pooled t or Welch t when both samples have >= 30 values,
Mann-Whitney U otherwise; reject at alpha 0.05.

Plan (no row ever leaves the JVM):

* the pairs are chosen first, from the distinct windows; only rows of their windows go on (a
  broadcast semi-join under a size check);
* per-window moments ``(n, mean, var_samp)`` - one aggregation with map-side combine;
* Levene needs ``|x - mean_window|``: the window means (one row per window) are joined
  back by broadcast under a size check, then a second aggregation gives the moments of
  the absolute deviations;
* Mann-Whitney U from value histograms ``(window, value) -> count``: the count of the
  other sample below each value is a **two-level prefix sum** - Spark range-partitions
  (pair, value) by sampled splitters, as many ranges as the data need; the counts of the ranges
  give offsets over a small table, then a running sum inside each (pair, range) - so no task
  ever holds a whole window;
* any number of window pairs at once (first/last, or every window vs the previous);
* p-values in one pandas UDF over the pair table (one row per pair).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrake.functions import special
from tallyrake.session import cut_lineage

# Decision thresholds.
ALPHA = 0.05
LARGE_SAMPLE = 30

# Per-window and per-pair tables are joined back by broadcast up to this many bytes.
BROADCAST_BYTES = 32 << 20
# Distinct (pair, value) rows of one range of the prefix sum.
RANGE_ROWS = 1 << 18


def _small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """Broadcast hint only after counting: window and pair tables are bounded by the calendar,
    but the bound is checked rather than assumed.  ``df`` is a checkpointed table."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _values(df: DataFrame, window_col: str, value_col: str) -> DataFrame:
    return (df.select(F.col(window_col).alias("win"), F.col(value_col).cast("double").alias("x"))
              .filter(F.col("win").isNotNull() & F.col("x").isNotNull()))


def window_moments(df: DataFrame, window_col: str, value_col: str) -> DataFrame:
    """Per window: n, mean, sample variance, and the mean / sum of squares of the
    absolute deviations from the window mean (Levene, centre = mean)."""
    v = _values(df, window_col, value_col)
    m = v.groupBy("win").agg(F.count("x").alias("n"), F.avg("x").alias("mean"),
                             F.var_samp("x").alias("var"))
    m = cut_lineage(m)
    z = (v.join(_small(m.select("win", F.col("mean").alias("_m"))), "win").select("win", F.abs(F.col("x") - F.col("_m")).alias("z"))
          .groupBy("win").agg(F.avg("z").alias("z_mean"),
                              (F.var_samp("z") * (F.count("z") - 1)).alias("z_ss")))
    return m.join(z, "win")


def window_pairs(df: DataFrame, window_col: str, pairs: str = "first_last") -> DataFrame:
    """``(w1, w2)`` pairs - first vs last window, or each window vs the
    previous one.  Built from the distinct windows (one row per window); pass a
    per-window table (``window_col='win'``) to avoid another pass over the rows."""
    wins = df.select(F.col(window_col).alias("win")).filter(F.col("win").isNotNull()).distinct()
    if pairs == "first_last":
        return wins.agg(F.min("win").alias("w1"), F.max("win").alias("w2"))
    if pairs == "consecutive":
        w = Window.orderBy("win")      # one row per window: a small, bounded table
        return (wins.select(F.lag("win").over(w).alias("w1"), F.col("win").alias("w2"))
                    .filter(F.col("w1").isNotNull()))
    raise ValueError(f"unknown pairs mode {pairs!r}")


def mann_whitney_u(df: DataFrame, window_col: str, value_col: str, pair_df: DataFrame,
                   range_rows: int = RANGE_ROWS) -> DataFrame:
    """U of the first sample and the tie term sum(t^3 - t) for every pair."""
    v = _values(df, window_col, value_col)
    hist = v.groupBy("win", "x").agg(F.count(F.lit(1)).alias("c"))
    # side map: two rows per pair (window -> pair, side)
    side = pair_df.select(F.explode(F.array(
        F.struct(F.col("w1").alias("win"), "w1", "w2", F.lit(1).alias("s")),
        F.struct(F.col("w2").alias("win"), "w1", "w2", F.lit(2).alias("s")))).alias("_m")).select("_m.*")
    pv = cut_lineage(hist.join(_small(cut_lineage(side)), "win")
                     .groupBy("w1", "w2", "x")
                     .agg(F.sum(F.when(F.col("s") == 1, F.col("c")).otherwise(0)).alias("n1"),
                          F.sum(F.when(F.col("s") == 2, F.col("c")).otherwise(0)).alias("n2")))
    # level 1: ranges of (pair, value); the range of every row is fixed before it is read again
    ranges = max(1, -(-pv.count() // range_rows))
    pvb = cut_lineage(pv.repartitionByRange(ranges, "w1", "w2", "x").withColumn("b", F.spark_partition_id()))
    tot = pvb.groupBy("w1", "w2", "b").agg(F.sum("n2").alias("n2b"))
    off = tot.select("w1", "w2", "b", F.coalesce(F.sum("n2b").over(
        Window.partitionBy("w1", "w2").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("off"))
    # level 2: running count of the second sample strictly below x inside the range
    local = F.coalesce(F.sum("n2").over(
        Window.partitionBy("w1", "w2", "b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = pvb.withColumn("below", local).join(off, ["w1", "w2", "b"])
    return (out.groupBy("w1", "w2")
               .agg(F.sum(F.col("n1") * (F.col("below") + F.col("off") + F.col("n2") / 2.0)).alias("u1"),
                    F.sum(F.pow(F.col("n1") + F.col("n2"), 3) - (F.col("n1") + F.col("n2"))).alias("tie_term")))


def chosen_rows(df: DataFrame, window_col: str, value_col: str, pair_df: DataFrame) -> DataFrame:
    """``(win, x)`` of the windows that some pair names."""
    wanted = cut_lineage(pair_df.select(F.explode(F.array("w1", "w2")).alias("win")).distinct())
    return _values(df, window_col, value_col).join(_small(wanted), "win", "left_semi")


def pair_statistics(df: DataFrame, window_col: str, value_col: str = "imagen_del_candidato",
                    pairs: str = "first_last") -> DataFrame:
    """H1-H4 statistics for every pair: pooled t, Welch t (+ df), Levene W, U1, ties."""
    pr = cut_lineage(window_pairs(_values(df, window_col, value_col), "win", pairs))
    rows = chosen_rows(df, window_col, value_col, pr)
    mom = cut_lineage(window_moments(rows, "win", "x"))
    a = mom.select(*[F.col(c).alias(f"{c}1") for c in mom.columns])
    b = mom.select(*[F.col(c).alias(f"{c}2") for c in mom.columns])
    j = pr.join(a, pr.w1 == a.win1).join(b, pr.w2 == b.win2).drop("win1", "win2")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    # a pair of constant or single-interview windows has no spread: its statistics are null
    over = F.try_divide
    v1, v2 = over(F.col("var1"), n1), over(F.col("var2"), n2)
    sp2 = over((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2"), n1 + n2 - 2)
    se_w = v1 + v2
    zbar = (n1 * F.col("z_mean1") + n2 * F.col("z_mean2")) / (n1 + n2)
    zss = F.col("z_ss1") + F.col("z_ss2")
    lev = over((n1 + n2 - 2) * (n1 * F.pow(F.col("z_mean1") - zbar, 2) + n2 * F.pow(F.col("z_mean2") - zbar, 2)), zss)
    gap = F.col("mean1") - F.col("mean2")
    stats = j.select(
        "w1", "w2", "n1", "n2", F.col("mean1"), F.col("mean2"),
        over(gap, F.sqrt(sp2 * (1 / n1 + 1 / n2))).alias("t_pooled"),
        (n1 + n2 - 2).alias("df_pooled"),
        over(gap, F.sqrt(se_w)).alias("t_welch"),
        over(F.pow(se_w, 2), over(F.pow(v1, 2), n1 - 1) + over(F.pow(v2, 2), n2 - 1)).alias("df_welch"),
        F.when(zss > 0, lev).alias("levene_w"))
    u = mann_whitney_u(rows, "win", "x", pr)
    return stats.join(u, ["w1", "w2"], "left")


_P_SCHEMA = T.StructType([T.StructField(n, T.DoubleType()) for n in ("p_levene", "p_pooled", "p_welch", "p_mwu")])


@F.pandas_udf(_P_SCHEMA)
def _pvalues(n1: pd.Series, n2: pd.Series, lev: pd.Series, tp: pd.Series, dfp: pd.Series,
             tw: pd.Series, dfw: pd.Series, u1: pd.Series, ties: pd.Series) -> pd.DataFrame:
    nn = (n1 + n2).astype("float64")
    has_ties = ties.fillna(0) > 0
    return pd.DataFrame({
        "p_levene": special.vf1_sf(lev.astype("float64"), nn - 2),
        "p_pooled": special.vt_two_sided(tp.astype("float64"), dfp.astype("float64")),
        "p_welch": special.vt_two_sided(tw.astype("float64"), dfw.astype("float64")),
        "p_mwu": special.vmwu_two_sided(u1.astype("float64"), n1.astype("int64"), n2.astype("int64"),
                                        ties.fillna(0).astype("float64"), has_ties),
    })


def test_change(df: DataFrame, window_col: str, value_col: str = "imagen_del_candidato",
                pairs: str = "first_last", alpha: float = ALPHA) -> DataFrame:
    """Test of change: choose the test per pair and decide at ``alpha`` (H5).

    Output: ``w1, w2, n1, n2, test, statistic, p_value, reject, p_levene``.
    Windows without any observed value are skipped when forming pairs (the
    reference raises on an empty window instead).
    """
    st = pair_statistics(df, window_col, value_col, pairs)
    pv = st.withColumn("_p", _pvalues("n1", "n2", "levene_w", "t_pooled", "df_pooled",
                                      "t_welch", "df_welch", "u1", "tie_term"))
    large = (F.col("n1") >= LARGE_SAMPLE) & (F.col("n2") >= LARGE_SAMPLE)
    homo = F.col("_p.p_levene") >= alpha
    test = F.when(large & homo, "student").when(large, "welch").otherwise("mann_whitney")
    stat = (F.when(large & homo, F.col("t_pooled")).when(large, F.col("t_welch")).otherwise(F.col("u1")))
    p = (F.when(large & homo, F.col("_p.p_pooled")).when(large, F.col("_p.p_welch"))
          .otherwise(F.col("_p.p_mwu")))
    return pv.select("w1", "w2", "n1", "n2", test.alias("test"), stat.alias("statistic"),
                     p.alias("p_value"), (p < alpha).alias("reject"), F.col("_p.p_levene").alias("p_levene"))

