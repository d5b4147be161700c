"""Whole-survey calibration report: C2-C5, A10, A11.

Everything is computed on the **cell table** of the whole-survey rake (rows sharing
the calibration levels share one weight), weighted by the cell counts ``n``: the
row-level quantities (sums, variances, exact quantiles) follow exactly from the cells,
and the cells never grow with the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrake.functions.recode import as_level
from tallyrake.operators.rake import DEFAULT_MAX_ITER, DEFAULT_TOL, rake, targets_as_dict

# Report trim ratio and the weight-summary thresholds.
REPORT_TRIM_RATIO = 3.0
PROP_BELOW = [0.1, 0.2, 0.333, 0.5, 1.0]
PROP_ABOVE = [1.0, 2.0, 3.0, 5.0, 10.0]
QUANTILES = [("q25", 0.25), ("median", 0.5), ("q75", 0.75)]


@dataclass
class Report:
    weighted: DataFrame   # rows + report weight
    cells: DataFrame      # (levels, n, weight) of the whole-survey rake after trimming
    variables: list
    targets: dict
    window_col: str | None = None


def report_rake(df: DataFrame, variables: list[str], targets, ratio: float = REPORT_TRIM_RATIO,
                weight_col: str = "peso_reporte", max_iter: int = DEFAULT_MAX_ITER,
                tol: float = DEFAULT_TOL, sweeps: int | None = None,
                window_col: str | None = None) -> Report:
    """Rake the whole survey, trim weights above ``ratio``
    times the mean and rescale so the mean is kept.  Weights have mean 1.

    With ``window_col`` every window is treated as one survey (one report per batch).
    """
    tgt = targets_as_dict(targets, variables)
    res = rake(df, window_col, variables, tgt, weight_col="_w0", max_iter=max_iter, tol=tol,
               trim_ratio=None, sweeps=sweeps)
    grp = [window_col] if window_col else []
    all_ = Window.partitionBy(*grp)      # cells of one window: a small, bounded table
    c = res.cells
    c = c.withColumn("_mean", F.sum(F.col("n") * F.col("weight")).over(all_) / F.sum("n").over(all_))
    c = c.withColumn("_wt", F.least(F.col("weight"), F.col("_mean") * ratio))
    c = c.withColumn("weight", F.col("_wt") * F.col("_mean")
                     / (F.sum(F.col("n") * F.col("_wt")).over(all_) / F.sum("n").over(all_)))
    lv = [f"_lv_{v}" for v in variables]
    cells = c.select(*grp, *lv, "n", "status", "iterations", "weight")
    lookup = cells.select(*grp, *lv, F.col("weight").alias(weight_col))
    rows = df.withColumns({f"_lv_{v}": as_level(v) for v in variables})
    weighted = rows.join(lookup, grp + lv, "left").drop(*lv)
    return Report(weighted, cells, variables, tgt, window_col)


def weight_metrics(rep: Report) -> DataFrame:
    """A10: deff with the sample variance (ddof 1), Kish ess, ess / n, max, min
    (one row, or one row per window)."""
    grp = [rep.window_col] if rep.window_col else []
    own = Window.partitionBy(*grp)               # cells of one window: a small, bounded table
    c = rep.cells.withColumn("_m", F.sum(F.col("n") * F.col("weight")).over(own) / F.sum("n").over(own))
    agg = c.groupBy(*grp).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("weight")).alias("sw"),
                F.sum(F.col("n") * F.col("weight") * F.col("weight")).alias("sww"),
                F.sum(F.col("n") * F.pow(F.col("weight") - F.col("_m"), 2)).alias("_ss"),
                F.max("weight").alias("w_max"), F.min("weight").alias("w_min"))
    mean = F.col("sw") / F.col("n")
    var_samp = F.try_divide(F.col("_ss"), F.col("n") - 1)      # null for a single interview
    ess = F.pow(F.col("sw"), 2) / F.col("sww")
    return agg.select(*grp, "n", (1 + var_samp / F.pow(mean, 2)).alias("deff"), ess.alias("ess"),
                      (ess / F.col("n")).alias("essp"), "w_max", "w_min")


def _level_shares(rep: Report) -> DataFrame:
    """Per (variable, level): unweighted and weighted shares from the cells."""
    parts = []
    for v in rep.variables:
        parts.append(rep.cells.groupBy(F.col(f"_lv_{v}").alias("level"))
                     .agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("weight")).alias("_nw"))
                     .withColumn("variable", F.lit(v)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    tot = Window.partitionBy("variable")
    return out.select("variable", "level",
                      (F.col("_n") / F.sum("_n").over(tot)).alias("sample_prop"),
                      (F.col("_nw") / F.sum("_nw").over(tot)).alias("weighted_prop"))


def targets_frame(spark, rep: Report) -> DataFrame:
    rows = [(v, lvl, float(p)) for v in rep.variables for lvl, p in rep.targets[v].items()]
    return spark.createDataFrame(rows, "variable string, level string, target_prop double")


def sample_vs_population(rep: Report) -> DataFrame:
    """C5 + J5: target proportions with the observed shares aligned (absent -> 0)."""
    t = targets_frame(rep.cells.sparkSession, rep)
    s = _level_shares(rep)
    return (t.join(F.broadcast(s), ["variable", "level"], "left")
             .select("variable", "level", "target_prop",
                     F.coalesce("sample_prop", F.lit(0.0)).alias("sample_prop"),
                     F.coalesce("weighted_prop", F.lit(0.0)).alias("weighted_prop")))


def value_shares(df: DataFrame, variables: list[str]) -> DataFrame:
    """Normalised value counts of each calibration variable (null -> 'nan')."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), as_level(v).alias("level")) for v in variables])).alias("_s"))
    g = long.groupBy(F.col("_s.variable").alias("variable"), F.col("_s.level").alias("level")).count()
    return g.select("variable", "level",
                    (F.col("count") / F.sum("count").over(Window.partitionBy("variable"))).alias("share"))


def asmd(rep: Report) -> DataFrame:
    """Absolute standardised mean difference of every level dummy against the
    target, ``|p - p_t| / sqrt(p_t (1 - p_t))``, averaged over the levels of each
    variable, before and after weighting, plus the overall mean and the reduction."""
    svp = sample_vs_population(rep)
    sd = F.sqrt(F.col("target_prop") * (1 - F.col("target_prop")))
    # a level with target share 0 or 1 has no spread: it is left out of the averages
    per = svp.select("variable", F.try_divide(F.abs(F.col("sample_prop") - F.col("target_prop")), sd).alias("b"),
                     F.try_divide(F.abs(F.col("weighted_prop") - F.col("target_prop")), sd).alias("a"))
    by_var = per.groupBy("variable").agg(F.avg("b").alias("asmd_before"), F.avg("a").alias("asmd_after"))
    overall = by_var.agg(F.lit("mean(asmd)").alias("variable"), F.avg("asmd_before").alias("asmd_before"),
                         F.avg("asmd_after").alias("asmd_after"))
    out = by_var.unionByName(overall)
    return out.withColumn("reduction_pct",
                          F.when(F.col("asmd_before") > 0,
                                 (1 - F.col("asmd_after") / F.col("asmd_before")) * 100.0))


def weight_summary(rep: Report) -> DataFrame:
    """C4: weight distribution as ``(stat, value)`` rows (per window on a windowed report).

    n, sum, mean, std (ddof 1), min, exact quartiles (linear interpolation), max,
    shares of weights below / at-or-above fixed multiples of the mean, deff, ess, essp.
    """
    grp = [rep.window_col] if rep.window_col else []
    own = Window.partitionBy(*grp)
    c = rep.cells.select(*grp, "n", F.col("weight").alias("w"))
    order = own.orderBy("w").rowsBetween(Window.unboundedPreceding, 0)   # cells only
    c = (c.withColumn("cum", F.sum("n").over(order)).withColumn("_tot", F.sum("n").over(own))
          .withColumn("_m", F.sum(F.col("n") * F.col("w")).over(own) / F.col("_tot")))
    aggs = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("w")).alias("sum"),
            F.sum(F.col("n") * F.col("w") * F.col("w")).alias("_sww"),
            F.sum(F.col("n") * F.pow(F.col("w") - F.col("_m"), 2)).alias("_ss"),
            F.min("w").alias("min"), F.max("w").alias("max")]
    for name, p in QUANTILES:
        h = (F.col("_tot") - 1) * p
        aggs += [F.min(F.when(F.col("cum") > F.floor(h), F.col("w"))).alias(f"_{name}_lo"),
                 F.min(F.when(F.col("cum") > F.ceil(h), F.col("w"))).alias(f"_{name}_hi"),
                 F.first(h - F.floor(h)).alias(f"_{name}_f")]
    for i, t in enumerate(PROP_BELOW):
        aggs.append(F.sum(F.when(F.col("w") < t, F.col("n")).otherwise(0)).alias(f"_lt{i}"))
    for i, t in enumerate(PROP_ABOVE):
        aggs.append(F.sum(F.when(F.col("w") >= t, F.col("n")).otherwise(0)).alias(f"_ge{i}"))
    a = c.groupBy(*grp).agg(*aggs)
    mean = F.col("sum") / F.col("n")
    std = F.sqrt(F.try_divide(F.col("_ss"), F.col("n") - 1))   # null for a single interview
    ess = F.pow(F.col("sum"), 2) / F.col("_sww")
    stats = [("n", F.col("n").cast("double")), ("sum", F.col("sum")), ("mean", mean), ("std", std),
             ("min", F.col("min"))]
    for name, _ in QUANTILES:
        lo, hi, fr = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_f")
        stats.append((name, lo + fr * (hi - lo)))
    stats.append(("max", F.col("max")))
    for i, t in enumerate(PROP_BELOW):
        stats.append((f"prop(w < {t})", F.col(f"_lt{i}") / F.col("n")))
    for i, t in enumerate(PROP_ABOVE):
        stats.append((f"prop(w >= {t})", F.col(f"_ge{i}") / F.col("n")))
    stats += [("deff", 1 + F.pow(std, 2) / F.pow(mean, 2)), ("ess", ess), ("essp", ess / F.col("n"))]
    return a.select(*grp, F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), v.cast("double").alias("value"))
                                              for k, v in stats])).alias("_s")).select(*grp, "_s.stat", "_s.value")
