"""Weighted tracking and 95 % intervals: A1-A6, R1, R2.

Every estimate is a one-pass hash aggregation over the rows (per window or per window and
candidate) with map-side combine, so skewed windows are pre-aggregated before the shuffle.
Spreads come from sums around a nearby centre, so a score far from zero keeps its digits.  Results stay in long form; ``pivot`` is only used
at the wide edge (R1) with an explicit, sorted candidate list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrake.session import cut_lineage

# Fixed value: normal quantile of the 95 % intervals.
Z95 = 1.96
# Most candidates that get a column of their own in the wide tables.
MAX_WIDE = 1000
# Scores are summed around the multiples of this.
STRETCH = 1024.0


def _w(weight_col: str | None):
    return F.col(weight_col).cast("double") if weight_col else F.lit(1.0)


def score_sums(df: DataFrame, window_col: str, weight_col: str | None,
               score_col: str = "imagen_del_candidato") -> DataFrame:
    """Per window: sum of weights and of their squares, n, weighted mean and weighted population
    variance; rows with a null score do not count (neither weight nor value).

    Rows are summed by window and stretch of ``STRETCH`` score units, each score taken from the
    middle of its stretch; a window's few stretches are then put together around its own mean.  A
    score far from zero keeps its digits, and no second pass over the rows is needed."""
    x = F.col(score_col).cast("double")
    w = F.when(x.isNotNull(), _w(weight_col))
    rows = df.select(window_col, w.alias("_w"), F.rint(x / STRETCH).alias("_b"), (x - F.rint(x / STRETCH) * STRETCH).alias("_d"))
    d = F.col("_d")
    parts = rows.groupBy(window_col, "_b").agg(
        F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col("_w")).alias("_sww"), F.count(d).alias("n"),
        F.sum(F.col("_w") * d).alias("_swd"), F.sum(F.col("_w") * d * d).alias("_swdd"))
    here = Window.partitionBy(window_col)
    far = (F.col("_b") - F.min("_b").over(here)) * STRETCH         # from the window's first stretch
    parts = parts.withColumn("_far", far).withColumn(
        "_m", F.try_divide(F.sum(F.col("_swd") + F.col("_sw") * F.col("_far")).over(here), F.sum("_sw").over(here)))
    off = F.col("_m") - F.col("_far")
    return parts.groupBy(window_col).agg(
        F.sum("n").alias("n"), F.sum("_sw").alias("_sw"), F.sum("_sww").alias("_sww"),
        (F.min("_b") * STRETCH + F.min("_m")).alias("_mean"),
        F.greatest(F.try_divide(F.sum(F.col("_swdd") - 2 * off * F.col("_swd") + off * off * F.col("_sw")), F.sum("_sw")),
                   F.lit(0.0)).alias("_var"))


def track_score(df: DataFrame, window_col: str, weight_col: str | None,
                score_col: str = "imagen_del_candidato") -> DataFrame:
    """A1: weighted mean score per window (column ``trackeo``)."""
    s = score_sums(df, window_col, weight_col, score_col)
    return s.select(window_col, F.col("_mean").alias("trackeo"))


def n_effective(sw, sww):
    """A3: Kish effective sample size ``(sum w)^2 / sum w^2``."""
    return F.try_divide(F.pow(sw, 2), sww)


def score_intervals(df: DataFrame, window_col: str, weight_col: str | None,
                    score_col: str = "imagen_del_candidato", z: float = Z95) -> DataFrame:
    """A4/A5: weighted mean, weighted population sd, MOE = z*sd/sqrt(n_eff), bounds."""
    s = score_sums(df, window_col, weight_col, score_col)
    neff = n_effective(F.col("_sw"), F.col("_sww"))
    out = s.select(window_col, "n", F.col("_mean").alias("imagen_media"), F.sqrt("_var").alias("sd_w"),
                   neff.alias("n_eff"))
    moe = F.lit(z) * F.col("sd_w") / F.sqrt(F.col("n_eff"))
    return out.select(window_col, "n", "n_eff", "imagen_media", moe.alias("moe_95"),
                      (F.col("imagen_media") - moe).alias("li_95"),
                      (F.col("imagen_media") + moe).alias("ls_95"))


def candidates(df: DataFrame, candidate_col: str = "voto", most: int | None = None) -> list:
    """Sorted distinct non-null candidates, of which there must not be more than ``most``
    (default ``MAX_WIDE``): they become column names.  The long tables need no such list.

    A null vote never matches a candidate but its weight stays in the window total,
    as in the reference's indicator columns.
    """
    most = MAX_WIDE if most is None else most
    vals = [r[0] for r in df.select(candidate_col).filter(F.col(candidate_col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(vals) > most:
        raise ValueError(f"more than {most} candidates: use the long form")
    return sorted(vals)


def _vote_sums(df, window_col, weight_col, candidate_col, cands) -> DataFrame:
    """``(window, candidate, _wc, _sw, _sww)`` for every window and candidate, zero-filled.

    One aggregation of the rows per (window, vote), computed once; window totals and the candidate
    list are taken from it.  The zero-filled table is windows x candidates by definition, built by
    Spark from the two lists; nothing is collected."""
    w = _w(weight_col)
    votes = cut_lineage(df.groupBy(window_col, F.col(candidate_col).cast("string").alias("candidate")).agg(
        F.sum(w).alias("_wc"), F.sum(w * w).alias("_wcc")))
    totals = votes.groupBy(window_col).agg(F.sum("_wc").alias("_sw"), F.sum("_wcc").alias("_sww"))
    if cands is None:
        names = votes.agg(F.sort_array(F.collect_set("candidate"))).scalar()       # a subquery: one array
    else:
        names = F.array(*[F.lit(str(c)) for c in cands]).cast("array<string>")
    cast = votes.filter("candidate is not null").select(F.col(window_col).alias("_w"), F.col("candidate").alias("_c"), "_wc")
    grid = totals.withColumn("candidate", F.explode(names))
    return (grid.join(cast, grid[window_col].eqNullSafe(F.col("_w")) & (F.col("candidate") == F.col("_c")), "left")
                .select(window_col, "candidate", F.coalesce("_wc", F.lit(0.0)).alias("_wc"), "_sw", "_sww"))


def track_vote(df: DataFrame, window_col: str, weight_col: str | None,
               candidate_col: str = "voto", cands: list | None = None) -> DataFrame:
    """A2: weighted share x100 per window and candidate, zero for absent candidates.

    Long form ``(window, candidate, share)``; no candidate at all gives no rows.
    """
    long = _vote_sums(df, window_col, weight_col, candidate_col, cands)
    return long.select(window_col, "candidate", (F.col("_wc") / F.col("_sw") * 100.0).alias("share"))


def vote_intervals(df: DataFrame, window_col: str, weight_col: str | None,
                   candidate_col: str = "voto", cands: list | None = None, z: float = Z95) -> DataFrame:
    """P, MOE = z*sqrt(p(1-p)/n_eff), bounds; all x100 and not clamped."""
    long = _vote_sums(df, window_col, weight_col, candidate_col, cands)
    p = F.col("_wc") / F.col("_sw")
    neff = n_effective(F.col("_sw"), F.col("_sww"))
    moe = F.lit(z) * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / neff)
    return long.select(window_col, "candidate", (p * 100).alias("share"), (moe * 100).alias("moe"),
                       ((p - moe) * 100).alias("li"), ((p + moe) * 100).alias("ls"))


def vote_wide(df: DataFrame, window_col: str, weight_col: str | None, candidate_col: str = "voto",
              cands: list | None = None, prefix: str = "vota_", max_columns: int | None = None,
              others: str = "otros candidatos") -> DataFrame:
    """One column per candidate (``vota_<candidate>``), zero-filled.

    At most ``max_columns`` (default ``MAX_WIDE``) candidates get a column, those with the most
    weight (ties by name); if there are more, the others share the column ``others``.  The long
    form (``track_vote``) is the exact way for any number.  The rows are summed once by window
    and candidate; the columns are laid out from that table, not by an aggregate each."""
    w, most = _w(weight_col), MAX_WIDE if max_columns is None else max_columns
    votes = cut_lineage(df.groupBy(window_col, F.col(candidate_col).cast("string").alias("candidate")).agg(F.sum(w).alias("_wc")))
    names = cands
    if cands is None:
        ranked = (votes.filter("candidate is not null").groupBy("candidate").agg(F.sum("_wc").alias("_wc"))
                  .orderBy(F.desc("_wc"), "candidate").limit(most + 1))
        got = [r["candidate"] for r in ranked.collect()]
        names = sorted(got[:most]) + ([others] if len(got) > most else [])
        if len(got) > most and others in got[:most]:
            raise ValueError(f"a candidate is called {others!r}: name the column of the others differently")
    known = F.col("candidate").isin([str(c) for c in names])
    label = F.when(known, F.col("candidate")).when(F.col("candidate").isNotNull() & F.lit(others in names and cands is None), F.lit(others))
    laid = (votes.withColumn("_c", label).groupBy(window_col, "_c").agg(F.sum("_wc").alias("_wc"))
            .groupBy(window_col).agg(F.sum("_wc").alias("_sw"), F.map_from_entries(
                F.collect_list(F.when(F.col("_c").isNotNull(), F.struct("_c", "_wc")))).alias("_m")))      # max_columns + 1 entries
    return laid.select(window_col, *[
        (F.coalesce(F.try_element_at("_m", F.lit(str(k))), F.lit(0.0)) / F.col("_sw") * 100).alias(f"{prefix}{k}") for k in names])


def melt_wide(wide: DataFrame, id_col: str, prefix: str = "vota_",
              var_name: str = "candidate", value_name: str = "share") -> DataFrame:
    """R2: wide -> long over the columns that start with ``prefix``."""
    value_cols = [c for c in wide.columns if c.startswith(prefix)]
    return (wide.unpivot([id_col], value_cols, var_name, value_name)
                .withColumn(var_name, F.substr(F.col(var_name), F.lit(len(prefix) + 1))))
