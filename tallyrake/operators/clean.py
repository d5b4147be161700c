"""Cleaning, recoding and calendar bucketing.

All steps are narrow projections/filters except the keep-first de-duplication, which is
one hash aggregation on the id with map-side combine.  That form is skew-safe: a single
id (or the null id) holding a third of the rows is reduced on every map partition
before the shuffle, unlike a ``row_number`` window that sends the whole group to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrake.functions.recode import (
    UNKNOWN_HOUSEHOLD,
    age_bin,
    education_of_normed,
    gba_zone,
    is_gba_municipality,
    norm_text,
    sex_whitelisted,
    window_label,
    window_start,
)
from tallyrake.sources.census import region_of

ORDER_COL = "_ord"


def keep_first(df: DataFrame, key: str, order_col: str = ORDER_COL) -> DataFrame:
    """Keep the first row of every ``key`` value in ``order_col`` order.

    Null keys form one group (as in the reference).  Ties on ``order_col`` are broken
    by the remaining columns in their order (so the result is deterministic).
    Implemented as
    ``groupBy(key).agg(min(struct(order, *rest)))``: partial aggregation collapses
    duplicates on the map side, so hot keys never land whole in one task.
    """
    rest = [c for c in df.columns if c not in (key, order_col)]
    packed = F.min(F.struct(F.col(order_col).alias(order_col), *[F.col(c) for c in rest])).alias("_first")
    return (df.groupBy(key).agg(packed)
              .select(*[F.col(key) if c == key else F.col(f"_first.{c}").alias(c) for c in df.columns]))


def eligible(df: DataFrame) -> DataFrame:
    """F1, F2: rows with a vote or a score, of interviewees of 16 and over."""
    return df.filter(F.col("voto").isNotNull() | F.col("imagen_del_candidato").isNotNull()).filter(F.col("edad") >= 16)


def clean_survey(df: DataFrame, order_col: str = ORDER_COL, normalize_sex_first: bool = False) -> DataFrame:
    """Cleaning: F1, F2, W1, F3, F5-F7, F4, F8 in the reference's order.

    The de-duplication runs after the vote/score and age filters and before the
    null and sex filters, exactly as in the reference; moving it would change which
    duplicate survives.  The sex whitelist matches the raw text exactly (so
    ``Femenino`` is dropped, as in the reference); ``normalize_sex_first`` trims and
    lower-cases before matching instead.
    """
    out = keep_first(eligible(df), "encuesta", order_col)                                    # F1, F2, W1
    out = out.dropna(subset=["fecha", "estrato", "nivel_educativo", "sexo", "edad"])        # F3
    out = out.withColumn("nivel_educativo", norm_text("nivel_educativo")).withColumns({      # F5
        "nivel_educativo": education_of_normed(F.col("nivel_educativo")),                    # F6, F7
        "sexo": sex_whitelisted(norm_text("sexo") if normalize_sex_first else F.col("sexo")),   # F4
    }).filter(F.col("sexo").isNotNull())
    if "integrantes_hogar" in out.columns:                                                   # F8
        out = out.withColumn("integrantes_hogar",
                             F.coalesce(F.col("integrantes_hogar").cast("string"), F.lit(UNKNOWN_HOUSEHOLD)))
    return out


def has_bsas_municipalities(df: DataFrame, population: str) -> bool:
    """only for ``buenos_aires``, does any estrato name a GBA municipality?

    A short-circuit existence probe (``isEmpty`` stops at the first match).
    """
    if population != "buenos_aires":
        return False
    return not df.filter(is_gba_municipality("estrato")).select("estrato").isEmpty()


def normalize_survey(df: DataFrame, population: str,
                     bsas_flag: bool | None = None) -> tuple[DataFrame, bool]:
    """Recoding plus the region column of the national margins.

    F9 trim+lower estrato and sexo; F10 age bins; F11/F12 GBA/interior recode when
    ``population == 'buenos_aires'`` and municipalities are present; J1 region for
    ``nacional``.  Returns ``(df, has_municipalities)``.
    """
    out = df.withColumns({
        "estrato": norm_text(F.col("estrato").cast("string")),
        "sexo": norm_text(F.col("sexo").cast("string")),
        "edad_cat": age_bin("edad"),
    })
    flag = has_bsas_municipalities(out, population) if bsas_flag is None else bsas_flag
    if flag:
        out = out.withColumn("estrato_bsas", gba_zone("estrato"))
    if population == "nacional":
        out = out.withColumn("region", region_of(F.col("estrato")))
    return out, flag


WINDOW_COLUMNS = {"day": "win_d", "week": "win_s", "month": "win_m"}


def add_windows(df: DataFrame, ts_col: str = "fecha", units=("day", "week", "month"),
                labels: bool = False) -> DataFrame:
    """Calendar buckets: bucket starts (and optional labels) for each unit.

    Day buckets are truncated to the date (the reference kept the time part).
    The reference's sort by date is an output concern and is not applied here.
    """
    cols = {}
    for u in units:
        name = WINDOW_COLUMNS[u]
        cols[name] = window_start(ts_col, u)
    out = df.withColumns(cols)
    if labels:
        out = out.withColumns({f"{WINDOW_COLUMNS[u]}_label": window_label(WINDOW_COLUMNS[u], u) for u in units})
    return out


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Percentage of nulls per column as ``(column, null_pct)``; one pass."""
    columns = columns or df.columns
    agg = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100.0).alias(c) for c in columns])
    return agg.unpivot([], columns, "column", "null_pct")

