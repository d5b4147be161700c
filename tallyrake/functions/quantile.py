"""Exact order statistics without gathering a column into one task.

``exact_quantile`` returns the linear-interpolated quantile (the pandas / numpy default).
One route whatever the size: the values between the current smallest and largest are counted
in ``collect_limit`` equal-width buckets, the counts say which bucket holds the wanted rank,
and its own smallest and largest value are the next bounds, until both are the same value.
Each round is one pass with map-side combining; a row per bucket reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def _kth(values: DataFrame, k: int, low: float, high: float, buckets: int) -> float:
    """Value of 0-based rank ``k`` (ties counted) of the column ``x``; ``low`` and ``high`` are
    its extremes.  Every round parts them, so the rounds end."""
    while low < high:
        scale = 2.0 if math.isinf(high - low) else 1.0        # keeps the width finite
        share = (F.col("x") / scale - low / scale) / (high / scale - low / scale)
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1))
        rows = (values.filter(F.col("x").between(low, high)).groupBy(bucket.alias("b"))
                .agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("low"), F.max("x").alias("high")).collect())
        for r in sorted(rows, key=lambda r: r["b"]):
            if k < r["c"]:
                low, high = r["low"], r["high"]
                break
            k -= r["c"]
        else:
            raise ValueError("rank out of range")
    return low


def exact_quantile(df: DataFrame, col: str, p: float, collect_limit: int = BUCKETS) -> float | None:
    """Linear-interpolated ``p`` quantile of the values of ``col`` (nulls and NaN left out)."""
    x = df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    n, low, high = x.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if n == 0:
        return None
    h = (n - 1) * p
    k_lo, k_hi = math.floor(h), math.ceil(h)
    v_lo = _kth(x, k_lo, low, high, collect_limit)
    v_hi = v_lo if k_hi == k_lo else _kth(x, k_hi, low, high, collect_limit)
    return v_lo + (h - k_lo) * (v_hi - v_lo)


def exact_median(df: DataFrame, col: str, collect_limit: int = BUCKETS) -> float | None:
    return exact_quantile(df, col, 0.5, collect_limit)
