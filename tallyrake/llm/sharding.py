"""Sharding by sampled splitters (law ``bytes``: shard sizes near equal).

Rows are ordered by (hash of the text, id), so equal texts lie side by side.

1. *Sample*: rows are drawn with a chance in proportion to their size, by a hash of the row
   (the draw is the same on every run), about ``SAMPLE`` keys for each range.
2. *Splitters*: quantiles of the size-weighted sample cut the key space into ranges, and every
   row finds its range by binary search.
3. *Subdividing*: the ranges' true sizes are summed; a range over twice the target is sampled
   again and cut again (the id is part of the key, so a group of equal texts can be cut too),
   until none is overfull or holds a single row.
4. *Shards*: ranges are ordered; a running sum of bytes inside each range plus the bytes of all
   ranges before gives every row its place in the whole, and the place times the number of
   shards over the total gives the shard.  So a shard differs from the mean by less than the
   largest row.  Slots are gapless: the row's place in the order less its shard's first place.

What reaches the driver is the sample and one row per range: bounded by ``MAX_RANGES``.

Defined cases: null text counts as empty (16 bytes of overhead); null ids come before others;
repeated rows are sharded one by one, ties cut by a running number of equal keys within a
range; an empty table gives no rows.  Only the id and text columns are read; ``extra`` names
columns to carry along.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

OVERHEAD = 16
SAMPLE = 24
MAX_RANGES = 4096
ROUNDS = 8


def _range_finder(splitters: list[tuple]):
    """Row keys to range numbers; splitters are sorted (hash, id) pairs."""
    hi = np.array([s[0] for s in splitters], np.int64)
    lo = np.array([s[1] for s in splitters], np.int64)

    @F.pandas_udf("int")
    def find(h: pd.Series, i: pd.Series) -> pd.Series:
        h, i = h.to_numpy(np.int64), i.to_numpy(np.int64)
        left, right = np.searchsorted(hi, h, "left"), np.searchsorted(hi, h, "right")
        out = left.astype(np.int32)
        for k in np.flatnonzero(left < right):          # the hash is a splitter's: the id decides
            out[k] = left[k] + np.searchsorted(lo[left[k]:right[k]], i[k], "right")
        return pd.Series(out)
    return find


def _draw(rows: DataFrame, per_byte, salt: int) -> list[tuple]:
    """Keys drawn with a chance of ``per_byte`` times the row's size (a column or number)."""
    chance = F.least(F.lit(1.0), F.col("size") * per_byte)
    dice = F.pmod(F.xxhash64("h", "id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    return sorted((r[0], r[1]) for r in rows.filter(dice < chance).select("h", "id").distinct().collect())


def _quantiles(keys: list[tuple], parts: int) -> list[tuple]:
    if not keys or parts < 2:
        return []
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)})


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                   extra: tuple[str, ...] = ()) -> DataFrame:
    """``(id, size, text_crc32, shard, slot, *extra)``: one row per row of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = staged(docs.select(F.col(id_col).cast("long").alias("doc"),
                              F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"),
                              (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
                              F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"),
                              *[F.col(c).alias(f"x_{c}") for c in extra]), "shard-rows")
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    if not count:
        return rows.select(F.col("doc").alias("id"), "size", "text_crc32", F.lit(0).alias("shard"),
                           F.lit(0).cast("long").alias("slot"), *[F.col(f"x_{c}").alias(c) for c in extra])
    ranges = int(min(MAX_RANGES, max(4 * shards, total // (256 << 20)), count))
    target = total / ranges
    splitters = _quantiles(_draw(rows, SAMPLE * ranges / total, 0), ranges)
    for turn in range(1, ROUNDS + 1):
        placed = rows.withColumn("range", _range_finder(splitters)("h", "id"))
        sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        over = {r["range"]: r["bytes"] for r in sums if r["bytes"] > 2 * target and r["rows"] > 1}
        if not over or turn == ROUNDS:
            break
        again = placed.filter(F.col("range").isin(list(over)))
        new = set(splitters)
        drawn = _draw(again, SAMPLE / target, turn)
        for r, size in over.items():
            low = splitters[r - 1] if r else None
            high = splitters[r] if r < len(splitters) else None
            a = 0 if low is None else bisect.bisect_left(drawn, low)
            b = len(drawn) if high is None else bisect.bisect_left(drawn, high)
            new |= set(_quantiles(drawn[a:b], int(-(-size // target))))
        if new == set(splitters):
            break                                        # only rows with one key are left together
        splitters = sorted(new)
    base_bytes, base_rows, at_bytes, at_rows = {}, {}, 0, 0
    for r in sorted(sums, key=lambda r: r["range"]):
        base_bytes[r["range"]], base_rows[r["range"]] = at_bytes, at_rows
        at_bytes, at_rows = at_bytes + r["bytes"], at_rows + r["rows"]
    spark = docs.sparkSession
    bases = F.broadcast(spark.createDataFrame(                       # one row per range: bounded
        [(k, base_bytes[k], base_rows[k]) for k in base_bytes], "range int, before_bytes long, before_rows long"))
    inside = Window.partitionBy("range").orderBy("h", "id")
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    ordered = (placed.join(bases, "range")
               .withColumn("place", F.col("before_rows") + F.row_number().over(inside) - 1)
               .withColumn("before", F.col("before_bytes") + F.coalesce(F.sum("size").over(so_far), F.lit(0))))
    # a row belongs to the shard in which its middle byte lies
    middle = F.col("before").cast("decimal(30,0)") * 2 + F.col("size")
    sharded = staged(ordered.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * F.lit(total).cast("decimal(20,0)")))).cast("int")),
                     "shard-placed")
    firsts = F.broadcast(sharded.groupBy("shard").agg(F.min("place").alias("first")))   # one row per shard
    return sharded.join(firsts, "shard").select(
        F.col("doc").alias("id"), "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"),
        *[F.col(f"x_{c}").alias(c) for c in extra])
