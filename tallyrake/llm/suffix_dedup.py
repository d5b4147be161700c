"""Suffix-array dedup by distributed prefix doubling (bytes).

A string of ``LENGTH`` = 200 bytes that starts at two places is removed at both.  Positions
get ranks that stand for longer and longer prefixes, Spark sorts and groups (rank, rank at
an offset) pairs, positions whose pair is unique leave, and the threshold ends the rounds:

1. *seeds*: in the task that reads a text, the rank of every position's first 100 bytes is
   named by doubling (1, 2, 4 .. 64, 100 bytes; a name is 64 bits and the same everywhere).
2. *thinning without loss*: each 200-byte string holds 101 seeds; the smallest one (the
   leftmost of equal ones) speaks for it.  Equal strings have equal smallest seeds at the
   same distance, so neighbouring strings with one smallest seed form a run of at most 101
   starts, and runs whose seed rank is unique in the corpus hold no repeated string and go.
3. *whole runs*: the pair (seed rank, rank of all the run's bytes).  Where the pair repeats,
   every string of the run repeats; such runs are settled as one row.
4. *offset 100*: seeds with several different runs are spread to single positions, one copy
   of each different run, with pairs (rank of 100 bytes, rank of the 100 bytes after).  A
   pair seen once is unique and leaves; a pair seen again is past the threshold.

Groups are counted with map-side combining and joined back with joins that Spark may split,
so copies that hold a third of all rows do not meet in one group in steps 2 and 3; in step 4
each different run comes once.

Defined cases: null or empty texts have no bytes; texts under 200 bytes keep all; a repeated
row counts as another document, so both lose what they share; a row with a null id takes no
part and keeps all; rows of one id must be equal.
Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import release, staged

LENGTH = 200
SEED = 100
RUNS = "m long, u long, id long, lo int, n int"
U = np.uint64


def _seed_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Names of the ``length``-byte prefixes of all positions that have one."""
    x, have = tv.BYTE[data], 1
    with np.errstate(over="ignore"):
        while have < length:
            step = min(have, length - have)
            x = tv.mix(x[:len(x) - step] * U(0x9E3779B97F4A7C15) + x[step:] + U(have))
            have += step
    return x


def _leftmost_min(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, place) of the leftmost minimum of each w neighbours."""
    at, have = np.arange(len(x), dtype=np.int32), 1
    while have < w:
        step = min(have, w - have)
        a, b, k = x[:len(x) - step], x[step:], len(x) - step
        left = a <= b
        at = np.where(left, at[:k], at[step:])
        x = np.where(left, a, b)
        have += step
    return x, at


def text_runs(data: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Runs of starts with one smallest seed: (seed rank, run rank, first start, starts)."""
    if len(data) < length:
        return None
    value, at = _leftmost_min(_seed_ranks(data, seed), length - seed + 1)
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff(np.append(cut, len(at)))
    raw = data.tobytes()
    whole = np.fromiter((xxhash.xxh3_64_intdigest(raw[i:i + k + length - 1])
                         for i, k in zip(cut.tolist(), n.tolist())), U, len(cut))
    return value[cut], whole, cut, n


def _runs_of(length: int, seed: int):
    def run(batches):
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            id_np = np.asarray(ids)
            for first, off, data in tv.byte_runs(col):
                parts, who = [], []
                for r in range(len(off) - 1):
                    got = text_runs(data[off[r]:off[r + 1]], length, seed)
                    if got is not None:
                        parts.append(got)
                        who.append(np.full(len(got[0]), id_np[first + r], np.int64))
                if parts:
                    m, u, lo, n = (np.concatenate(x) for x in zip(*parts))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tv.signed(m)), pa.array(tv.signed(u)),
                         pa.array(np.concatenate(who)),
                         pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], ["m", "u", "id", "lo", "n"])
    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Per document with repeats: ``(id, spans array<struct<lo,n,b0,b1>>)``: n starts from lo,
    all of them (b0 null) or those set in the two 64-bit masks."""
    src = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
           .filter("id is not null"))
    runs = src.mapInArrow(_runs_of(length, seed), RUNS)
    # a table of its own, so that the join's shuffles are plain ones and Spark may split a hot rank
    again = staged(runs.groupBy("m").agg(F.count("*").alias("k")).filter("k > 1").select("m"), "suffix-again")
    active = staged(runs.join(again, "m", "left_semi"), "suffix-active")

    release(docs.sparkSession)
    # whole runs; shuffle joins only: the sides grow with the corpus
    kinds = staged(active.groupBy("m", "u").agg(F.count("*").alias("k"), F.min(F.struct("id", "lo", "n")).alias("at")),
                   "suffix-kinds")
    settled = active.join(kinds.filter("k > 1").select("m", "u"), ["m", "u"], "left_semi")
    several = kinds.groupBy("m").agg(F.count("*").alias("c")).filter("c > 1").select("m")
    open_runs = kinds.join(several, "m", "left_semi").select("m", "k", "at.*")

    # single positions of one copy of each different run
    wanted = open_runs.groupBy("id").agg(
        F.collect_list(F.struct("m", "k", "lo", "n")).alias("want"))
    piece = staged(src.join(wanted, "id").select("id", "body", F.explode("want").alias("w")).select(
        F.col("w.m").alias("m"), F.col("w.k").alias("k"), "id", F.col("w.lo").alias("lo"),
        F.expr(f"substring(body, w.lo + 1, w.n + {length - 1})").alias("part")), "suffix-pieces")
    release(docs.sparkSession)
    half = length - seed
    spot = (piece.repartition("m")
            .withColumn("o", F.explode(F.expr(f"sequence(0, octet_length(part) - {length})")))
            .select("m", "k", "id", "lo", "o",
                    F.expr(f"xxhash64(substring(part, o + 1, {seed}), substring(part, o + {1 + half}, {seed}))").alias("pair")))
    seen = spot.withColumn("c", F.count("*").over(Window.partitionBy("m", "pair"))).filter("c > 1 and k = 1")
    bit = F.expr("shiftleft(1L, o % 64)")
    single = seen.groupBy("id", "lo").agg(
        F.bit_or(F.when(F.col("o") < 64, bit).otherwise(F.lit(0).cast("long"))).alias("b0"),
        F.bit_or(F.when(F.col("o") >= 64, bit).otherwise(F.lit(0).cast("long"))).alias("b1"))
    null = F.lit(None).cast("long")
    every = (settled.select("id", "lo", "n", null.alias("b0"), null.alias("b1"))
             .unionByName(single.select("id", "lo", F.lit(128).alias("n"), "b0", "b1")))
    return staged(every.groupBy("id").agg(F.collect_list(F.struct("lo", "n", "b0", "b1")).alias("spans")), "suffix-spans")


def covered(size: int, spans, length: int = LENGTH) -> np.ndarray:
    """Boolean per byte: covered by a ``length``-byte string that starts at a marked place."""
    edge = np.zeros(size + 1, np.int64)
    for s in spans:
        if s["b0"] is None:
            edge[s["lo"]] += 1
            edge[min(size, s["lo"] + s["n"] - 1 + length)] -= 1
        else:
            bits = (s["b0"] & (1 << 64) - 1) | (s["b1"] & (1 << 64) - 1) << 64
            while bits:
                low = bits & -bits
                at = s["lo"] + low.bit_length() - 1
                edge[at] += 1
                edge[at + length] -= 1
                bits ^= low
    return np.cumsum(edge[:-1]) > 0


def _apply(length: int):
    def run(batches):
        for batch in batches:
            out = []
            for i, body, spans in zip(*(batch.column(c).to_pylist() for c in range(3))):
                body = body or b""
                if spans:
                    gone = covered(len(body), spans, length)
                    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(gone) else 0
                    kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
                else:
                    runs, kept = 0, body
                out.append((i, len(body), len(body) - len(kept), runs, kept, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (
                    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))],
                ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
    return run


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept binary, kept_sha256)`` per row of ``docs``."""
    spans = repeated_spans(docs, id_col, text_col, length, seed)
    release(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
    return src.join(spans, "id", "left").select("id", "body", "spans").mapInArrow(
        _apply(length), "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
