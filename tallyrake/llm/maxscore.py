"""Exact top-k search by MaxScore over sharded postings.

Vectors are turned into integer terms: component d of x is floor(256 * x), and a score is the
integer inner product.  Candidates are dealt into shards by a hash of their id, queries into
blocks; a task gets one shard and one block, so its memory is bounded by their sizes.  In it:

* a term's postings are its column of the shard, its bound for a query is the largest
  contribution that any posting can make (at least 0: absent or opposing ones make none);
* with the k-th best score so far as threshold, a query's terms are ordered by bound and split:
  those whose bounds together stay below the threshold are non-essential, as no vector can
  reach it by them alone;
* essential postings are traversed into accumulators, and vectors whose accumulator plus all
  non-essential bounds stays below the threshold leave; the others are probed in the
  non-essential postings, the largest bounds first, as long as they are competitive;
* the shard's best k go to a merge over the shards of each query.

Ties go to the smaller id.  Queries and candidates meet in blocks, the stated query set
against all rows; no product of single rows is made.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no
part; shorter vectors count as 0 in the missing components; a repeated row is a candidate
of its own for others but a row with the query's id is never its candidate; null ids take no
part.  Components are taken as exact 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 1 << 14
BLOCK_ROWS = 1 << 11
FIRST = 1024
STEP = 8


def terms(column: str) -> Column:
    """floor(256 * x) of every component; null where a component is null or not finite."""
    return F.when(
        (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
        F.transform(column, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")))


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for i, v in enumerate(rows):
        out[i, :len(v)] = v
    return out


def _exact(a: np.ndarray, b: np.ndarray):
    """A type in which inner products of a's and b's rows are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.float64 if most < 2 ** 52 else object if most > 2 ** 62 else np.int64


def search_shard(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int):
    """(query place, candidate place, score) of each query's best k in the shard."""
    order = np.argsort(x_ids, kind="stable")
    x, x_ids = x[order], x_ids[order]
    kind = _exact(x, q)
    post = np.ascontiguousarray(x.T).astype(kind)            # one row of postings per term
    high, low = post.max(axis=1), post.min(axis=1)
    first = post[:, :FIRST]
    for i in range(len(q)):
        v = q[i].astype(kind)
        bound = np.maximum(np.maximum(v * high, v * low), 0)
        by_bound = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[by_bound][::-1])[::-1], 0)      # bounds of this term and all after
        seen = (v @ first)[x_ids[:FIRST] != q_ids[i]]
        floor = np.partition(seen, len(seen) - k)[len(seen) - k] if len(seen) >= k else None
        split = len(v) if floor is None else int(np.searchsorted(-rest, -floor, "right"))
        split = min(split, len(v))                           # rest[split] < floor: non-essential from here
        alive = np.flatnonzero(x_ids != q_ids[i])
        essential = by_bound[:split]
        score = (v[essential] @ post[essential])[alive] if split else np.zeros(len(alive), kind)
        at = split
        while True:
            if floor is not None:
                stay = score + rest[at] >= floor
                alive, score = alive[stay], score[stay]
            if at >= len(v):
                break
            probe = by_bound[at:at + STEP]
            score = score + v[probe] @ post[np.ix_(probe, alive)]
            at += STEP if at + STEP < len(v) else len(v) - at
        best = np.lexsort((alive, -score))[:k] if kind is not object else np.array(
            sorted(range(len(alive)), key=lambda j: (-score[j], alive[j]))[:k], int)
        for j in best:
            yield i, int(order[alive[j]]), int(score[j])


def _search(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            dims = int(max(queries["terms"].map(len).max(), rows["terms"].map(len).max()))
            q_ids, x_ids = queries["id"].to_numpy(), rows["id"].to_numpy()
            for i, j, s in search_shard(_matrix(queries["terms"], dims), q_ids, _matrix(rows["terms"], dims), x_ids, k):
                out.append((q_ids[i], x_ids[j], s))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
          shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best among all rows but its own."""
    rows = (vectors.withColumn("_is_query", is_query)
            .select(F.col(id_col).cast("long").alias("id"), terms(vec_col).alias("terms"), "_is_query")
            .filter("id is not null and terms is not null"))
    n, asked = rows.agg(F.count("*"), F.count_if("_is_query")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // block_rows))
    span = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = (rows.filter("_is_query").select("id", "terms").dropDuplicates(["id"])
               .withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
               .withColumn("shard", span(shards)))
    deal = F.pmod(F.xxhash64("id", "terms"), F.lit(shards)).cast("int")
    spread = rows.select("id", "terms", deal.alias("shard")).withColumn("block", span(blocks))
    found = (queries.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block"))
             .applyInPandas(_search(k), "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
