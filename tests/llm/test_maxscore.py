import math
import random

from pyspark.sql import functions as F

from tallyrake.llm.maxscore import top_k

INF = float("inf")


def brute(rows, every, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, done = [], set()
    for i, q in ok:
        if i % every == 0 and i not in done:
            done.add(i)
            best = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in ok if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def vectors(seed, n=300, dims=16, scale=1.0):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.2) * scale for _ in range(dims)], "x") for i in range(n)]
    rows += [(n + i, list(rows[i * 7 % n][1]), "copy") for i in range(20)]                        # ties
    return rows + [(900, None, "x"), (950, [], "x"), (1000, [0.1, None], "x"), (1050, [INF, 1.0], "x"),
                   (1100, [float("nan")], "x"), (1150, [0.5, -0.25], "short"), (1200, [0.0] * dims, "zero"), rows[50]]


SCHEMA = "vec_id long, embedding array<double>, terms string"


def test_best_equal_brute_force(spark):
    for seed, sizes in ((1, {}), (2, {"shard_rows": 40, "block_rows": 3})):
        rows = vectors(seed)
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        got = sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0, 5, **sizes).collect()))
        assert got == brute(rows, 50, 5)


def test_large_components_stay_exact(spark):
    rows = vectors(3, n=60, scale=3e5)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 10 == 0, 4).collect())) == brute(rows, 10, 4)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0], "x"), (1, [2.0], "x")], SCHEMA)
    assert list(map(tuple, top_k(df, F.col("vec_id") % 50 == 0, 5).collect())) == [(0, 1, 1, 256 * 512)]
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).collect() == []
