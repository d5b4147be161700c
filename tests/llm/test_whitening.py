import random
from fractions import Fraction
from math import floor, isfinite

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrake.llm import whitening

INF = float("inf")
SCHEMA = "vec_id long, embedding array<double>, component string, n int"


def vectors(seed, n=400, width=24):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(width, width)) * np.linspace(2, 0.01, width)
    rows = [(i, [float(v) for v in r.normal(size=width) @ mix * 0.3 + 5], "x", 1) for i in range(n)]
    bad = [(900, None, "x", 1), (901, [], "x", 1), (902, [0.1, None], "x", 1), (903, [INF, 1.0], "x", 1),
           (904, [float("nan")], "x", 1), (905, [0.5, -0.25], "short", 1), (None, rows[3][1], "no id", 1), rows[50]]
    return rows + bad


def brute(rows, k):
    ok = [(i, v) for i, v, *_ in rows if v and all(x is not None and isfinite(x) for x in v)]
    width, n = max(len(v) for _, v in ok), len(ok)
    x = [[floor(1024 * c) + 100000 for c in v] + [100000] * (width - len(v)) for _, v in ok]
    s = [sum(c) for c in zip(*x)]
    y = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(row, s)] for row in x])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return [i for i, _ in ok], n, [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x], y @ q / np.sqrt(e), e / (y ** 2).sum() * n


def test_rows_equal_brute_force(spark):
    for seed, width in ((1, 24), (2, 3)):
        rows = vectors(seed, width=width)
        got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
        k = min(8, width)
        ids, n, deviation, z, explained = brute(rows, k)
        assert len(got) == len(ids) * k and {r["n"] for r in got} == {n}
        assert sorted((r["id"] or -1, int(r["deviation"])) for r in got if r["component"] == 1) == sorted(
            (i or -1, d) for i, d in zip(ids, deviation))
        by = {(r["id"], r["component"]): r for r in got}
        for c in range(k):
            mine = np.array([by[i, c + 1]["whitened"] for i in ids])
            sign = np.sign(mine @ z[:, c])
            assert np.abs(mine * sign - z[:, c]).max() < 1e-8
            assert abs(by[ids[0], c + 1]["explained"] / explained[c] - 1) < 1e-10
        assert max(r["identity_error"] for r in got) < 1e-9


def test_triangles_meet_in_groups(spark, monkeypatch):
    rows = vectors(5, n=200, width=6)
    df = spark.createDataFrame(rows, SCHEMA)
    want = whitening.fit(df.coalesce(1))
    monkeypatch.setattr(whitening, "FAN", 2)
    got = whitening.fit(df.repartition(17))
    assert np.allclose(got.values, want.values, rtol=1e-12) and got.centre == want.centre


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25], "x", 1) for i in range(4)], SCHEMA)
    got = whitening.whiten(same).collect()
    assert len(got) == 8 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 for r in got)
    one_way = spark.createDataFrame([(i, [0.5 * i, 0.25], "x", 1) for i in range(4)], SCHEMA)
    got = {(r["id"], r["component"]): r["whitened"] for r in whitening.whiten(one_way).collect()}
    assert got[0, 2] is None and abs(abs(got[0, 1]) - 3 / 5 ** 0.5) < 1e-12
    assert whitening.whiten(same.limit(0)).collect() == []


def test_large_counts_stay_exact():
    r = random.Random(2)
    n, x = 10 ** 9, np.array([[r.randrange(1 << 30) for _ in range(5)] for _ in range(20)])
    s = [r.randrange(n << 30) for _ in range(5)]
    got = whitening.Centre(n, s).deviations(x).to_pylist()
    assert [int(v) for v in got] == [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(1, 20), st.sampled_from(["random", "low rank", "graded", "equal", "zero rows"]))
def test_solver_against_the_symmetric_one(seed, width, kind):
    r = np.random.default_rng(seed)
    a = np.triu(r.normal(size=(width, width)))
    if kind == "low rank":
        a = np.linalg.qr(r.normal(size=(width, 2)) @ r.normal(size=(2, width)), mode="r") if width > 2 else a
        a = np.concatenate([a, np.zeros((width - len(a), width))])
    elif kind == "graded":
        a = a * 10.0 ** -np.arange(width)
    elif kind == "equal":
        a = np.linalg.qr(r.normal(size=(width, width)))[0] * 3.0
    elif kind == "zero rows":
        a[r.random(width) < 0.4] = 0
    k = min(8, width)
    values, w = whitening.principal(a, k)
    s, big = np.linalg.svd(a)[1] ** 2, max(1e-300, float((a ** 2).sum()))
    assert np.abs(values - s[:k]).max() <= 1e-13 * big
    assert np.abs(w.T @ w - np.eye(k)).max() < 1e-12
    assert np.abs(a.T @ (a @ w) - w * values).max() <= 1e-12 * big
    if kind == "random":
        assert np.abs(np.sqrt(whitening.dqds(*whitening.bidiagonal(a)[:2])) - np.sqrt(s)).max() <= 1e-13 * np.sqrt(s[0])
