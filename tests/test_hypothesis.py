import math
import random

import numpy as np
import pytest

from tallyrake.functions import special
from tallyrake.operators.hypothesis import pair_statistics
from tallyrake.operators.hypothesis import test_change as run_change_test


def brute(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    n1, n2 = len(x), len(y)
    v1, v2 = x.var(ddof=1), y.var(ddof=1)
    sp2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    tp = (x.mean() - y.mean()) / math.sqrt(sp2 * (1 / n1 + 1 / n2))
    se = v1 / n1 + v2 / n2
    tw = (x.mean() - y.mean()) / math.sqrt(se)
    dfw = se ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
    z1, z2 = np.abs(x - x.mean()), np.abs(y - y.mean())
    zb = np.concatenate([z1, z2]).mean()
    lev = (n1 + n2 - 2) * (n1 * (z1.mean() - zb) ** 2 + n2 * (z2.mean() - zb) ** 2) / (
        ((z1 - z1.mean()) ** 2).sum() + ((z2 - z2.mean()) ** 2).sum())
    u1 = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in x for b in y)
    return tp, tw, dfw, lev, u1


def frame(spark, groups):
    rows = [(w, float(v)) for w, vals in groups.items() for v in vals]
    return spark.createDataFrame(rows, "win string, x double")


def test_statistics_match_brute_force(spark):
    rnd = random.Random(7)
    groups = {"2024-01": [rnd.randint(0, 20) for _ in range(40)],
              "2024-02": [rnd.randint(3, 25) for _ in range(35)],
              "2024-03": [rnd.gauss(10, 3) for _ in range(12)]}
    df = frame(spark, groups)
    st = {(r["w1"], r["w2"]): r for r in pair_statistics(df, "win", "x", "consecutive").collect()}
    for a, b in [("2024-01", "2024-02"), ("2024-02", "2024-03")]:
        tp, tw, dfw, lev, u1 = brute(groups[a], groups[b])
        r = st[(a, b)]
        assert r["t_pooled"] == pytest.approx(tp, rel=1e-9)
        assert r["t_welch"] == pytest.approx(tw, rel=1e-9)
        assert r["df_welch"] == pytest.approx(dfw, rel=1e-9)
        assert r["levene_w"] == pytest.approx(lev, rel=1e-9)
        assert r["u1"] == pytest.approx(u1)
    fl = pair_statistics(df, "win", "x", "first_last").collect()
    assert [(r["w1"], r["w2"]) for r in fl] == [("2024-01", "2024-03")]


def test_decision_rules(spark):
    small = frame(spark, {"a": [1, 2, 3], "b": [4, 5, 6]})
    r = run_change_test(small, "win", "x").first()
    assert r["test"] == "mann_whitney" and r["statistic"] == 0.0
    assert r["p_value"] == pytest.approx(0.1)            # exact, no ties
    big = frame(spark, {"a": list(range(40)), "b": [v + 30 for v in range(40)]})
    r = run_change_test(big, "win", "x").first()
    assert r["test"] == "student" and r["reject"]


def test_special_functions():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.0733880347707, rel=1e-9)
    assert special.t_two_sided(1.959963984540054, 1e9) == pytest.approx(0.05, rel=1e-6)
    assert special.f1_sf(4.0, 10) == pytest.approx(special.t_two_sided(2.0, 10))
    assert special.mwu_counts(2, 3) == [1, 1, 2, 2, 2, 1, 1]
    assert sum(special.mwu_counts(4, 6)) == math.comb(10, 4)
    assert special.mwu_exact_two_sided(3, 4, 5) == pytest.approx(14 / 126)
    assert special.norm_sf(1.959963984540054) == pytest.approx(0.025, rel=1e-9)


def test_tails_hold_for_large_samples_and_small_probabilities():
    import math

    from tallyrake.functions import special as S
    for df in (1e8, 1e10, 1e12):
        for t in (0.01, 1.0, 3.0):
            assert abs(S.t_two_sided(t, df) / math.erfc(t / math.sqrt(2)) - 1) < 1e-5
    assert 1e-24 < S.t_two_sided(10.0, 1e6) < 2e-23
    assert S.f1_sf(4.0, 50.0) == S.t_two_sided(2.0, 50.0)


def test_exact_mann_whitney_tail_equals_the_table():
    from tallyrake.functions import special as S
    for m, n in ((1, 1), (2, 5), (3, 3), (8, 8), (8, 20)):
        counts = S.mwu_counts(m, n)
        assert all(S.mwu_tail(m, n, k) == sum(counts[k:]) for k in range(m * n + 2))
    assert 0 <= S.mwu_exact_two_sided(3e8, 8, 10 ** 8) <= 1


def test_constant_and_single_windows_have_no_statistics(spark):
    from tallyrake.operators.hypothesis import test_change
    rows = [("a", 5.0)] * 40 + [("b", 5.0)] * 40 + [("c", 1.0)] + [("d", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "win string, x double")
    got = {r["w2"]: r for r in test_change(df, "win", "x", "consecutive").collect()}
    assert set(got) == {"b", "c", "d"}
    assert got["b"]["p_value"] is None or got["b"]["p_value"] != got["b"]["p_value"]


def test_ranges_do_not_change_u_and_only_chosen_windows_are_read(spark):
    import random

    from tallyrake.operators import hypothesis as hy
    r = random.Random(3)
    rows = [(w, float(r.randrange(40))) for w in range(6) for _ in range(r.randrange(20, 60))] + [(9, None), (None, 1.0)]
    df = spark.createDataFrame(rows, "w int, x double").repartition(5)
    pairs = hy.window_pairs(hy._values(df, "w", "x"), "win", "consecutive")
    one, many = (sorted(map(tuple, hy.mann_whitney_u(df, "w", "x", pairs, n).collect())) for n in (1 << 18, 7))
    assert one == many and len(one) == 5
    by = {w: [x for v, x in rows if v == w] for w in range(6)}
    for w1, w2, u, _ in one:
        assert u == sum((a > b) + (a == b) / 2 for a in by[w1] for b in by[w2])
    ends = hy.window_pairs(hy._values(df, "w", "x"), "win")
    assert {v["win"] for v in hy.chosen_rows(df, "w", "x", ends).collect()} == {0, 5}
