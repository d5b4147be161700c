"""Property-based tests (hypothesis) on the pure kernels used inside Spark tasks."""

import math

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrake.functions import special
from tallyrake.operators.rake import _WIN, _ipf_numpy, _ipf_partition_fn, _lv

TGT = {"sexo": {"f": 0.52, "m": 0.48}, "edad_cat": {"a": 0.3, "b": 0.45, "c": 0.25}}
CELLS = [(s, e) for s in ("f", "m") for e in ("a", "b", "c")]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(min_value=1, max_value=500), min_size=6, max_size=6), min_size=1, max_size=5))
def test_vectorised_ipf_matches_definition_and_margins(counts):
    rows = [(w, s, e, n, "ok") for w, ns in enumerate(counts) for (s, e), n in zip(CELLS, ns)]
    pdf = pd.DataFrame(rows, columns=[_WIN, _lv("sexo"), _lv("edad_cat"), "n", "status"])
    out = next(_ipf_partition_fn(["sexo", "edad_cat"], TGT, 2000, 1e-10)(iter([pdf])))
    for w in range(len(counts)):
        sub = pdf[pdf[_WIN] == w]
        n = sub["n"].to_numpy(float)
        codes = [sub[_lv("edad_cat")].map({"a": 0, "b": 1, "c": 2}).to_numpy(),
                 sub[_lv("sexo")].map({"f": 0, "m": 1}).to_numpy()]
        ref, _, conv = _ipf_numpy(n, codes, [np.array([0.3, 0.45, 0.25]), np.array([0.52, 0.48])], 2000, 1e-10)
        got = out[out[_WIN] == w]["w_raw"].to_numpy() * n
        assert conv and np.allclose(got, ref, rtol=1e-9)
        tot = got.sum()
        f_share = got[[i for i, (s, _) in enumerate(CELLS) if s == "f"]].sum() / tot
        assert abs(f_share - 0.52) < 1e-8
        assert (got > 0).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(min_value=1, max_value=8), st.integers(min_value=1, max_value=30))
def test_mann_whitney_distribution(m, n):
    c = special.mwu_counts(m, n)
    assert len(c) == m * n + 1
    assert sum(c) == math.comb(m + n, m)
    assert c == c[::-1]                      # symmetric around m*n/2
    assert all(x > 0 for x in c)


@settings(max_examples=60, deadline=None)
@given(st.floats(min_value=0.0, max_value=20.0), st.floats(min_value=1.0, max_value=500.0))
def test_t_tail_is_a_probability_and_decreasing(t, df):
    p = special.t_two_sided(t, df)
    assert 0.0 <= p <= 1.0
    assert special.t_two_sided(t + 0.5, df) <= p + 1e-12
