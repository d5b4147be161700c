import hashlib
import re
from collections import Counter, defaultdict

import pytest

from tallyrake.llm import window_dedup
from tallyrake.llm.suffix_dedup import dedup_bytes
from tallyrake.llm.window_dedup import dedup_windows
from tests.llm.fixtures import corpus, frame


def brute_windows(rows, n=13):
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k:k + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - n + 1):
                if first[tuple(w[k:k + n])] < i:
                    gone[k:k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_bytes(rows, n=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + n] for i, b in data if i is not None for k in range(len(b) - n + 1))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        if i is not None:
            for k in range(len(b) - n + 1):
                if seen[b[k:k + n]] > 1:
                    gone[k:k + n] = [True] * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def same(df, want, cols):
    got = sorted(map(tuple, df.select(*cols).collect()), key=str)
    assert got == sorted(want, key=str)


WCOLS = ["id", "n_words", "n_removed", "kept_sha256"]
BCOLS = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("seed", [5, 6])
def test_windows_equal_brute_force(spark, seed):
    rows = corpus(seed) + [(None, corpus(seed)[2][1])]
    rows += [rows[9]]                                               # a repeated row
    same(dedup_windows(frame(spark, rows)), brute_windows(rows), WCOLS)


def test_windows_survive_a_full_sketch(spark):
    rows = corpus(9)
    same(dedup_windows(frame(spark, rows), max_cells=1 << 16), brute_windows(rows), WCOLS)


def test_windows_in_several_rounds_and_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(window_dedup, "FAN_BITS", 2)
    rows = corpus(7) + [(200, corpus(7)[2][1]), (200, "short"), (16, corpus(7)[1][1] + " more words"), (16, None)]
    same(dedup_windows(frame(spark, rows)), brute_windows(rows), WCOLS)


@pytest.mark.parametrize("seed", [5, 6])
def test_bytes_equal_brute_force(spark, seed):
    rows = [x for x in corpus(seed) if x[0] != 206] + [(None, corpus(seed)[2][1])]
    rows += [rows[9]]
    same(dedup_bytes(frame(spark, rows)), brute_bytes(rows), BCOLS)


def test_empty_tables(spark):
    none = frame(spark, corpus()).limit(0)
    assert dedup_windows(none).collect() == [] and dedup_bytes(none).collect() == []
    blank = frame(spark, [(1, None), (2, ""), (3, None)])
    assert dedup_windows(blank).count() == 3 and dedup_bytes(blank).count() == 3
