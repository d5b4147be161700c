import random
import re
import string

import pytest

from tallyrake.llm.near_dedup import keep_one, near_duplicates, samples, shingle_set
from tallyrake.llm import textvec as tv
from tests.llm.fixtures import corpus, frame

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    n = min(n, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def brute(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    group = {i: i for i, _ in sets if i is not None}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i
    known = [(i, s) for i, s in sets if i is not None and s]
    for x, (i, a) in enumerate(known):
        for j, b in known[x + 1:]:
            if 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((top(i), top(j)))
                group[q] = p
    return [(i, len(s), None if i is None else top(i), i is None or top(i) == i) for i, s in sets]


def near_corpus(seed):
    """Groups of edited copies around the threshold, chained copies, copies of short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    out, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(r.choice([8, 40, 150, 600]))]
        for _ in range(r.randint(1, 8)):
            ws = list(base)
            for _ in range(r.randint(0, max(1, len(ws) // 60))):
                ws[r.randrange(len(ws))] = word()
            out.append((i, r.choice([" ", "\n"]).join(ws)))
            i += 1
            if r.random() < 0.3:
                base = ws
    return out


COLS = ["id", "n_shingles", "component_id", "kept"]


@pytest.mark.parametrize("seed,percent", [(1, 85), (2, 80), (3, 85)])
def test_groups_equal_brute_force(spark, seed, percent):
    rows = near_corpus(seed) + [(5000 + (i or 0), t) for i, t in corpus(seed) if i != 206]
    rows += [(None, rows[3][1]), rows[4]]
    got = near_duplicates(frame(spark, rows), percent=percent)
    assert sorted(map(tuple, got.select(*COLS).collect()), key=str) == sorted(brute(rows, percent), key=str)


def test_one_of_each_group_stays(spark):
    rows = near_corpus(7)
    want = sorted(i for i, _, _, kept in brute(rows, 80) if kept)
    kept = keep_one(frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert kept.columns == ["doc_id", "text", "lang", "id", "body", "n"]


def test_empty_and_blank(spark):
    none = frame(spark, near_corpus(1)).limit(0)
    assert near_duplicates(none).collect() == []
    got = near_duplicates(frame(spark, [(1, None), (2, ""), (3, " "), (4, "A b"), (5, "a B")])).collect()
    assert sorted(map(tuple, (r[:4] for r in got))) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True),
                                                       (4, 1, 4, True), (5, 1, 4, False)]


def test_samples_agree_like_jaccard():
    a, b = tv.stream(1, 2000), tv.stream(1, 2200)[200:]
    j = 1800 / 2200
    share = (samples(shingle_set(a, 1)) == samples(shingle_set(b, 1))).mean()
    assert abs(share - j) < 0.08
