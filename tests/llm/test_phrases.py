import random
import re
from collections import Counter

from tallyrake.llm import phrases, textvec
from tests.llm.fixtures import corpus, frame


def brute(rows, least=10, longest=3, top=2000, inside=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    drop = set()
    for p, a in cand.items():
        for i in range(1, len(p)):
            for j in range(i + 2, len(p) + 1):
                q = (p[0], *p[i:j])
                if len(q) < len(p) and 100 * a >= inside * f[q]:
                    drop.add(q)
    out = []
    for lang in n:
        rows = []
        for p, a in cand.items():
            if p[0] == lang and p not in drop:
                cuts = [(1000000 * a * a // (f[p[:k + 1]] * f[(lang, *p[k + 1:])]), k, f[p[:k + 1]], f[(lang, *p[k + 1:])])
                        for k in range(1, len(p) - 1)]
                s, _, left, right = min(cuts)
                rows.append((-s, -a, " ".join(p[1:]).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def rows_for(seed, n=150):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abñé") for _ in range(r.randint(1, 3))) for _ in range(25)]
    out = []
    for i in range(n):
        words = [r.choice(vocab[:r.choice([5, 25])]) for _ in range(r.randint(0, 60))]
        text = "".join(w + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!?", " the Whole Phrase "]) for w in words)
        out.append((r.choice(["en", "en", "de", None, "und"]), text))
    return out + [("en", None), ("en", ""), (None, " \t "), ("xx", "one"), ("de", "a b " * 4000)] + out[:7]


def found(spark, rows, **kw):
    df = spark.createDataFrame([(lang, t, 1, "clash", 2) for lang, t in rows],
                               "lang string, text string, fp int, phrase string, n int").repartition(5)
    return sorted(map(tuple, phrases.collocations(df, **kw).collect()))


def test_phrases_equal_brute_force(spark):
    rows = rows_for(1)
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, least=3, longest=4, top=20, inside=70) == brute(rows, 3, 4, 20, 70)


def test_colliding_fingerprints_and_many_rounds(spark, monkeypatch):
    rows = rows_for(2)
    want = brute(rows)
    assert found(spark, rows, fp_bits=9) == want                       # nearly every fingerprint is shared
    assert found(spark, rows, filter_bits=1 << 19, bucket_words=1 << 6) == want
    monkeypatch.setattr(phrases, "FAN_BITS", 3)                        # blocks dealt in several rounds
    assert found(spark, rows) == want


def test_bytes_of_any_script_and_case(spark):
    rows = [("en", "Ünder ÜNDER under UNDER x 日本 語 . 日本 語 " * 6)] * 3 + corpus_rows()
    assert found(spark, rows) == brute(rows)


def corpus_rows():
    return [(None if i is None or i % 5 == 0 else "xx", t) for i, t in corpus()]


def test_empty_and_repeated_rows(spark):
    assert phrases.collocations(frame(spark, corpus()).limit(0)).collect() == []
    rows = [("en", "same words here")] * 12
    assert found(spark, rows) == brute(rows) == [("en", 1, "same words here", 12, 12, 12, 36, 1000000)]


def test_blocks_survive_packing():
    import numpy as np
    r = np.random.default_rng(3)
    e = [r.integers(0, 1 << 30, 1000).astype(k) for k in phrases.KINDS]
    assert all((a == b).all() for a, b in zip(e, textvec.unpack(textvec.pack(e), phrases.KINDS)))
