import itertools
import random

from tallyrake.llm.decontam import EQUAL, LEAST_TOKENS, MASKS, WINDOW, contaminated, drop_contaminated, overlap, seeds, tokens, too_short
from tests.llm.fixtures import frame


def brute(rows, items, least=LEAST_TOKENS):
    """All alignments of all pairs that share a seed and verify around it."""
    out = {}
    for d, text in rows:
        t = tokens(text)
        for i, item in items:
            x = tokens(item)
            if len(x) < least:
                continue
            best = None
            theirs = [dict() for _ in MASKS]
            for k, h in seeds(x):
                for p, v in enumerate(h.tolist()):
                    theirs[k].setdefault(v, []).append(p)
            for k, h in seeds(t):
                for p, v in enumerate(h.tolist()):
                    for q in theirs[k].get(v, ()):
                        lo = max(0, p - WINDOW)
                        got = overlap(x, t[lo:p + WINDOW], p - q - lo)
                        if got and (best is None or got > best):
                            best = got
            if best:
                out[d, i] = best
    return sorted((d, i, *b) for (d, i), b in out.items())


def case(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(5))
    line = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(line(r.choice([4, 6, 9, 12, 20, 40])))) for k in range(25)] + [(90, None), (91, ""), (92, "two words")]
    rows = []
    for k in range(80):
        ws = line(r.randint(0, 60))
        if k % 2:
            item = (r.choice(items[:25])[1]).split()
            cut = r.randint(0, max(0, len(item) - 18))
            item = item[cut:]
            for _ in range(r.randint(0, 4)):
                item[r.randrange(len(item))] = word()
            ws[len(ws) // 2:len(ws) // 2] = [w.upper() + r.choice(["", ",", "."]) for w in item]
        rows.append((k, " ".join(ws)))
    return rows + [(500, None), (501, ""), (502, "x")], items


def test_overlaps_equal_brute_force(spark):
    for seed in (1, 2):
        rows, items = case(seed)
        bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc string")
        got = contaminated(frame(spark, rows + rows[:3]), bench)
        assert sorted(map(tuple, got.collect())) == brute(rows, items)


def test_substitutions_are_tolerated_and_clean_texts_stay(spark):
    item = [f"word{k}" for k in range(30)]
    near = list(item)
    for k in (4, 12, 20):
        near[k] = "other"
    rows = [(1, "before " + " ".join(near) + " after"), (2, " ".join(reversed(item))), (3, " ".join(item[:10])), (4, None)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = contaminated(frame(spark, rows), bench).collect()
    assert [(r["id"], r["item"]) for r in got] == [(1, 7)] and got[0]["n_equal"] >= EQUAL
    left = drop_contaminated(frame(spark, rows), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4]
    assert contaminated(frame(spark, rows), bench.limit(0)).collect() == []
    assert contaminated(frame(spark, rows).limit(0), bench).collect() == []


def test_every_window_with_three_substitutions_has_a_seed_mostly():
    r, missed, n = random.Random(1), 0, 400
    for _ in range(n):
        t = tokens(" ".join(f"w{k}" for k in range(30)))
        u = t.copy()
        for k in r.sample(range(30), 4):
            u[k] = 0
        missed += not any((dict(seeds(t))[k][:len(h)] == h).any() for k, h in seeds(u))
    assert missed / n < 0.02


def every_alignment(rows, items):
    """All alignments of all pairs, without seeds; items under WINDOW tokens only."""
    out = {}
    for d, text in rows:
        t = tokens(text)
        for i, item in items:
            x = tokens(item)
            for shift in range(1 - len(x), len(t)):
                got = overlap(x, t, shift)
                if got and (d, i) not in out or got and got > out[d, i]:
                    out[d, i] = got
    return sorted((d, i, *b) for (d, i), b in out.items())


def test_short_items_are_found_however_they_are_altered(spark):
    items, rows = [], []
    for n in range(6, WINDOW):
        item = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for gone in itertools.combinations(range(n), n - max(6, -(-8 * n // 10))):
            rows.append((len(rows), "before " + " ".join("other" if k in gone else w for k, w in enumerate(item)) + " after"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, contaminated(frame(spark, rows), bench).collect()))
    assert len(got) == len(rows) and got == every_alignment(rows, items)


def test_items_under_six_tokens_are_found_as_they_are(spark):
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(1, 6)]
    rows = [(10 * n + k, t) for n, item in items for k, t in enumerate((
        f"before {item.upper()}, after {item}", item, f"before{item}after", "other " + " ".join(item.split()[1:])))]
    bench = spark.createDataFrame(items + [(8, "..."), (9, "")], "item_id long, text string")
    got = sorted(map(tuple, contaminated(frame(spark, rows), bench, least_tokens=1).collect()))
    assert got == [(10 * n + k, n, n, n) for n in range(1, 6) for k in (0, 1)] == every_alignment(rows, items)


def test_scripts_without_spaces_have_a_token_for_every_character(spark):
    assert len(tokens("水在多少度沸腾？答案是")) == 10 and len(tokens("カタカナ and 漢字 2024年")) == 9
    item = "中国的首都在哪里，它有多少人口？请写出答案"
    near = item.replace("首都", "首府").replace("人口", "居民")
    thai = "เมืองหลวงของประเทศไทยคือ"
    rows = [(1, "题目：" + item + "。谢谢"), (2, "题目：" + near.replace("居民", "人口") + "。谢谢"), (3, "完全不同的一句话，没有任何关系，也不重复任何内容"), (4, "x" + thai + "y"), (5, "東京はどこ")]
    bench = spark.createDataFrame([(1, item), (2, thai), (3, "東京")], "item_id long, text string")
    got = {(r["id"], r["item"]) for r in contaminated(frame(spark, rows), bench, least_tokens=2).collect()}
    assert got == {(1, 1), (2, 1), (4, 2), (5, 3)}


def test_items_of_few_tokens_are_told_not_matched(spark):
    rows = [(1, "yes, the answer is no"), (2, "one two three four five six")]
    bench = spark.createDataFrame([(1, "yes"), (2, "The"), (3, "two three four five"), (4, "one two three four five"), (5, None)],
                                  "item_id long, text string")
    assert [(r["id"], r["item"]) for r in contaminated(frame(spark, rows), bench).collect()] == [(2, 4)]
    assert sorted(map(tuple, too_short(bench).collect())) == [(1, 1), (2, 1), (3, 4), (5, 0)]
    assert drop_contaminated(frame(spark, rows), bench).count() == 1
