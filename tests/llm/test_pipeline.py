import corpus_pipeline
from tallyrake.llm.common import table
from tests.llm.test_bpe import brute as brute_bpe
from tests.llm.test_decontam import brute as brute_overlaps
from tests.llm.test_dedup import brute_windows
from tests.llm.test_near import brute as brute_groups

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_every_stage_equals_its_brute_force(spark):
    docs = table(spark, SF, "documents")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_windows",
                                                      "benchmark_overlaps", "token_counts"]
    told = stage["language_id"](spark, docs, SF).cache()
    assert told.columns == docs.columns
    gone = {i for i, _ in rows_of(docs)} - {i for i, _ in rows_of(told)}
    assert len(gone) < 0.1 * docs.count()
    assert all(not any(c.isalpha() for c in t or "") or len(t.split()) < 5 for i, t in rows_of(docs) if i in gone)

    single = stage["near_duplicates"](spark, told, SF).cache()
    want = {i for i, _, _, kept in brute_groups(rows_of(told), 80) if kept}
    assert {i for i, _ in rows_of(single)} == want and single.columns == docs.columns

    cut = stage["repeated_windows"](spark, single, SF).cache()
    before, after = dict(rows_of(single)), dict(rows_of(cut))
    for i, n, removed, digest in brute_windows(rows_of(single)):
        if not removed:
            assert after[i] == before[i]
        elif removed == n:
            assert i not in after
        else:
            import hashlib
            assert hashlib.sha256(after[i].encode()).hexdigest() == digest
    assert cut.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    clean = stage["benchmark_overlaps"](spark, cut, SF).cache()
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    bad = {d for d, *_ in brute_overlaps(rows_of(cut), items)}
    assert {i for i, _ in rows_of(clean)} == set(after) - bad

    out = stage["token_counts"](spark, clean, SF)
    assert sorted(map(tuple, out.collect())) == sorted(brute_bpe(rows_of(clean)))


def test_run_applies_all_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 20


def test_nulls_and_empty_tables(spark, tmp_dir):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", None, 0), (None, "words without an id", None, "s", 3)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            out.collect()


def test_clashing_columns_repeated_rows_and_null_ids(spark):
    """Every filtering stage, alone, on rows that used to crash it or slip through."""
    item = table(spark, SF, "benchmark").first()["text"]
    base = " ".join(f"word{i} thing{i % 7}" for i in range(60))
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(40_000))
    texts = [(1, base), (1, base), (2, base + " end"), (None, base), (None, "before " + item + " after"), (None, "before " + item + " after"),
             (3, item), (4, ""), (5, None), (6, long), (7, "tie one two three four five"), (8, "tie one two three four five"),
             (9, "the same id"), (9, "other text of this id")]
    names = ["_gone", "_bad", "_id", "_words", "_kept", "id", "row", "key", "text_hash", "kept", "n_removed", "places", "mark", "a.b", "Id2"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(names)) for i, t in texts], schema).repartition(3)
    stage = dict(corpus_pipeline.STAGES)
    got = {n: stage[n](spark, docs, SF) for n in ("language_id", "near_duplicates", "repeated_windows", "benchmark_overlaps")}
    assert all(df.columns == docs.columns for df in got.values())
    rows = {n: sorted(rows_of(df), key=str) for n, df in got.items()}
    single = rows["near_duplicates"]
    assert [i for i, _ in single] == [1, 3, 4, 5, 6, 7, 9]
    clean = rows["benchmark_overlaps"]
    assert all(item not in (t or "") for _, t in clean) and sum(t == base for _, t in clean) == 3
    assert sum(t == base for _, t in rows["repeated_windows"]) == 2 and (6, long) in rows["repeated_windows"]
    assert stage["token_counts"](spark, docs, SF).count() == len(texts)
