import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def test_all_operators_and_the_pipeline_are_registered():
    q = entry.queries()
    assert all(any(k.startswith(f"op{n}_") for k in q) for n in range(1, 14)) and "pipeline" in q
    assert set(entry.oracle_sql()) <= set(q)


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{LARGER}/{t}.parquet'")
    for name in ("op5_window_dedup", "op9_maxscore", "op11_url_filter", "op12_phrases"):
        got = entry.queries()[name](spark, LARGER)
        cur = con.execute(entry.oracle_sql()[name])
        assert [d[0] for d in cur.description] == got.columns
        assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())


def test_every_query_gives_a_row_per_input_row(spark):
    rows = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, f in entry.queries().items():
        if name.split("_")[0] in ("op1", "op2", "op3", "op4", "op8"):
            assert f(spark, SF).count() == rows["documents"], name
    for name in ("op7_html_text", "op11_url_filter"):
        assert entry.queries()[name](spark, SF).count() == rows["pages"]
    white = entry.queries()["op13_whitening"](spark, SF)
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert white.count() == 8 * n and white.filter("n <> %d or identity_error > 1e-9 or explained is null" % n).isEmpty()
