import duckdb

from tallyrake.llm.language import code_matrix, grams, held_out, identify, keep_identified, languages, train
from tests.llm.fixtures import frame

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = languages(docs).withColumnRenamed("id", "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in got if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(test) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in test) / len(test) > 0.97
    want = {i: bool(h) for i, h in duckdb.sql(f"select doc_id, 1 from '{SF}/documents.parquet'").fetchall()}
    assert {r["doc_id"] for r in got} == set(want)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_ids_languages_and_sources_are_no_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs.filter(~held_out("doc_id")))
    a = {r["id"]: r[1:] for r in identify(docs.limit(50), model).collect()}
    b = {r["id"]: r[1:] for r in identify(docs.limit(50).selectExpr("doc_id + 0 doc_id", "text", "'xx' lang"), model).collect()}
    assert a == b


def test_texts_without_letters_are_undetermined(spark):
    rows = [(1, None), (2, ""), (3, "123 %%% ..."), (4, "the of and"), (5, "la le un")]
    df = frame(spark, rows * 2)
    got = {r["id"]: r for r in languages(df).collect()}
    assert {got[i]["lang_pred"] for i in (1, 2, 3)} == {"und"} and got[1]["score"] == 0.0
    assert keep_identified(frame(spark, rows).limit(0)).collect() == []
    bare = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert languages(bare).first()["lang_pred"] == "und"


def test_codewords_differ():
    for n in (2, 3, 4, 5, 6, 40):
        code = code_matrix(n)
        assert len({tuple(c) for c in code}) == n
    assert len(grams("aé")) == 5 + 4 + 3 and len(grams("12")) == 0
