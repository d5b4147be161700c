import random

import pytest
from pyspark.sql import functions as F

from tallyrake.operators import impute as I


def survey(spark, n=300, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        sexo = rnd.choice(["femenino", "masculino"])
        edu = rnd.choice(["prim", "sec", "univ"])
        va = "a" if edu == "univ" else rnd.choice(["a", "b", "no_voto"])
        v = va if rnd.random() < 0.8 and va != "no_voto" else rnd.choice(["a", "b"])
        img = (70.0 if v == "a" else 30.0) + rnd.gauss(0, 5)
        rows.append((str(i), float(rnd.randint(16, 80)), sexo, rnd.choice(["salta", "jujuy"]), edu,
                     None if i % 7 == 0 else va, None if i % 5 == 0 else v, None if i % 4 == 0 else img))
    return spark.createDataFrame(rows, "encuesta string, edad double, sexo string, estrato string, "
                                       "nivel_educativo string, voto_anterior string, voto string, "
                                       "imagen_del_candidato double")


def test_encoding_drop_first_and_unseen(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("c", 3.0)], "sexo string, edad double")
    levels = I.dummy_levels(df, ["sexo", "edad"])
    assert levels == {"sexo": ["b", "c"]}
    st = I.encoding_stages(["sexo", "edad"], levels)
    new = spark.createDataFrame([("zzz", 5.0), (None, 6.0), ("c", 7.0)], "sexo string, edad double")
    for stage in st:
        new = stage.transform(new)
    vecs = [list(r["features"]) for r in new.collect()]
    assert vecs == [[0.0, 0.0, 5.0], [0.0, 0.0, 6.0], [0.0, 1.0, 7.0]]


def test_chain_fills_everything(spark):
    res = I.impute_survey(survey(spark))
    out = res.imputed
    assert out.filter("voto is null or voto_anterior is null or imagen_del_candidato is null").count() == 0
    mx = out.agg(F.max("imagen_del_candidato"), F.min("imagen_del_candidato")).first()
    assert mx[0] <= 100 and mx[1] >= 0
    assert res.r2_score > 0.15 and res.score_method == "regression"


def test_median_branch(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (10.0,)], "imagen_del_candidato double")
    out = I.fill_median(df, "imagen_del_candidato").collect()
    assert [r[0] for r in out] == [1.0, 3.0, 3.0, 10.0]


def test_single_class_errors(spark):
    df = survey(spark).withColumn("voto", F.when(F.col("voto").isNotNull(), F.lit("a")))
    with pytest.raises(I.ImputationError):
        I.impute_categorical(df, "voto", I.PREDICTORS["voto"])


def test_retrain_and_score(spark, tmp_dir):
    df = survey(spark)
    first = I.update_all_models(df, tmp_dir)
    assert all(v > 0 for v in first.values())
    assert all(v == 0 for v in I.update_all_models(df, tmp_dir).values())   # same survey: no growth
    scored = I.score(df.limit(20), tmp_dir).collect()
    for r in scored:
        assert sum(r["probabilidades_voto"].values()) == pytest.approx(1.0)
        assert r["voto_pred"] in ("a", "b")
        assert round(r["imagen_del_candidato_pred"], 1) == r["imagen_del_candidato_pred"]


def test_text_normalised_before_training(spark):
    df = survey(spark).withColumn("voto", F.when(F.col("voto") == "a", F.lit(" A")).otherwise(F.col("voto")))
    out = I.impute_survey(df, evaluate="none").imputed
    assert {r["voto"] for r in out.select("voto").distinct().collect()} == {"a", "b"}


def test_gate_on_used_model(spark, tmp_dir):
    df = survey(spark)
    I.update_all_models(df, tmp_dir)
    res = I.impute_survey(df, model_dir=tmp_dir, evaluate="none", gate_on="used")
    assert res.score_method == "regression"          # the stored model explains the score well
    assert I.impute_survey(df, model_dir=tmp_dir, evaluate="none").score_method == "median"


def test_split_is_the_same_under_any_partitioning(spark):
    df = survey(spark).select("encuesta", "sexo", "voto").dropna()
    sides = [tuple(sorted(r[0] for r in x.select("encuesta").collect()) for x in I.split(df.repartition(k), "voto")) for k in (1, 4, 7)]
    assert sides[0] == sides[1] == sides[2]
    train, test = (set(x) for x in sides[0])
    assert not train & test and len(train) + len(test) == df.count()
    for cls in ("a", "b"):
        ids = {r[0] for r in df.filter(F.col("voto") == cls).select("encuesta").collect()}
        assert len(ids & train) == int(0.7 * len(ids) + 0.5)


def test_split_without_ids_divides_equal_rows(spark):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)] * 7, "x string")
    train, test = I.split(df)
    assert train.count() == 12 and test.count() == 5


def test_a_predictor_with_200_000_levels_trains(spark):
    n = 200_000
    df = spark.range(2 * n).select((F.col("id") % n).cast("string").alias("estrato"), F.lit("f").alias("sexo"),
                                   F.when(F.col("id") % n % 10 < 7, "a").otherwise("b").alias("voto"), F.lit(30.0).alias("edad"))
    model = I.fit_classifier(df, ["edad", "sexo", "estrato"], "voto")
    table = I.coefficient_table(spark, model)
    assert table.filter("predictor = 'estrato' and cls = 'a'").count() == n - 1 and table.filter("predictor = 'sexo'").isEmpty()
    got = model.transform(df.filter("cast(estrato as int) < 20").distinct()).select("voto", "voto_pred").collect()
    assert len(got) == 20 and all(r["voto"] == r["voto_pred"] for r in got if r["voto"] == "a")


def counted(spark, df):
    """``df`` and a counter of the rows that are computed from its source."""
    rows = spark.sparkContext.accumulator(0)

    def count(row):
        rows.add(1)
        return row
    return spark.createDataFrame(df.rdd.map(count), df.schema), rows


def test_a_fit_reads_its_input_once(spark):
    df, rows = counted(spark, survey(spark).cache())
    rows.value = 0
    I.fit_classifier(df, I.PREDICTORS["voto"], "voto")
    assert rows.value == 300
    rows.value = 0
    I.fit_regressor(df, I.PREDICTORS[I.NUMERIC_TARGET], I.NUMERIC_TARGET)
    assert rows.value == 300


def test_the_few_tasks_of_a_fit_aggregate_nothing(spark):
    """Aggregation of every shuffle partition, one after the other, adds up in a coalesced task."""
    seen, real = [], I._fit_input
    I._fit_input = lambda a, *rest: (seen.append(a.storageLevel.useMemory), real(a, *rest))[1]
    try:
        I.fit_classifier(survey(spark), I.PREDICTORS["voto"], "voto")
        I.fit_regressor(survey(spark), I.PREDICTORS[I.NUMERIC_TARGET], I.NUMERIC_TARGET)
    finally:
        I._fit_input = real
    assert seen == [True, True]


def test_split_does_not_sort_the_survey(spark):
    train, test = I.split(survey(spark), "voto")
    for side in (train, test):
        text = side._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in text and "SortMergeJoin" not in text
    assert train.union(test).count() == 300


def test_the_score_gate_reads_the_survey_three_times(spark):
    """Once for the split's counts, once for its edge, once for the cases of both sides."""
    df, rows = counted(spark, survey(spark).cache())
    rows.value = 0
    r2 = I.score_r2(df)
    assert r2 > I.R2_GATE and rows.value == 3 * 300


def test_counted_cases_weigh_as_their_rows(spark):
    preds = I.PREDICTORS[I.NUMERIC_TARGET]
    df = survey(spark).withColumn("edad", F.lit(30.0)).withColumn(I.NUMERIC_TARGET, F.floor(F.col(I.NUMERIC_TARGET) / 20))
    cases = I.aggregate_cases(df, preds, I.NUMERIC_TARGET)
    assert cases.count() < df.dropna().count()
    again = I.aggregate_cases(cases, preds, I.NUMERIC_TARGET)
    assert sorted(again.collect(), key=repr) == sorted(cases.collect(), key=repr)
    by_row, by_case = ({r[:-2]: r[-2:] for r in I.aggregate_profiles(x, preds, I.NUMERIC_TARGET).collect()} for x in (df, cases))
    assert by_row.keys() == by_case.keys() and all(by_row[k] == pytest.approx(by_case[k]) for k in by_row)


def test_the_votes_are_counted_in_one_pass(spark, monkeypatch):
    """Both fits and the predictions come from one count of the interviews."""
    monkeypatch.setattr(I, "impute_numeric", lambda df, *a, **k: (df, "none"))
    df, rows = counted(spark, survey(spark).cache())
    rows.value = 0
    I.impute_survey(df, evaluate="none")
    assert rows.value == 300


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_votes_by_profile_are_those_of_the_row_by_row_chain(spark, limit):
    df = survey(spark)
    df = df.union(df.limit(40)).union(df.limit(5).withColumn("estrato", F.lit(None).cast("string")))
    chain = df
    for t in I.CATEGORICAL_TARGETS:
        chain = I.impute_categorical(chain, t, I.PREDICTORS[t])
    got = I.impute_votes(df, broadcast_bytes=limit)
    assert sorted(map(str, got.select(chain.columns).collect())) == sorted(map(str, chain.collect()))
    assert got.filter("_n_voto != voto or _n_voto_anterior != voto_anterior").isEmpty()


def test_a_normalised_survey_is_not_stripped_again(spark):
    out = I.impute_survey(survey(spark).cache(), evaluate="none", normalized=True).imputed
    assert "trim(" not in out._jdf.queryExecution().optimizedPlan().toString()
