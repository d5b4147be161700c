import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tallyrake.sources import census, ledger
from tallyrake.sources.history import SURVEY_ID, append_history, fingerprint, read_history
from tallyrake.sources.survey_csv import MissingColumnsError, load_survey_csv


def test_census_dimension(spark):
    assert len(census.POPULATIONS) == 32
    t = census.census_target(spark)
    assert t.count() == 360
    sums = t.groupBy("population", "variable").agg(F.sum("proportion").alias("s")).collect()
    assert all(abs(r["s"] - 1.0) < 1e-9 for r in sums)
    assert census.calibration_variables("nacional") == ["sexo", "edad_cat", "nivel_educativo", "region"]
    assert census.calibration_variables("buenos_aires", True)[-1] == "estrato_bsas"
    assert census.calibration_variables("buenos_aires", False) == census.BASE_VARIABLES
    with pytest.raises(KeyError) as e:
        census.check_population("atlantis")
    assert "nacional" in str(e.value)
    assert census.targets_for(spark, "caba").filter("level = 'pos'").first()["proportion"] == 0.053


def test_csv_load(spark, tmp_dir):
    path = os.path.join(tmp_dir, "s.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write(" Fecha ,Encuesta,Estrato,Sexo,Edad,Nivel educativo,Cantidad de integrantes en el hogar,"
                "Imagen del candidato,Voto,Voto anterior,extra\n")
        f.write("2024-01-05 10:00:00,1,Córdoba,femenino,30,Secundario,3,55.5,a,b,x\n")
        f.write("2024-01-06,2,Salta,masculino,41,Terciario,,,,no_voto,y\n")
    df = load_survey_csv(spark, path)
    rows = df.orderBy("encuesta").collect()
    assert rows[0]["fecha"] == dt.datetime(2024, 1, 5, 10, 0)
    assert rows[0]["edad"] == 30.0 and rows[0]["imagen_del_candidato"] == 55.5
    assert rows[1]["integrantes_hogar"] is None and rows[1]["voto"] is None
    assert "integrantes_hogar" in df.columns and "extra" in df.columns
    bad = os.path.join(tmp_dir, "bad.csv")
    with open(bad, "w") as f:
        f.write("fecha,encuesta\n2024-01-01,1\n")
    with pytest.raises(MissingColumnsError) as e:
        load_survey_csv(spark, bad)
    assert "estrato" in str(e.value)


def test_ledger_roundtrip(spark, tmp_dir):
    runs = spark.createDataFrame(
        [("r1", None, "nacional", 100, ["sexo"]), ("r2", None, "cordoba", 50, ["sexo"]),
         ("r3", None, "atlantis", 10, ["sexo"]), ("r4", None, "salta", 0, ["sexo"])], ledger.RUN_SCHEMA)
    rejected = ledger.append_runs(runs, tmp_dir)
    assert sorted(r["run_id"] for r in rejected.collect()) == ["r3", "r4"]
    mets = spark.createDataFrame([("r1", 1.5, 60.0, 0.6, 3.0, 0.3), ("r9", None, 1.0, 1.0, 1.0, 1.0)],
                                 ledger.METRIC_SCHEMA)
    assert ledger.append_metrics(mets, tmp_dir).count() == 1
    ledger.append_runs(runs, tmp_dir)                      # retried job: no duplicates
    runs_sorted, total = ledger.list_runs(spark, tmp_dir)
    assert total == 2 and [r["run_id"] for r in runs_sorted.collect()] == ["r2", "r1"]
    hist = {r["run_id"]: r for r in ledger.history_with_metrics(spark, tmp_dir).collect()}
    assert hist["r1"]["deff"] == 1.5 and hist["r2"]["deff"] is None


def test_fingerprint_properties(spark):
    rows = [("1", "a", 1.0), ("2", "b", None), ("2", "b", None)]
    df = spark.createDataFrame(rows, "id string, v string, x double")
    fp = fingerprint(df).first()[SURVEY_ID]
    assert fingerprint(df.orderBy(F.desc("id")).repartition(3)).first()[SURVEY_ID] == fp
    assert fingerprint(df.select("x", "v", "id")).first()[SURVEY_ID] == fp
    changed = spark.createDataFrame([("1", "a", 1.0), ("2", "b", None), ("2", "b", 0.0)], df.schema)
    assert fingerprint(changed).first()[SURVEY_ID] != fp
    dedup = spark.createDataFrame(rows[:2], df.schema)
    assert fingerprint(dedup).first()[SURVEY_ID] != fp       # duplicate rows count


def test_history_append_idempotent(spark, tmp_dir):
    path = os.path.join(tmp_dir, "hist")
    batch = spark.createDataFrame([(30.0, "f", "a", "s1"), (40.0, "m", "b", "s1")],
                                  f"edad double, sexo string, voto string, {SURVEY_ID} string")
    assert append_history(spark, path, batch) == 2
    assert append_history(spark, path, batch) == 0
    other = batch.withColumn(SURVEY_ID, F.lit("s2"))
    assert append_history(spark, path, other) == 2
    assert read_history(spark, path).count() == 4


HEAD = ["Fecha", "Encuesta", "Estrato", "Sexo", "Edad", "Nivel educativo", "Cantidad de integrantes en el hogar",
        "Imagen del candidato", "Voto", "Voto anterior"]


def write(path, head, rows):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(",".join(r) for r in [head, *rows]) + "\n")


def test_csv_files_are_read_by_their_own_headers(spark, tmp_dir):
    from tallyrake.sources.survey_csv import rejected_rows
    row = ["2024-01-05", "1", "Salta", "femenino", "30", "Secundario", "3", "NaN", "NA", "b"]
    flip = [9, 2, 3, 1, 0, 4, 5, 6, 7, 8]
    write(os.path.join(tmp_dir, "a.csv"), HEAD, [row, ["2024-01-05", "2", *row[2:]]])
    write(os.path.join(tmp_dir, "b.csv"), [HEAD[k] for k in flip], [[["2024-01-06", "3", "Jujuy", "masculino", *row[4:]][k] for k in flip]])
    got = {r["encuesta"]: r for r in load_survey_csv(spark, tmp_dir).collect()}
    assert (got["3"]["estrato"], got["3"]["sexo"], got["1"]["sexo"]) == ("Jujuy", "masculino", "femenino")
    assert got["1"]["imagen_del_candidato"] is None and got["1"]["voto"] is None
    assert [i for i, _ in sorted((r["encuesta"], r["_ord"]) for r in got.values())] == sorted(got, key=lambda i: got[i]["_ord"])
    bad = os.path.join(tmp_dir, "bad")
    os.mkdir(bad)
    write(os.path.join(bad, "c.csv"), HEAD, [["05/01/2024", *row[1:]], ["2024-01-05", "9", "Salta", "femenino", "old", *row[5:]]])
    with pytest.raises(Exception, match="malformed"):
        load_survey_csv(spark, bad).collect()
    assert load_survey_csv(spark, bad, strict=False).count() == 0
    assert sorted(r["columns"][0] for r in rejected_rows(spark, bad).collect()) == ["edad", "fecha"]
    fixed = load_survey_csv(spark, bad, strict=False, date_formats=("yyyy-MM-dd", "dd/MM/yyyy")).collect()
    assert [r["fecha"] for r in fixed] == [dt.datetime(2024, 1, 5)]


def test_a_survey_loaded_twice_in_another_order_is_one_survey(spark, tmp_dir):
    from tallyrake.sources.history import survey_columns
    rows = [["2024-01-05", str(i), "Salta", "femenino", str(20 + i), "Secundario", "3", "50", "a", "b"] for i in range(9)]
    for name, order in (("x", rows), ("y", rows[::-1])):
        os.mkdir(os.path.join(tmp_dir, name))
        write(os.path.join(tmp_dir, name, "s.csv"), HEAD, order)
    x, y = (load_survey_csv(spark, os.path.join(tmp_dir, n)) for n in "xy")
    assert fingerprint(x, survey_columns(x)).first() == fingerprint(y, survey_columns(y)).first()


def test_a_half_written_survey_is_completed(spark, tmp_dir):
    path = os.path.join(tmp_dir, "hist")
    whole = spark.createDataFrame([(1.0, "s1"), (2.0, "s1"), (3.0, "s1")], f"edad double, {SURVEY_ID} string")
    whole.limit(1).write.partitionBy(SURVEY_ID).parquet(path)
    assert append_history(spark, path, whole) == 3 and read_history(spark, path).count() == 3


def test_a_job_killed_before_the_manifest_is_done_over(spark, tmp_dir, monkeypatch):
    from tallyrake.sources import history
    path = os.path.join(tmp_dir, "hist")
    one, two = (spark.createDataFrame([(float(i), s) for i in range(5)], f"edad double, {SURVEY_ID} string") for s in ("s1", "s2"))
    assert append_history(spark, path, one) == 5
    real = history._commit

    def killed(*_):
        raise KeyboardInterrupt
    monkeypatch.setattr(history, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        append_history(spark, path, two)
    assert read_history(spark, path).count() == 5                   # what is not committed does not show
    monkeypatch.setattr(history, "_commit", real)
    assert append_history(spark, path, two.union(one)) == 5 and append_history(spark, path, two) == 0
    assert read_history(spark, path).groupBy(SURVEY_ID).count().filter("count = 5").count() == 2
    assert all("_manifest" in f for f in history.stored_surveys(spark, path).inputFiles())


def test_text_is_stripped_of_all_white_space(spark):
    from tallyrake.functions.recode import norm_text
    df = spark.createDataFrame([("\tSecundario \n",), ("\u00a0A b\u3000",), (None,)], "x string")
    assert [r[0] for r in df.select(norm_text("x")).collect()] == ["secundario", "a b", None]


def test_history_files_by_survey_not_by_task(spark, tmp_dir):
    """A survey's rows are brought together before the write: no file of every survey from every task."""
    import glob
    rows = [(float(i), f"s{i % 5}") for i in range(400)]
    batch = spark.createDataFrame(rows, f"edad double, {SURVEY_ID} string").repartition(8)
    path = f"{tmp_dir}/by-survey"
    assert append_history(spark, path, batch) == 400
    assert len(glob.glob(f"{path}/*/*.parquet")) == 5 and read_history(spark, path).count() == 400
