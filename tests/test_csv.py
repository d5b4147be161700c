import io
import os
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrake.sources.csv_records import csv_records, inside_after, parsed
from tallyrake.sources.survey_csv import load_survey_csv, rejected_rows

HEAD = ("Fecha,Encuesta,Estrato,Sexo,Edad,Nivel educativo,Cantidad de integrantes en el hogar,"
        "Imagen del candidato,Voto,Voto anterior")


def by_pandas(data: bytes):
    got = pd.read_csv(io.BytesIO(data), encoding="utf-8", dtype=str, keep_default_na=False)
    return [list(r) for r in got.itertuples(index=False)]


def read(spark, folder, block=None):
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows, headers = csv_records(spark, folder)
        rows = rows.orderBy("file", "block", "place").collect()
        return rows, headers.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def field(r):
    return r.choice(["", "a", "b c", 'with ""doubled"" quotes', "la\nplata", "x\r\ny", "\n\n", ",", '""', "ñandú", "1.5", '5" disk',
                     "tail\n" * 5, "z" * 90])


def line(r, width=4):
    out = []
    for _ in range(width):
        f = field(r)
        quoted = any(c in f for c in ',\n\r') or '""' in f or r.random() < 0.2 and '"' not in f
        out.append(f'"{f}"' if quoted else f)
    out[0] = out[0] or "k"                                   # an empty line would be skipped
    return ",".join(out)


def test_records_across_blocks_equal_pandas(spark, tmp_dir):
    r = random.Random(4)
    for k, end in enumerate(("\n", "\r\n")):
        folder = os.path.join(tmp_dir, str(k))
        os.mkdir(folder)
        data = ("one,two,three,four" + end + end.join(line(r) if r.random() < 0.9 else "  " for _ in range(150)) + (end if k else "")).encode()
        with open(os.path.join(folder, "f.csv"), "wb") as f:
            f.write(b"\xef\xbb\xbf" * k + data)
        want = by_pandas(data)
        for block in (None, 97, 1000):                       # many records and fields run over several blocks
            rows, headers = read(spark, folder, block)
            assert [x["fields"] + [""] * (4 - len(x["fields"])) for x in rows] == want
            assert [h["header"] for h in headers] == [["one", "two", "three", "four"]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", '"', ",", " ", "\n", "\r\n"]), max_size=40))
def test_line_states_agree_with_the_parser(parts):
    text = "k" + "".join(parts)
    inside = False
    for x in text.split("\n"):
        inside = inside_after(x, inside)
    whole = text + '"' if inside else text
    lines = [x + "\n" for x in whole.split("\n")]
    want = [list(map(str, x)) for x in pd.read_csv(io.StringIO(whole, newline=""), header=None, dtype=str, keep_default_na=False,
                                                   names=range(42)).itertuples(index=False)]
    got = parsed(lines)
    assert [x + [""] * (42 - len(x)) for x in got] == want


def test_unclosed_quotes_are_an_error(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "f.csv"), "w") as f:
        f.write('a,b\n1,"open\n2,3\n')
    with pytest.raises(ValueError, match="never closed"):
        read(spark, tmp_dir, 5)


def test_many_small_files_take_no_job_each(spark, tmp_dir):
    for i in range(300):
        with open(os.path.join(tmp_dir, f"u{i}.csv"), "w") as f:
            f.write(HEAD + f'\n2024-01-05,{i},"buenos\naires",femenino,30,Secundario,3,50,a,b\n')
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("many-files", "many files")
    try:
        got = load_survey_csv(spark, tmp_dir)
        assert got.filter("estrato = 'buenos\naires'").count() == 300
        assert len(tracker.getJobIdsForGroup("many-files")) < 20
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_survey_with_quoted_breaks_and_bad_rows(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "s.csv"), "w", newline="") as f:
        f.write(HEAD + '\r\n2024-01-05,1,"buenos\naires",femenino,30,Secundario,3,50,a,b\r\n'
                '\r\n2024-01-05,2,"la ""matanza""",masculino,31,Secundario,3,50,a\r\n'
                '2024-01-05,3,Salta,masculino,31,Secundario,3,50,a,b,c,d\r\n'
                'not a date,4,Salta,masculino,thirty,Secundario,3,50,a,b\r\n')
    good = {r["encuesta"]: r for r in load_survey_csv(spark, tmp_dir, strict=False).collect()}
    assert sorted(good) == ["1", "2"] and good["1"]["estrato"] == "buenos\naires" and good["2"]["estrato"] == 'la "matanza"'
    assert good["2"]["voto_anterior"] is None and good["1"]["voto_anterior"] == "b"
    bad = {r["encuesta"]: r["columns"] for r in rejected_rows(spark, tmp_dir).collect()}
    assert bad == {"3": ["(more fields than the header)"], "4": ["fecha", "edad"]}
    for columns in (["encuesta", "edad"], ["fecha"], ["voto"]):          # whatever is read
        with pytest.raises(Exception, match="malformed"):
            load_survey_csv(spark, tmp_dir).select(*columns).collect()
