import datetime as dt

from pyspark.sql import functions as F

from tallyrake.operators.clean import add_windows, clean_survey, keep_first, normalize_survey, null_profile

SCHEMA = ("encuesta string, fecha timestamp_ntz, estrato string, sexo string, edad double, "
          "nivel_educativo string, integrantes_hogar string, imagen_del_candidato double, voto string, "
          "voto_anterior string, _ord long")
D = dt.datetime(2024, 1, 3, 10, 30)


def row(i, **kw):
    base = dict(encuesta=None if i is None else str(i), fecha=D, estrato="Córdoba ", sexo="femenino", edad=30.0,
                nivel_educativo="Secundario", integrantes_hogar="3", imagen_del_candidato=50.0, voto="a",
                voto_anterior="b", _ord=i)
    base.update(kw)
    return tuple(base[k] for k in ["encuesta", "fecha", "estrato", "sexo", "edad", "nivel_educativo",
                                   "integrantes_hogar", "imagen_del_candidato", "voto", "voto_anterior", "_ord"])


def test_filters_and_recodes(spark):
    rows = [
        row(1, edad=15.0), row(2, edad=16.0), row(3, edad=29.0), row(4, edad=29.5), row(5, edad=30.0),
        row(6, edad=59.0), row(7, edad=60.0), row(8, edad=120.0), row(9, edad=121.0),
        row(10, sexo="Femenino"), row(11, sexo=" femenino"), row(12, sexo="otro"),
        row(13, voto=None, imagen_del_candidato=None),              # both null -> dropped
        row(14, voto=None),                                         # score present -> kept
        row(15, nivel_educativo="Sin estudios"), row(16, nivel_educativo=" Primario incompleto"),
        row(17, nivel_educativo="UNIVERSITARIO"), row(18, nivel_educativo="posgrado"),
        row(19, nivel_educativo="otro nivel"), row(20, integrantes_hogar=None),
        row(21, estrato=None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["encuesta"]: r for r in clean_survey(df).collect()}
    assert "1" not in out and "2" in out                      # age >= 16
    assert "10" not in out and "11" not in out and "12" not in out   # strict sex whitelist (D4)
    assert "13" not in out and "14" in out
    assert "21" not in out                                    # null estrato
    assert out["15"]["nivel_educativo"] == "prim"
    assert out["16"]["nivel_educativo"] == "prim"
    assert out["17"]["nivel_educativo"] == "univ"
    assert out["18"]["nivel_educativo"] == "pos"
    assert out["19"]["nivel_educativo"] == "otro nivel"
    assert out["20"]["integrantes_hogar"] == "Desconocido"
    normed, flag = normalize_survey(clean_survey(df), "cordoba")
    cats = {r["encuesta"]: r["edad_cat"] for r in normed.collect()}
    assert not flag
    assert cats["2"] == "16-29" and cats["3"] == "16-29" and cats["4"] == "30-44" and cats["5"] == "30-44"
    assert cats["6"] == "45-59" and cats["7"] == "60+" and cats["8"] == "60+" and cats["9"] is None
    assert {r["estrato"] for r in normed.collect()} == {"córdoba"}


def test_keep_first_in_file_order_and_null_ids(spark):
    rows = [row(5, _ord=9, voto="late"), row(5, _ord=2, voto="early"),
            row(None, _ord=7, voto="n2"), row(None, _ord=3, voto="n1"), row(6, _ord=1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = keep_first(df, "encuesta", "_ord").collect()
    by = {r["encuesta"]: r["voto"] for r in out}
    assert len(out) == 3
    assert by["5"] == "early" and by[None] == "n1"


def test_dedup_runs_before_sex_filter(spark):
    # the first copy has an invalid sex: it wins the de-duplication, then is dropped
    rows = [row(7, _ord=1, sexo="X"), row(7, _ord=2)]
    assert clean_survey(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_bsas_recode_and_region(spark):
    rows = [row(1, estrato="La Matanza"), row(2, estrato="buenos aires"), row(3, estrato="Tigre "),
            row(4, estrato="mendoza")]
    df = clean_survey(spark.createDataFrame(rows, SCHEMA))
    normed, flag = normalize_survey(df, "buenos_aires")
    assert flag
    z = {r["encuesta"]: r["estrato_bsas"] for r in normed.collect()}
    assert z == {"1": "gba", "2": "interior", "3": "gba", "4": "interior"}
    nac, flag2 = normalize_survey(df, "nacional")
    reg = {r["encuesta"]: r["region"] for r in nac.collect()}
    assert not flag2 and reg["1"] is None and reg["2"] == "Región Metropolitana" and reg["4"] == "Región Cuyo"


def test_windows(spark):
    rows = [row(1, fecha=dt.datetime(2024, 1, 3, 10)), row(2, fecha=dt.datetime(2024, 1, 7, 23)),
            row(3, fecha=dt.datetime(2024, 1, 8, 0))]
    w = add_windows(spark.createDataFrame(rows, SCHEMA), labels=True).orderBy("encuesta").collect()
    assert w[0]["win_d"] == dt.date(2024, 1, 3)
    assert w[0]["win_s"] == dt.date(2024, 1, 1) and w[1]["win_s"] == dt.date(2024, 1, 1)
    assert w[2]["win_s"] == dt.date(2024, 1, 8)
    assert w[0]["win_s_label"] == "2024-01-01/2024-01-07" and w[0]["win_m_label"] == "2024-01"


def test_null_profile(spark):
    rows = [row(1, voto=None), row(2), row(3, voto=None), row(4)]
    prof = {r["column"]: r["null_pct"] for r in null_profile(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert prof["voto"] == 50.0 and prof["edad"] == 0.0
    assert F is not None


def test_sex_normalised_first_option(spark):
    rows = [row(1, sexo="Femenino"), row(2, sexo=" masculino "), row(3, sexo="otro")]
    out = clean_survey(spark.createDataFrame(rows, SCHEMA), normalize_sex_first=True)
    assert sorted(r["sexo"] for r in out.collect()) == ["femenino", "masculino"]


def test_strip_is_no_pattern_and_takes_every_white_space(spark):
    from tallyrake.functions.recode import norm_text, strip_text
    spaces = [chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]
    texts = ["", "a", "a b", "ñandú", "é", "​a", "a​", "\x7fa", "x" * 40, None, *spaces,
             *[f"{s}a {s}é{s}" for s in spaces], *[f"{s}{s}ab" for s in spaces], *[f"ab\n{s}" for s in spaces]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip_text(F.col("t")).alias("s"))
    assert all(r["s"] == (None if r["t"] is None else r["t"].strip("".join(spaces))) for r in df.collect())
    plan = df.select(norm_text("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower()          # tried at every position of every text, in every pass
