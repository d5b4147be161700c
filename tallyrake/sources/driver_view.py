"""Survey-shaped input over the driver tables (FIXTURES.md section 5).

This module only produces rows in the survey schema; it does none of the
cleaning, recoding, weighting or estimation (those live in ``operators``).
The mapping is fixed by FIXTURES.md and is reproduced verbatim by the DuckDB
oracle, so both engines start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Nation key -> estrato (FIXTURES.md), keys 0..24 in order.
PROVINCE_BY_NATION = [
    "buenos aires", "ciudad autónoma de buenos aires", "córdoba", "entre ríos", "la pampa",
    "santa fe", "catamarca", "jujuy", "la rioja", "salta", "santiago del estero", "tucumán",
    "chaco", "corrientes", "formosa", "misiones", "mendoza", "san juan", "san luis", "chubut",
    "neuquén", "río negro", "santa cruz", "tierra del fuego", "la matanza",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _province_map():
    pairs = []
    for k, v in enumerate(PROVINCE_BY_NATION):
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)


def _survey_columns(o: str = "o_orderkey"):
    ok = F.col(o)
    ck = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    return {
        "encuesta": ok.cast("string"),
        "fecha": F.col("o_orderdate"),
        "estrato": F.try_element_at(_province_map(), F.col("c_nationkey")),
        "sexo": (F.when(ok % 97 == 0, "otro").when(ck % 2 == 0, "femenino").otherwise("masculino")),
        "edad": (F.lit(14) + (ck * 7 + ok) % 75).cast("double"),
        "nivel_educativo": (
            F.when(seg == "AUTOMOBILE", F.when(ok % 2 == 0, "Sin estudios").otherwise(" Primario"))
            .when(seg == "BUILDING", "Secundario completo")
            .when(seg == "FURNITURE", "Terciario")
            .when(seg == "HOUSEHOLD", "Universitario")
            .when(seg == "MACHINERY", "Posgrado")),
        "integrantes_hogar": F.when(ok % 11 == 0, F.lit(None).cast("string"))
                              .otherwise((F.lit(1) + ok % 6).cast("string")),
        "imagen_del_candidato": F.when(ok % 9 == 0, F.lit(None).cast("double"))
                                 .otherwise(F.floor(F.col("o_totalprice") / 5000.0).cast("double")),
        "voto": (F.when(ok % 13 == 0, F.lit(None).cast("string"))
                 .when(F.col("o_orderstatus") == "F", "a")
                 .when(F.col("o_orderstatus") == "O", "b").otherwise("c")),
        "voto_anterior": (F.when(ok % 17 == 0, F.lit(None).cast("string"))
                          .when(F.col("o_orderpriority") == "5-LOW", "no_voto")
                          .when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "a")
                          .otherwise("b")),
    }


SURVEY_COLUMNS = ["encuesta", "fecha", "estrato", "sexo", "edad", "nivel_educativo",
                  "integrantes_hogar", "imagen_del_candidato", "voto", "voto_anterior"]


def survey_view(spark: SparkSession, sf_dir: str, order_col: str = "_ord") -> DataFrame:
    """One interview per order; ``order_col`` carries the file order (``o_orderkey``)."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    cols = _survey_columns()
    out = j.select(*[cols[k].alias(k) for k in SURVEY_COLUMNS], F.col("o_orderkey").alias(order_col))
    return out.filter(F.col("estrato").isNotNull())


#: Lines per task once they carry their interview's columns (narrow lines make large tasks by size).
LINES_PER_TASK = 250_000


def survey_with_duplicates(spark: SparkSession, sf_dir: str, order_col: str = "_ord") -> DataFrame:
    """Interviews repeated once per order line: ``encuesta = l_orderkey``,
    ``fecha = l_shipdate``, file order ``(l_orderkey, l_linenumber)``."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    li = li.repartition(max(spark.sparkContext.defaultParallelism, -(-li.count() // LINES_PER_TASK)), "l_orderkey")
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    j = (li.join(o, li.l_orderkey == o.o_orderkey, "inner")
           .join(c, F.col("o_custkey") == c.c_custkey, "inner"))
    cols = _survey_columns()
    cols["fecha"] = F.col("l_shipdate")
    cols["encuesta"] = F.col("l_orderkey").cast("string")
    out = j.select(*[cols[k].alias(k) for k in SURVEY_COLUMNS],
                   (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias(order_col))
    return out.filter(F.col("estrato").isNotNull())


def events_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table seen as a tracking input: ``fecha = ts``, score = ``value``,
    candidate = ``event_type`` (FIXTURES.md section 5 notes)."""
    return read_table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("encuesta"),
        F.col("ts").alias("fecha"),
        F.col("value").alias("imagen_del_candidato"),
        F.col("event_type").alias("voto"),
    )
