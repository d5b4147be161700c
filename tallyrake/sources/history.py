"""Training history of observed cases and survey fingerprints: S16, J3, U1, A17.

The history is an append-only parquet table partitioned by ``survey_id``.  A survey
is identified by an order-independent fingerprint of its rows, computed as one
aggregation (map-side combine, no sort, no collect):

    per row  h = xxhash64(columns in sorted name order, plus one null flag each)
    survey   sha2(count || sum(h) as decimal(38,0) || bit_xor(h), 256)

The sum keeps duplicate rows from cancelling in the xor.  The value differs from the
reference's digest by design; only "same multiset of rows -> same id" matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrake.session import cut_lineage

SURVEY_ID = "survey_id"
# Columns of a survey that identify it: not the file order, nor buckets and recodes added later.
SURVEY_FIELDS = ["fecha", "encuesta", "estrato", "sexo", "edad", "nivel_educativo", "integrantes_hogar",
                 "imagen_del_candidato", "voto", "voto_anterior"]


def survey_columns(df: DataFrame) -> list[str]:
    """The survey's own columns that ``df`` has."""
    return [c for c in SURVEY_FIELDS if c in df.columns]



def row_hash(df: DataFrame, columns: list[str] | None = None):
    cols = sorted(columns or [c for c in df.columns if c != SURVEY_ID])
    parts = []
    for c in cols:
        parts += [F.col(c), F.col(c).isNull()]
    return F.xxhash64(*parts)


def fingerprint(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Fingerprint of the whole frame (one row) or of every ``by`` group."""
    h = row_hash(df, columns)
    by = by or []
    g = df.select(*by, h.alias("_h")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("_s"),
        F.bit_xor("_h").alias("_x"))
    return g.select(*by, F.sha2(F.concat_ws("|", F.col("_n").cast("string"), F.col("_s").cast("string"),
                                            F.col("_x").cast("string")), 256).alias(SURVEY_ID))


def manifest_path(path: str) -> str:
    return path.rstrip("/") + "_manifest"


def stored_surveys(spark: SparkSession, path: str) -> DataFrame:
    """``(survey_id, n_rows)`` of the surveys whose rows are stored whole; the history is not read."""
    from tallyrake.session import path_exists
    if path_exists(spark, manifest_path(path)):
        return spark.read.parquet(manifest_path(path))
    return spark.createDataFrame([], f"{SURVEY_ID} string, n_rows long")


def _commit(sizes: DataFrame, path: str) -> None:
    sizes.coalesce(1).write.mode("append").parquet(manifest_path(path))


def append_history(spark: SparkSession, path: str, batch: DataFrame) -> int:
    """S16 + U1 + J3: idempotent append of complete cases tagged with ``survey_id``.

    A survey counts as stored once its row is in the manifest, which is written after its data.
    The data are partitioned by survey and written by dynamic partition overwrite, so a job that
    died before the manifest is done over by the next one, with the same files' content.  Only
    the manifest is read, never the history.  Returns the rows appended (0 when every survey of
    the batch was already stored)."""
    batch = batch.persist()
    try:
        sizes = cut_lineage(batch.groupBy(SURVEY_ID).agg(F.count(F.lit(1)).alias("n_rows"))
                            .join(stored_surveys(spark, path).select(SURVEY_ID), SURVEY_ID, "left_anti"))
        n = sizes.agg(F.sum("n_rows")).first()[0] or 0
        if n:
            fresh = batch.join(sizes.select(SURVEY_ID), SURVEY_ID, "left_semi")
            # a few tasks per survey, not every task a file of every survey; big surveys are divided
            (fresh.hint("rebalance", SURVEY_ID).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                  .partitionBy(SURVEY_ID).parquet(path))
            _commit(sizes.select(SURVEY_ID, "n_rows"), path)
        return n
    finally:
        batch.unpersist()


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the surveys that are stored whole."""
    rows = spark.read.parquet(path)
    return rows.join(stored_surveys(spark, path).select(SURVEY_ID).distinct(), SURVEY_ID, "left_semi").select(*rows.columns)
