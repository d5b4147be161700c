"""Run ledger: S10-S15, J7, O3.

The reference keeps two tables in a database (``corridas``, ``metricas``) behind an
HTTP API.  Here they are two append-only parquet tables under one ledger folder
(``<ledger>/run`` and ``<ledger>/run_metric``), written with ``mode("append")``;
the run id is supplied by the caller (no single-node sequence).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrake.sources.census import POPULATIONS

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("run_ts", T.TimestampType(), True),
    T.StructField("population", T.StringType(), True),
    T.StructField("n_rows", T.LongType(), True),
    T.StructField("calib_vars", T.ArrayType(T.StringType()), True),
])
METRIC_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("deff", T.DoubleType(), True),
    T.StructField("ess", T.DoubleType(), True),
    T.StructField("essp", T.DoubleType(), True),
    T.StructField("w_max", T.DoubleType(), True),
    T.StructField("w_min", T.DoubleType(), True),
])


def _p(ledger: str, table: str) -> str:
    return f"{ledger.rstrip('/')}/{table}"


def validate_runs(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Population in the catalog (anti-join with the 32-row catalog, broadcast)
    and ``n_rows > 0``.  Returns ``(valid, rejected)``; rejected rows carry a reason."""
    spark = runs.sparkSession
    cat = F.broadcast(spark.createDataFrame([(k,) for k in POPULATIONS], "population string"))
    unknown = runs.join(cat, "population", "left_anti").withColumn("reason", F.lit("unknown population"))
    known = runs.join(cat, "population", "left_semi")
    bad_n = known.filter(~(F.col("n_rows") > 0)).withColumn("reason", F.lit("n_rows must be positive"))
    valid = known.filter(F.col("n_rows") > 0)
    return valid, unknown.unionByName(bad_n)


def validate_metrics(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metric fields must be numbers (not null / NaN)."""
    cols = ["deff", "ess", "essp", "w_max", "w_min"]
    ok = None
    for c in cols:
        cond = F.col(c).isNotNull() & ~F.isnan(c)
        ok = cond if ok is None else ok & cond
    return metrics.filter(ok), metrics.filter(~ok).withColumn("reason", F.lit("non-numeric metric"))


def _new_only(spark: SparkSession, rows: DataFrame, path: str, schema) -> DataFrame:
    """Idempotent append: rows whose run id is already stored are skipped, so a
    retried job (e.g. after an executor loss) never duplicates ledger rows."""
    from tallyrake.session import path_exists
    if not path_exists(spark, path):
        return rows
    stored = spark.read.schema(schema).parquet(path).select("run_id").distinct()
    return rows.join(stored, "run_id", "left_anti")


def append_runs(runs: DataFrame, ledger: str) -> DataFrame:
    """Validate and append run records; returns the rejected rows."""
    valid, rejected = validate_runs(runs.select(*[f.name for f in RUN_SCHEMA.fields]))
    path = _p(ledger, "run")
    _new_only(runs.sparkSession, valid, path, RUN_SCHEMA).write.mode("append").parquet(path)
    return rejected


def append_metrics(metrics: DataFrame, ledger: str) -> DataFrame:
    """Validate and append run metrics; returns the rejected rows."""
    valid, rejected = validate_metrics(metrics.select(*[f.name for f in METRIC_SCHEMA.fields]))
    path = _p(ledger, "run_metric")
    _new_only(metrics.sparkSession, valid, path, METRIC_SCHEMA).write.mode("append").parquet(path)
    return rejected


def read_runs(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(_p(ledger, "run"))


def read_metrics(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).parquet(_p(ledger, "run_metric"))


def list_runs(spark: SparkSession, ledger: str) -> tuple[DataFrame, int]:
    """Run history newest first (by run id) and the total."""
    runs = read_runs(spark, ledger)
    return runs.orderBy(F.desc("run_id")), runs.count()


def first_metric(spark: SparkSession, ledger: str) -> DataFrame:
    """One metric row per run (the first by a stable order); runs without
    metrics get nulls in ``history_with_metrics``.  The reference takes an
    unordered first row; here ties are broken by the metric values."""
    m = read_metrics(spark, ledger)
    w = Window.partitionBy("run_id").orderBy("deff", "ess", "essp", "w_max", "w_min")
    return m.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def history_with_metrics(spark: SparkSession, ledger: str) -> DataFrame:
    """One left join of runs with their metrics (no request per run),
    rounded for display as in the reference: deff 3, ess 1, essp 3 decimals."""
    runs = read_runs(spark, ledger)
    m = first_metric(spark, ledger)
    return (runs.join(m, "run_id", "left")
                .select("run_id", "run_ts", "population", "n_rows",
                        F.array_join("calib_vars", ", ").alias("calib_vars"),
                        F.round("deff", 3).alias("deff"), F.round("ess", 1).alias("ess"),
                        F.round("essp", 3).alias("essp"), "w_max", "w_min")
                .orderBy(F.desc("run_id")))
