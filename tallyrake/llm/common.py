"""Helpers shared by the operators: scratch tables, connected components, grouping of rows."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrake.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark's cleaner deletes them once the
    frames that made them are collected, which a driver with little garbage puts off for long.
    Python's dropped references reach the JVM with a delay of about a second."""
    gc.collect()
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows to the shared scratch folder and read them back.

    The lineage ends there, so a lost executor costs at most the running step."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids given to rows without one begin here; ids of a corpus should lie below.
NAMELESS = 1 << 62


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row, id, text)``: every row as one struct column, so its columns' names meet no others; a
    row without an id gets a large one from its text's hash, the same for equal texts."""
    text = F.col(f"`{text_col}`").cast("string")
    own = F.xxhash64(text).bitwiseAND(NAMELESS - 1).bitwiseOR(NAMELESS)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.coalesce(F.col(f"`{id_col}`").cast("long"), own).alias("id"), text.alias("text"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id per vertex of undirected ``edges(a, b)``: ``(v, comp)``.

    Labels spread to neighbours and then jump to the label of their label, so long chains
    take a logarithmic number of rounds.  Minima are pre-aggregated before each shuffle, and
    the rounds stop when no label changed.  Nothing but one count per round reaches the driver."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = staged(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("n"))
                    .select("v", F.least("v", "n").alias("comp"), F.lit(True).alias("changed")), "labels")
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("v").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("near")))
        low = labels.select("v", "comp").join(near, "v").select(
            "v", F.col("comp").alias("old"), F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("comp").alias("far"))
        labels = staged(low.join(jump, "low", "left").select(
            "v", F.least("low", "far").alias("comp"), (F.least("low", "far") < F.col("old")).alias("changed")), "labels")
        if labels.filter("changed").isEmpty():
            return labels.select("v", "comp")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
