"""Continuous surveys as a file stream: re-weight only the windows a new upload touches.

``readStream`` over a CSV drop folder finds the new files of each batch (their names only);
``foreachBatch`` then

1. reads them as any survey CSV is read (own headers, missing-value texts, dates; rows that do
   not parse go to ``<store>/rejected``);
2. keeps the first row of an interview id among the rows that pass F1/F2, and drops ids that an
   earlier upload showed: ``<store>/ids`` remembers **every** id that passed F1/F2, also those
   whose first row a later filter drops, so the stream keeps what one batch over all uploads
   would keep.  The table is partitioned by a hash of the id; only the buckets that the upload
   touches are read;
3. F3-F8, recode, calendar buckets; the rows are appended to ``<store>/rows`` partitioned by
   ``(_part, _epoch)``; ``_part`` is the month of the window for day/week buckets and the year
   for month buckets (folders stay few and large; a folder holds whole windows);
4. the touched partitions (distinct ``_part`` of the upload) are read back with partition
   pruning, all their windows are raked, and ``<store>/weighted`` and ``<store>/diagnostics``
   are rewritten for those partitions only.

All writes are dynamic partition overwrites by epoch, so a replayed epoch rewrites exactly its
own files with the same content: exactly-once with the stream's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrake.operators.clean import add_windows, clean_survey, eligible, keep_first, normalize_survey
from tallyrake.operators.rake import rake
from tallyrake.plans.process import UNIT_WINDOW
from tallyrake.sources.census import calibration_targets, calibration_variables
from tallyrake.sources.survey_csv import ISO_DATES, survey_texts, typed_survey

ID_BUCKETS = 32


def new_files(spark: SparkSession, input_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the paths of new files; their content is not read here."""
    reader = (spark.readStream.format("binaryFile").option("pathGlobFilter", "*.csv")
              .schema("path string, modificationTime timestamp, length long, content binary"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(input_dir).select("path")


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    from tallyrake.session import path_exists
    return spark.read.parquet(path) if path_exists(spark, path) else None


def _replace(df: DataFrame, path: str, *parts: str) -> None:
    """Rewrite only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def make_batch_writer(store: str, population: str, unit: str = "week", has_bsas_municipalities: bool = False,
                      date_formats: tuple[str, ...] = ISO_DATES, **rake_kw):
    win = UNIT_WINDOW[unit]
    part = F.date_trunc("year" if unit == "month" else "month", F.col(win)).cast("date")
    rows_path, w_path, d_path = f"{store}/rows", f"{store}/weighted", f"{store}/diagnostics"
    ids_path, bad_path = f"{store}/ids", f"{store}/rejected"

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        files = [r[0] for r in batch.select("path").collect()]     # names of one batch's uploads
        if not files:
            return
        epoch = F.lit(epoch_id).alias("_epoch")
        typed = typed_survey(survey_texts(spark, files), date_formats)
        _replace(typed.filter(F.size("_bad") > 0).select("encuesta", "_bad", "_ord", epoch), bad_path, "_epoch")
        bucket = F.pmod(F.xxhash64("encuesta"), F.lit(ID_BUCKETS)).cast("int")
        first = keep_first(eligible(typed.filter(F.size("_bad") == 0).drop("_bad")), "encuesta").withColumn("_bucket", bucket)
        stored = _read_or_none(spark, ids_path)
        if stored is not None:
            touched = [r[0] for r in first.select("_bucket").distinct().collect()]      # at most ID_BUCKETS
            seen = stored.filter(F.col("_bucket").isin(touched) & (F.col("_epoch") < epoch_id)).select("encuesta")
            first = first.join(seen, first["encuesta"].eqNullSafe(seen["encuesta"]), "left_anti")
        _replace(first.select("encuesta", "_bucket", epoch).hint("rebalance", "_bucket"), ids_path, "_bucket", "_epoch")
        # which of this upload's rows are new is read back from the ids just stored
        mine = spark.read.parquet(ids_path).filter(F.col("_epoch") == epoch_id).select(F.col("encuesta").alias("_id"))
        up = eligible(typed.filter(F.size("_bad") == 0).drop("_bad"))
        cleaned = clean_survey(up.join(mine, F.col("encuesta").eqNullSafe(F.col("_id")), "left_semi"))
        normed, _ = normalize_survey(cleaned, population, has_bsas_municipalities)
        new = (add_windows(normed, units=(unit,)).withColumn("_part", part)
               .withColumn("_epoch", F.lit(epoch_id)).drop("_ord"))
        # REBALANCE: AQE packs rows of one partition into few files and splits hot ones
        _replace(new.hint("rebalance", "_part"), rows_path, "_part", "_epoch")
        touched = [r[0] for r in spark.read.parquet(rows_path).filter(F.col("_epoch") == epoch_id)
                   .select("_part").distinct().collect()]
        if not touched:
            return
        window_rows = spark.read.parquet(rows_path).filter(F.col("_part").isin(touched)).drop("_epoch")
        variables = calibration_variables(population, has_bsas_municipalities)
        res = rake(window_rows, win, variables, calibration_targets(spark, population, has_bsas_municipalities),
                   weight_col="peso", **rake_kw)
        _replace(res.weighted.hint("rebalance", "_part"), w_path, "_part")
        _replace(res.diagnostics.withColumns({"_epoch": F.lit(epoch_id), "_part": part}).hint("rebalance", "_part"), d_path, "_part")

    return write_batch


def start_incremental_rake(spark: SparkSession, input_dir: str, store: str, checkpoint: str,
                           population: str, unit: str = "week", has_bsas_municipalities: bool = False,
                           available_now: bool = True, max_files_per_trigger: int | None = None,
                           date_formats: tuple[str, ...] = ISO_DATES, **rake_kw):
    """Start the stream; with ``available_now`` it processes what is there and stops."""
    stream = new_files(spark, input_dir, max_files_per_trigger)
    w = (stream.writeStream.foreachBatch(make_batch_writer(store, population, unit, has_bsas_municipalities,
                                                           date_formats, **rake_kw))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
