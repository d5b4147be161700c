"""Survey CSV scan: S1-S5.

Every column is read as text (no schema inference pass), headers are normalised, the
required columns are checked, and values are cast by name:

* columns are matched by each file's own header, so files may order them differently and
  may hold extra columns;
* the texts that stand for a missing value become null;
* dates are ISO by default; ``date_formats`` names others (``dd/MM/yyyy``), tried in order;
* quoted fields may hold line breaks, delimiters and doubled quotes, wherever Spark cuts a file;
* a number or date that does not parse is an error, as the load fails on it; with
  ``strict=False`` such rows go to ``rejected_rows`` instead of vanishing in a later filter;
* the order column for the keep-first de-duplication is (file path, block, place), so which
  duplicate wins does not follow the cluster's packing of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrake.functions.recode import clean_header
from tallyrake.sources.csv_records import csv_records

# The required columns (after header normalisation) and the rename.
REQUIRED_COLUMNS = ["fecha", "encuesta", "estrato", "sexo", "edad", "nivel_educativo",
                    "cantidad_de_integrantes_en_el_hogar", "imagen_del_candidato", "voto", "voto_anterior"]
RENAMES = {"cantidad_de_integrantes_en_el_hogar": "integrantes_hogar"}
NUMERIC = ["edad", "imagen_del_candidato"]


class MissingColumnsError(ValueError):
    pass


def normalize_headers(df: DataFrame) -> DataFrame:
    """Strip, lower, space -> underscore."""
    return df.toDF(*[clean_header(c) for c in df.columns])


def check_required(df: DataFrame, required=REQUIRED_COLUMNS) -> None:
    """S3: raise listing the missing required columns (extra columns pass)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing required columns: {missing}")


# Texts read as a missing value (besides the empty text).
MISSING_TEXTS = ["#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                 "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
ISO_DATES: tuple[str, ...] = ()


def text_or_null(c) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.when(~F.trim(x).isin("", *MISSING_TEXTS), x)


def parse_date(c, date_formats: tuple[str, ...] = ISO_DATES) -> Column:
    """Null where the text fits no format."""
    x = F.col(c) if isinstance(c, str) else c
    x = F.trim(x)
    tries = [F.try_to_timestamp(x, F.lit(f)) for f in date_formats] or [F.try_to_timestamp(x)]
    return F.coalesce(*tries).cast("timestamp_ntz")


def typed_survey(texts: DataFrame, date_formats: tuple[str, ...] = ISO_DATES) -> DataFrame:
    """Text columns with normal headers -> typed survey, plus ``_bad``: the columns whose text
    did not parse."""
    texts = texts.withColumns({c: text_or_null(c) for c in REQUIRED_COLUMNS if c in texts.columns})
    typed = {"fecha": parse_date("fecha", date_formats),
             **{c: F.expr(f"try_cast(trim(`{c}`) as double)") for c in NUMERIC}}
    over = [F.when(F.col("_over"), F.lit("(more fields than the header)"))] if "_over" in texts.columns else []
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & x.isNull(), F.lit(c)) for c, x in typed.items()], *over))
    out = texts.withColumn("_bad", bad).withColumns(typed).drop("_over")
    for src, dst in RENAMES.items():
        out = out.withColumnRenamed(src, dst)                                  # S5
    return out


#: Files whose headers are sent to the tasks that read them; with more, records are joined by file.
BROADCAST_FILES = 20_000


def survey_texts(spark: SparkSession, path, order_col: str | None = "_ord") -> DataFrame:
    """All files under ``path`` as text columns with normal headers, joined by column name, plus
    ``_over``: the record has more fields than its file's header.

    Records are read by ``csv_records``, whatever line breaks and quotes they hold; the driver
    gets the distinct headers only, however many files there are."""
    records, headers = csv_records(spark, path, clean_header)
    names: list[str] = []
    for (header,) in sorted(tuple(r) for r in headers.select("header").distinct().collect()):
        missing = [c for c in REQUIRED_COLUMNS if c not in header]
        if missing:
            raise MissingColumnsError(f"missing required columns: {missing}")
        names += [c for c in header if c not in names]
    if not names:
        raise MissingColumnsError("no file with a header")
    # array_position counts from 1 and gives 0 for a column that the file does not hold
    places = headers.select("file", F.size("header").alias("_width"),
                            *[(F.array_position("header", c).cast("int") - 1).alias(f"_at{i}") for i, c in enumerate(names)])
    small = headers.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    read = records.join(F.broadcast(places) if small else places, "file")
    place = F.concat_ws("\u0001", "file", F.lpad(F.col("block").cast("string"), 16, "0"),
                        F.lpad(F.col("place").cast("string"), 10, "0"))
    return read.select(*[F.get("fields", F.col(f"_at{i}")).alias(c) for i, c in enumerate(names)],
                       (F.size("fields") > F.col("_width")).alias("_over"),
                       *([place.alias(order_col)] if order_col else []))


def load_survey_csv(spark: SparkSession, path, strict: bool = True, order_col: str | None = "_ord",
                    date_formats: tuple[str, ...] = ISO_DATES) -> DataFrame:
    """Header CSV files (UTF-8) -> typed survey frame.

    ``strict`` fails the job on a date or number that does not parse or a record with more fields
    than the header, whichever columns are read; otherwise those rows are left out here and come
    from ``rejected_rows``.  Missing fields at a record's end are null."""
    out = typed_survey(survey_texts(spark, path, order_col), date_formats)
    if not strict:
        return out.filter(F.size("_bad") == 0).drop("_bad")
    # a filter, so that the check holds whichever columns are read
    sound = F.when(F.size("_bad") == 0, True).otherwise(F.raise_error(F.concat(
        F.lit("malformed survey values in "), F.array_join("_bad", ", "), F.lit(" of interview "),
        F.coalesce(F.col("encuesta"), F.lit("?")))).cast("boolean"))
    return out.filter(sound).drop("_bad")


def rejected_rows(spark: SparkSession, path, date_formats: tuple[str, ...] = ISO_DATES) -> DataFrame:
    """The files' rows with a malformed date or number, as read, with the columns at fault."""
    texts = survey_texts(spark, path)
    bad = typed_survey(texts, date_formats).filter(F.size("_bad") > 0).select("_ord", F.col("_bad").alias("columns"))
    return texts.join(bad, "_ord").drop("_ord", "_over")


def write_survey_csv(df: DataFrame, path: str, headers: dict[str, str] | None = None) -> None:
    """Write a survey frame as header CSV (optionally with display headers)."""
    headers = headers or {}
    (df.toDF(*[headers.get(c, c) for c in df.columns]).write.mode("overwrite").option("header", True).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
