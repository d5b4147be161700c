"""Entry 1 of the reference ("process survey") as one lazy lineage.

load -> clean -> normalise -> (impute) -> calendar buckets -> census targets ->
rake + trim + normalise per bucket -> whole-survey report -> ledger.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrake.functions.recode import is_gba_municipality, norm_text
from tallyrake.operators.clean import add_windows, clean_survey, normalize_survey
from tallyrake.operators.rake import rake_units, targets_as_dict
from tallyrake.sources.census import (
    POPULATIONS,
    PROVINCE_REGION,
    calibration_targets,
    calibration_variables,
    check_population,
)

UNIT_SUFFIX = {"day": "d", "week": "s", "month": "m"}
UNIT_WINDOW = {"day": "win_d", "week": "win_s", "month": "win_m"}


def territory(population: str) -> Column:
    """D6 option: predicate of rows that belong to a population's territory.

    Provinces match their own (lower-case) name, regions their provinces, ``gba`` its
    municipalities, ``buenos_aires`` the province name or a municipality,
    ``interior_buenos_aires`` the province name, ``nacional`` every mapped name.
    """
    check_population(population)
    e = norm_text("estrato")
    regions = set(PROVINCE_REGION.values())
    desc = POPULATIONS[population]
    if population == "nacional":
        return e.isin(list(PROVINCE_REGION)) | is_gba_municipality("estrato")
    if population == "gba":
        return is_gba_municipality("estrato")
    if population in ("buenos_aires", "interior_buenos_aires"):
        cond = e == F.lit("buenos aires")
        return cond | is_gba_municipality("estrato") if population == "buenos_aires" else cond
    if desc in regions:
        return e.isin([p for p, r in PROVINCE_REGION.items() if r == desc])
    return e == F.lit(desc.lower())


def prepare_survey(raw: DataFrame, population: str, restrict: bool = False,
                   order_col: str = "_ord", persist: bool = False) -> tuple[DataFrame, bool]:
    """clean -> normalise -> buckets (no imputation).

    ``persist`` keeps the prepared survey (memory, spilling to disk) because every
    later pass reads it: the cell aggregation and the weight join of each unit, the
    model fits.  Without it each pass re-runs the scan and the de-duplication shuffle."""
    df = raw.filter(territory(population)) if restrict else raw
    cleaned = clean_survey(df, order_col)
    normed, flag = normalize_survey(cleaned, population)
    out = add_windows(normed)
    if persist:
        from pyspark import StorageLevel
        out = out.persist(StorageLevel.MEMORY_AND_DISK)
    return out, flag


@dataclass
class ProcessResult:
    weighted: DataFrame
    variables: list[str]
    targets: DataFrame
    diagnostics: dict[str, DataFrame] = field(default_factory=dict)
    has_bsas_municipalities: bool = False


def weight_survey(spark: SparkSession, prepared: DataFrame, population: str, flag: bool,
                  units=("day", "week", "month"), **rake_kw) -> ProcessResult:
    """Census targets for the population, then all units raked from one count of the rows."""
    variables = calibration_variables(population, flag)
    targets = calibration_targets(spark, population, flag)
    raked = rake_units(prepared, {UNIT_WINDOW[u]: f"peso_{UNIT_SUFFIX[u]}" for u in units}, variables,
                       targets_as_dict(targets, variables), **rake_kw)
    diags = {u: raked.diagnostics[UNIT_WINDOW[u]] for u in units}
    return ProcessResult(raked.weighted, variables, targets, diags, flag)


def process_survey(spark: SparkSession, raw: DataFrame, population: str,
                   units=("day", "week", "month"), restrict: bool = False,
                   impute: bool = False, model_dir: str | None = None, **rake_kw) -> ProcessResult:
    """The whole of Entry 1 up to the weights (report and ledger are separate calls)."""
    df, flag = prepare_survey(raw, population, restrict, persist=True)
    if impute:
        from tallyrake.operators.impute import impute_survey
        df = impute_survey(df, model_dir=model_dir).imputed
    return weight_survey(spark, df, population, flag, units, **rake_kw)


@dataclass
class EntryResult:
    process: ProcessResult
    score_method: str
    null_profile: DataFrame          # per column, after imputation
    metrics: DataFrame               # of the whole-survey report, as stored in the ledger
    retrained: dict[str, int]        # rows added to each model's history


def process_entry(spark: SparkSession, raw: DataFrame, population: str, run_id: str, ledger: str,
                  model_dir: str | None = None, units=("day", "week", "month"), restrict: bool = False,
                  **rake_kw) -> EntryResult:
    """Entry 1 as one call: clean, recode, impute, retrain the stored models on the observed
    values, rake every unit, report the whole survey, and append run and metrics to the ledger.

    The survey is persisted with its votes normalised (``prepare_survey`` does the other texts), so
    none of the passes over it strips texts again."""
    from pyspark import StorageLevel

    from tallyrake.operators.clean import null_profile
    from tallyrake.operators.impute import impute_survey, normalize_text_columns, update_all_models
    from tallyrake.operators.report import report_rake, weight_metrics
    from tallyrake.sources import ledger as L
    from tallyrake.sources.history import survey_columns
    prepared, flag = prepare_survey(raw, population, restrict)
    observed = normalize_text_columns(prepared, ["voto", "voto_anterior"]).persist(StorageLevel.MEMORY_AND_DISK)
    result = impute_survey(observed, model_dir=model_dir, normalized=True)
    retrained = update_all_models(observed, model_dir, normalized=True) if model_dir else {}
    weighted = weight_survey(spark, result.imputed, population, flag, units, **rake_kw)
    report = report_rake(result.imputed, weighted.variables, weighted.targets, **rake_kw)
    met = weight_metrics(report).withColumn("run_id", F.lit(run_id)).cache()
    L.append_runs(met.select("run_id", F.current_timestamp().alias("run_ts"), F.lit(population).alias("population"),
                             F.col("n").alias("n_rows"), F.array(*[F.lit(v) for v in weighted.variables]).alias("calib_vars")),
                  ledger)
    L.append_metrics(met, ledger)
    return EntryResult(weighted, result.score_method,
                       null_profile(result.imputed.select(*survey_columns(result.imputed))), met, retrained)
