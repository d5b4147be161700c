"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads the driver tables through ``sources.driver_view`` (rows in the
survey schema only) and then runs the library's own operators over the whole input.
Doubles are rounded to 6 decimals so the cross-engine hash is stable; the matching
SQL lives in ``plans.oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrake.functions.recode import norm_text
from tallyrake.operators import tracking as trk
from tallyrake.operators.clean import clean_survey, null_profile
from tallyrake.operators.rake import rake
from tallyrake.plans.process import prepare_survey
from tallyrake.sources.census import calibration_targets, calibration_variables
from tallyrake.sources.driver_view import SURVEY_COLUMNS, events_survey, survey_view, survey_with_duplicates

NATIVE_SWEEPS = 6     # of the fixed-sweep cross-check only


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals (both engines do the same)."""
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def _prepared(spark, sf, population="pampeana", restrict=False, persist=False):
    return prepare_survey(survey_view(spark, sf), population, restrict=restrict, persist=persist)


def _raked(spark, sf, window, population="pampeana", restrict=False, **kw):
    df, flag = _prepared(spark, sf, population, restrict)
    variables = calibration_variables(population, flag)
    res = rake(df, window, variables, calibration_targets(spark, population, flag),
               weight_col="peso", **kw)
    return res


# ----------------------------------------------------------------------- clean / recode

def survey_clean(spark: SparkSession, sf: str) -> DataFrame:
    """F1-F8 + W1 over the survey view."""
    return r6(clean_survey(survey_view(spark, sf)).select(*SURVEY_COLUMNS))


def survey_dedup_lines(spark: SparkSession, sf: str) -> DataFrame:
    """W1 on repeated interviews (one per order line), first line wins, then F3-F8."""
    return r6(clean_survey(survey_with_duplicates(spark, sf)).select(*SURVEY_COLUMNS))


def survey_null_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Null percentage per column of the raw survey and of the cleaned survey."""
    raw = survey_view(spark, sf).select(*SURVEY_COLUMNS)
    before = null_profile(raw).withColumn("stage", F.lit("raw"))
    after = null_profile(clean_survey(survey_view(spark, sf)).select(*SURVEY_COLUMNS)).withColumn("stage", F.lit("clean"))
    return r6(before.unionByName(after))


def survey_normalize_nacional(spark: SparkSession, sf: str) -> DataFrame:
    """National recode with region lookup (unmapped -> null)."""
    df, _ = _prepared(spark, sf, "nacional")
    return df.select("encuesta", "estrato", "sexo", "edad_cat", "region")


def survey_normalize_bsas(spark: SparkSession, sf: str) -> DataFrame:
    """Buenos Aires territory, GBA/interior recode."""
    df, flag = _prepared(spark, sf, "buenos_aires", restrict=True)
    return df.select("encuesta", "estrato", "edad_cat", "estrato_bsas",
                     F.lit(flag).alias("has_municipalities"))


def window_counts(spark: SparkSession, sf: str) -> DataFrame:
    """T1-T3 + A18: interviews per day / week / month bucket with text labels."""
    from tallyrake.functions.recode import window_label
    df, _ = _prepared(spark, sf)
    parts = []
    for unit, col in (("day", "win_d"), ("week", "win_s"), ("month", "win_m")):
        parts.append(df.groupBy(F.col(col).alias("win"))
                       .agg(F.count(F.lit(1)).alias("n"))
                       .select(F.lit(unit).alias("unit"), "win", window_label("win", unit).alias("label"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ----------------------------------------------------------------------- rake

def rake_month_weights(spark: SparkSession, sf: str) -> DataFrame:
    """C1 + W2-W4 + J4: monthly rake (pampeana margins, to tolerance), weight per interview."""
    res = _raked(spark, sf, "win_m")
    return r6(res.weighted.select("encuesta", "win_m", "peso"))


def _diag(res, window):
    return r6(res.diagnostics.select(window, "n", "n_cells", "status", "iterations", "deff_pop", "cv",
                                     "w_max", "w_min", "warn_deff", "warn_cv", "warn_fallback"))


def rake_month_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """A7-A9 per month: status, deff (population var), CV %, weight range, warnings."""
    return _diag(_raked(spark, sf, "win_m"), "win_m")


def rake_week_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly rake: sparse windows, deff / CV warnings."""
    return _diag(_raked(spark, sf, "win_s"), "win_s")


def rake_day_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Daily rake: mostly fallback windows (empty target levels -> weight 1)."""
    return _diag(_raked(spark, sf, "win_d"), "win_d")


def rake_month_bsas(spark: SparkSession, sf: str) -> DataFrame:
    """Four-variable rake with the conditional ``estrato_bsas`` margin."""
    res = _raked(spark, sf, "win_m", population="buenos_aires", restrict=True)
    return r6(res.weighted.select("encuesta", "win_m", "estrato_bsas", "peso"))


def rake_month_nacional_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Four-variable national rake (S9 region margin via J1): a window holding an
    interview from an unmapped estrato has a level without target ('nan') and falls
    back to weight 1 (W4), as the reference's raking failure does."""
    return _diag(_raked(spark, sf, "win_m", population="nacional"), "win_m")


def rake_month_native(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly rake by exactly 6 sweeps through the JVM-only unrolled path: a fixed-sweep
    cross-check, the only one; production weights are raked to tolerance."""
    res = _raked(spark, sf, "win_m", method="native", sweeps=NATIVE_SWEEPS)
    return r6(res.weighted.select("encuesta", "win_m", "peso"))


def rake_units_weights(spark: SparkSession, sf: str) -> DataFrame:
    """C1 for day, week and month from one count of the rows: three weights per interview."""
    from tallyrake.plans.process import weight_survey
    df, flag = _prepared(spark, sf)
    return r6(weight_survey(spark, df, "pampeana", flag).weighted.select("encuesta", "peso_d", "peso_s", "peso_m"))


# ----------------------------------------------------------------------- tracking

def _month_weighted(spark, sf):
    return _raked(spark, sf, "win_m").weighted


def track_score_month(spark: SparkSession, sf: str) -> DataFrame:
    """A1: weighted mean score per month."""
    return r6(trk.track_score(_month_weighted(spark, sf), "win_m", "peso"))


def track_vote_month(spark: SparkSession, sf: str) -> DataFrame:
    """A2: weighted vote share x100 per month and candidate, zero-filled."""
    return r6(trk.track_vote(_month_weighted(spark, sf), "win_m", "peso"))


def track_vote_month_wide(spark: SparkSession, sf: str) -> DataFrame:
    """One ``vota_<c>`` column per candidate."""
    return r6(trk.vote_wide(_month_weighted(spark, sf), "win_m", "peso"))


def track_vote_month_melt(spark: SparkSession, sf: str) -> DataFrame:
    """R2: the wide table melted back to ``(win_m, candidate, share)``."""
    wide = trk.vote_wide(_month_weighted(spark, sf), "win_m", "peso")
    return r6(trk.melt_wide(wide, "win_m"))


def intervals_score_month(spark: SparkSession, sf: str) -> DataFrame:
    """A3-A5: mean, Kish n, weighted sd, 95 % MOE and bounds per month."""
    return r6(trk.score_intervals(_month_weighted(spark, sf), "win_m", "peso"))


def intervals_score_shifted(spark: SparkSession, sf: str) -> DataFrame:
    """A4/A5 on scores a thousand million above zero: the spread keeps its digits."""
    far = _month_weighted(spark, sf).withColumn("imagen_del_candidato", F.col("imagen_del_candidato") + 1e9)
    got = trk.score_intervals(far, "win_m", "peso")
    return r6(got.select("win_m", "n", "n_eff", "moe_95", F.round(F.col("imagen_media") - 1e9, 3).alias("over_1e9")))


def intervals_vote_month(spark: SparkSession, sf: str) -> DataFrame:
    """Vote share with 95 % MOE and bounds per month and candidate."""
    return r6(trk.vote_intervals(_month_weighted(spark, sf), "win_m", "peso"))


def _events(spark, sf):
    from tallyrake.operators.clean import add_windows
    return add_windows(events_survey(spark, sf), units=("day", "week"))


def track_events_day(spark: SparkSession, sf: str) -> DataFrame:
    """A1 unweighted over the event stream: mean value per day."""
    return r6(trk.track_score(_events(spark, sf), "win_d", None))


def vote_events_week(spark: SparkSession, sf: str) -> DataFrame:
    """A6 unweighted over the event stream: event-type shares per week with MOE."""
    return r6(trk.vote_intervals(_events(spark, sf), "win_s", None))


def intervals_events_week(spark: SparkSession, sf: str) -> DataFrame:
    """A5 unweighted over the event stream: mean value per week with MOE."""
    return r6(trk.score_intervals(_events(spark, sf), "win_s", None))


# ----------------------------------------------------------------------- tests

def _test_stats(df, window, pairs):
    from tallyrake.operators.hypothesis import pair_statistics
    return r6(pair_statistics(df, window, "imagen_del_candidato", pairs))


def test_stats_first_last_week(spark: SparkSession, sf: str) -> DataFrame:
    """H1-H4 statistics, first vs last weekly window of the survey score (unweighted)."""
    df, _ = _prepared(spark, sf)
    return _test_stats(df, "win_s", "first_last")


def test_stats_events_weeks(spark: SparkSession, sf: str) -> DataFrame:
    """H1-H4 statistics for every week of the event stream vs the previous week."""
    return _test_stats(_events(spark, sf), "win_s", "consecutive")


def test_decision_first_last_week(spark: SparkSession, sf: str) -> DataFrame:
    """H5: test choice, statistic, p-value and decision, first vs last week."""
    from tallyrake.operators.hypothesis import test_change
    df, _ = _prepared(spark, sf)
    return r6(test_change(df, "win_s", "imagen_del_candidato", "first_last"))


def test_decision_events_days(spark: SparkSession, sf: str) -> DataFrame:
    """H5 over every pair of consecutive days of the event stream."""
    from tallyrake.operators.hypothesis import test_change
    return r6(test_change(_events(spark, sf), "win_d", "imagen_del_candidato", "consecutive"))


# ----------------------------------------------------------------------- report

def _report(spark, sf, population="pampeana"):
    from tallyrake.operators.report import report_rake
    df, flag = _prepared(spark, sf, population)
    return report_rake(df, calibration_variables(population, flag),
                       calibration_targets(spark, population, flag))


def report_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """C2 + A10: whole-survey rake, upper trim at 3x mean, deff / ess / essp / range."""
    from tallyrake.operators.report import weight_metrics
    return r6(weight_metrics(_report(spark, sf)))


def report_asmd(spark: SparkSession, sf: str) -> DataFrame:
    """ASMD per calibration variable before / after weighting, and the reduction."""
    from tallyrake.operators.report import asmd
    return r6(asmd(_report(spark, sf)))


def report_weight_summary(spark: SparkSession, sf: str) -> DataFrame:
    """C4: weight distribution summary (quartiles exact, shares by threshold)."""
    from tallyrake.operators.report import weight_summary
    return r6(weight_summary(_report(spark, sf)))


def report_sample_vs_target(spark: SparkSession, sf: str) -> DataFrame:
    """C5 + J5: target vs sample vs weighted proportion per level (absent -> 0)."""
    from tallyrake.operators.report import sample_vs_population
    return r6(sample_vs_population(_report(spark, sf)))


def calibration_value_shares(spark: SparkSession, sf: str) -> DataFrame:
    """A11 + F13: normalised value counts of the national calibration variables
    (null region -> level 'nan')."""
    from tallyrake.operators.report import value_shares
    df, flag = _prepared(spark, sf, "nacional")
    return r6(value_shares(df, calibration_variables("nacional", flag)))


# ----------------------------------------------------------------------- sources

# Display headers used when the survey view is written as an uploaded CSV file.
CSV_HEADERS = {"fecha": " Fecha", "encuesta": "Encuesta", "estrato": "Estrato", "sexo": "Sexo", "edad": "Edad",
               "nivel_educativo": "Nivel educativo",
               "integrantes_hogar": "Cantidad de integrantes en el hogar",
               "imagen_del_candidato": "Imagen del candidato", "voto": "Voto", "voto_anterior": "Voto anterior "}


def survey_csv_load(spark: SparkSession, sf: str) -> DataFrame:
    """The survey view written as a CSV upload (display headers), read back
    with header normalisation, the required-column check, date parse and rename."""
    from tallyrake.session import scratch_path
    from tallyrake.sources.survey_csv import load_survey_csv, write_survey_csv
    path = scratch_path(spark, "survey-csv")
    write_survey_csv(survey_view(spark, sf).select(*SURVEY_COLUMNS), path, CSV_HEADERS)
    return r6(load_survey_csv(spark, path).select(*SURVEY_COLUMNS))


def survey_csv_quoted(spark: SparkSession, sf: str) -> DataFrame:
    """S1 on uploads whose texts hold line breaks of both kinds, delimiters, doubled quotes and
    white space at the edges, then F5/F9 on what was read."""
    from tallyrake.functions.recode import norm_text
    from tallyrake.session import scratch_path
    from tallyrake.sources.survey_csv import load_survey_csv, write_survey_csv
    path = scratch_path(spark, "survey-csv-quoted")
    key = F.col("encuesta").cast("long")
    texts = survey_view(spark, sf).select(*SURVEY_COLUMNS).withColumns({
        "estrato": F.when(key % 5 == 0, F.concat(F.lit("la\n"), "estrato")).when(key % 5 == 1, F.concat(F.lit('"'), "estrato", F.lit('", x')))
        .when(key % 5 == 2, F.concat("estrato", F.lit("\r\n\r\n\"\"fin"))).otherwise(F.col("estrato")),
        "nivel_educativo": F.when(key % 3 == 0, F.concat(F.lit("\t"), "nivel_educativo", F.lit("\n")))
        .otherwise(F.col("nivel_educativo"))})
    write_survey_csv(texts, path, CSV_HEADERS)
    got = load_survey_csv(spark, path)
    return got.select("encuesta", "estrato", "nivel_educativo", norm_text("nivel_educativo").alias("nivel"), "edad", "voto_anterior")


def survey_sorted_output(spark: SparkSession, sf: str) -> DataFrame:
    """O1: the cleaned survey written in the order of its dates; the place of every interview over
    all files, as read back."""
    from tallyrake.session import scratch_path
    from tallyrake.sources.ordered import places, write_sorted
    path = scratch_path(spark, "survey-sorted")
    df, _ = _prepared(spark, sf)
    write_sorted(df.select("fecha", "encuesta", "voto"), path, "fecha", "encuesta")
    return places(spark, path).select("encuesta", "fecha", "place")


def ledger_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    """O3: a run per month, listed newest first; the place of every run in the written list."""
    from tallyrake.session import scratch_path
    from tallyrake.sources import ledger as L
    from tallyrake.sources.ordered import places, write_sorted
    df, _ = _prepared(spark, sf)
    runs = df.groupBy("win_m").agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.date_format("win_m", "yyyyMM").alias("run_id"), F.current_timestamp().alias("run_ts"), F.lit("pampeana").alias("population"),
        "n_rows", F.array(F.lit("sexo")).alias("calib_vars"))
    path = scratch_path(spark, "ledger")
    L.append_runs(runs, path)
    listed, _ = L.list_runs(spark, path)
    out = scratch_path(spark, "runs-listed")
    write_sorted(listed, out, "run_id", descending=True)
    return places(spark, out).select("run_id", "n_rows", "place")


def calibration_targets_bsas(spark: SparkSession, sf: str) -> DataFrame:
    """Margins for the Buenos Aires survey; ``estrato_bsas`` is added because
    the survey names a GBA municipality (checked on the data)."""
    df, flag = _prepared(spark, sf, "buenos_aires", restrict=True)
    return r6(calibration_targets(spark, "buenos_aires", flag))


def ledger_history(spark: SparkSession, sf: str) -> DataFrame:
    """S10-S14, J7, O3 with C2/A10 per batch: every month is one processed upload;
    its whole-batch report (rake, upper trim 3) gives deff / ess / essp / range; run
    and metric rows are appended to a ledger and read back newest first."""
    from tallyrake.operators.report import report_rake, weight_metrics
    from tallyrake.session import scratch_path
    from tallyrake.sources import ledger as L
    df, flag = _prepared(spark, sf)
    variables = calibration_variables("pampeana", flag)
    rep = report_rake(df, variables, calibration_targets(spark, "pampeana", flag), window_col="win_m")
    met = weight_metrics(rep).withColumn("run_id", F.date_format("win_m", "yyyy-MM")).cache()
    path = scratch_path(spark, "ledger")
    runs = met.select("run_id", F.current_timestamp().alias("run_ts"), F.lit("pampeana").alias("population"),
                      F.col("n").alias("n_rows"), F.array(*[F.lit(v) for v in variables]).alias("calib_vars"))
    L.append_runs(runs, path)
    L.append_metrics(met, path)
    met.unpersist()
    out = L.history_with_metrics(spark, path).drop("run_ts")
    return r6(out)


def history_monthly_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Each month is an upload with its own fingerprint; complete
    cases of the previous-vote model are appended to the training history twice -
    the second append adds nothing (anti-join on the survey id)."""
    from tallyrake.session import cut_lineage, scratch_path
    from tallyrake.sources.history import SURVEY_ID, append_history, fingerprint, read_history
    df, _ = _prepared(spark, sf, persist=True)
    cols = ["edad", "sexo", "estrato", "nivel_educativo", "voto_anterior"]
    obs = df.select("win_m", *SURVEY_COLUMNS)
    ids = cut_lineage(fingerprint(obs, SURVEY_COLUMNS, by=["win_m"]))          # a row per month
    batch = obs.join(F.broadcast(ids), "win_m").select(*cols, SURVEY_ID).dropna()
    path = scratch_path(spark, "history")
    first = append_history(spark, path, batch)
    second = append_history(spark, path, batch)
    # counted per survey before the join: the stored files look small, but their rows are not
    hist = read_history(spark, path).groupBy(SURVEY_ID).agg(F.count(F.lit(1)).alias("n"))
    return (hist.join(F.broadcast(ids), SURVEY_ID).groupBy("win_m")
                .agg(F.sum("n").alias("n_cases"), F.countDistinct(SURVEY_ID).alias("n_ids"))
                .withColumn("appended_total", F.lit(first + second).cast("long")))


# ----------------------------------------------------------------------- imputation

def impute_score_gate(spark: SparkSession, sf: str) -> DataFrame:
    """M8 + A13 + F14: hold-out R2 of the score regression decides the branch; at
    R2 <= 0.15 the exact median fills the missing scores; then clip to [0, 100]."""
    from tallyrake.operators import impute as I
    df, _ = _prepared(spark, sf, persist=True)
    out, method = I.impute_numeric(df, I.NUMERIC_TARGET, I.PREDICTORS[I.NUMERIC_TARGET], I.score_r2(df))
    out = out.withColumn(I.NUMERIC_TARGET, F.least(F.greatest(F.col(I.NUMERIC_TARGET), F.lit(0.0)), F.lit(100.0)))
    return r6(out.select("encuesta", I.NUMERIC_TARGET, F.lit(method).alias("method")))


def impute_score_regression(spark: SparkSession, sf: str) -> DataFrame:
    """M8, regression branch: the observed scores are set to a line in age and sex (the input
    only), so the hold-out R2 passes the gate and the fit fills the missing ones on that line."""
    from tallyrake.operators import impute as I
    df, _ = _prepared(spark, sf, persist=True)
    line = F.col("edad") * 0.5 + F.when(F.col("sexo") == "femenino", 20.0).otherwise(0.0)
    df = df.withColumn(I.NUMERIC_TARGET, F.when(F.col(I.NUMERIC_TARGET).isNotNull(), line))
    out, method = I.impute_numeric(df, I.NUMERIC_TARGET, I.PREDICTORS[I.NUMERIC_TARGET], I.score_r2(df))
    return out.select("encuesta", F.round(I.NUMERIC_TARGET, 4).alias(I.NUMERIC_TARGET), F.lit(method).alias("method"))


def impute_votes_chain(spark: SparkSession, sf: str) -> DataFrame:
    """M7 + M9 + F15 + F18: previous vote, then vote (using the imputed previous
    vote), each with a logistic model fit on the survey's complete cases."""
    from tallyrake.operators import impute as I
    df, _ = _prepared(spark, sf, persist=True)         # read by every fit of the chain
    for t in I.CATEGORICAL_TARGETS:
        df = I.impute_categorical(df, t, I.PREDICTORS[t])
    return df.select("encuesta", "win_m", norm_text("voto_anterior").alias("voto_anterior"),
                     norm_text("voto").alias("voto"))


def model_eval_vote(spark: SparkSession, sf: str) -> DataFrame:
    """M4 + M5 + A14: stratified 70/30 split, vote classifier, per-class report + accuracy."""
    from tallyrake.operators import impute as I
    df, _ = _prepared(spark, sf, persist=True)
    data = I.with_id(df, [*I.PREDICTORS["voto"], "voto"])
    tr, te = I.split(data, "voto")
    m = I.fit_classifier(tr, I.PREDICTORS["voto"], "voto", I.dummy_levels(data, I.PREDICTORS["voto"]))
    return r6(I.classifier_report(m.transform(I.aggregate_cases(te, I.PREDICTORS["voto"], "voto")), "voto"))


def split_vote_counts(spark: SparkSession, sf: str) -> DataFrame:
    """M4: interviews of each class on either side of the stratified split."""
    from tallyrake.operators import impute as I
    df, _ = _prepared(spark, sf)
    sides = I.split(I.with_id(df, [*I.PREDICTORS["voto"], "voto"]), "voto")
    both = [x.withColumn("side", F.lit(name)) for name, x in zip(("train", "test"), sides)]
    return r6(both[0].unionByName(both[1]).groupBy("voto", "side").agg(
        F.count(F.lit(1)).alias("n"), F.avg("edad").alias("mean_age"), F.sum(F.col("encuesta").cast("long")).alias("id_sum")))


def report_vote_rule(spark: SparkSession, sf: str) -> DataFrame:
    """M5: the classifier report, with "votes as before" as the prediction."""
    from tallyrake.operators import impute as I
    df, _ = _prepared(spark, sf)
    cases = I.aggregate_cases(df, I.PREDICTORS["voto"], "voto").withColumn(
        "voto_pred", F.when(F.col("voto_anterior") == "no_voto", "c").otherwise(F.col("voto_anterior")))
    return r6(I.classifier_report(cases, "voto").select("cls", "support", "n_pred", "tp", "precision", "recall", "f1", "accuracy"))


def report_score_rule(spark: SparkSession, sf: str) -> DataFrame:
    """M6: the regression report, with a line in the age as the prediction."""
    from tallyrake.operators import impute as I
    df, _ = _prepared(spark, sf)
    cases = I.aggregate_cases(df, I.PREDICTORS[I.NUMERIC_TARGET], I.NUMERIC_TARGET).withColumn(
        f"{I.NUMERIC_TARGET}_pred", F.col("edad") * 0.5 + 20)
    return r6(I.regression_report(cases, I.NUMERIC_TARGET))


def train_score_cold_start(spark: SparkSession, sf: str) -> DataFrame:
    """Cold start (empty history) -> three models trained on
    observed values and stored -> loaded back -> batch scoring of every interview."""
    from tallyrake.operators import impute as I
    from tallyrake.session import scratch_path
    df, _ = _prepared(spark, sf, persist=True)
    model_dir = scratch_path(spark, "models")
    I.update_all_models(df, model_dir)
    scored = I.score(df.select("encuesta", *I.PREDICTORS[I.NUMERIC_TARGET]), model_dir)
    return r6(scored.select("encuesta", "voto_anterior_pred", "voto_pred", "probabilidades_voto",
                            "imagen_del_candidato_pred"))


def process_impute_rake_track(spark: SparkSession, sf: str) -> DataFrame:
    """Entry 1 + Entry 2 end to end: clean -> recode -> impute (temporary models) ->
    day / week / month buckets -> rake each unit to convergence -> weekly vote shares
    with 95 % intervals on the imputed, weighted survey."""
    from tallyrake.plans.process import process_survey
    res = process_survey(spark, survey_view(spark, sf), "pampeana", impute=True)
    return r6(trk.vote_intervals(res.weighted, "win_s", "peso_s"))


def survey_null_profile_imputed(spark: SparkSession, sf: str) -> DataFrame:
    """A12 after imputation: null percentage per column once the chain has filled the votes
    and the score."""
    from tallyrake.operators.impute import impute_survey
    df, _ = _prepared(spark, sf, persist=True)
    return r6(null_profile(impute_survey(df).imputed.select(*SURVEY_COLUMNS)))


def ols_level_means(spark: SparkSession, sf: str) -> DataFrame:
    """M1, M3: score regression on all complete cases; a least-squares fit with dummies gives
    each level its observed mean, so the mean prediction per level is checked against SQL."""
    from tallyrake.operators import impute as I
    df, _ = _prepared(spark, sf, persist=True)
    preds = I.PREDICTORS[I.NUMERIC_TARGET]
    cases = I.aggregate_cases(df, preds, I.NUMERIC_TARGET)
    out = I.fit_regressor(df, preds, I.NUMERIC_TARGET).transform(cases)
    long = out.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("level"))
                                          for c in preds if c not in I.NUMERIC_PREDICTORS])).alias("l"),
                      F.col(f"{I.NUMERIC_TARGET}_pred").alias("p"), F.col(I.WEIGHT).alias("w"))
    return long.groupBy("l.variable", "l.level").agg(
        F.sum("w").cast("long").alias("n"), F.round(F.sum(F.col("p") * F.col("w")) / F.sum("w"), 4).alias("mean_pred"))


def logit_class_shares(spark: SparkSession, sf: str) -> DataFrame:
    """M1, M2: vote classifier on all complete cases; with a free intercept the mean probability
    of a class is its share of the cases, which SQL counts."""
    from pyspark.ml.functions import vector_to_array

    from tallyrake.operators import impute as I
    df, _ = _prepared(spark, sf, persist=True)
    preds = I.PREDICTORS["voto"]
    cases = I.aggregate_cases(df, preds, "voto")
    model = I.fit_classifier(df, preds, "voto")
    labels = model.stages[-1].getLabels()
    prob = vector_to_array(F.col("probability"))
    long = model.transform(cases).select(F.col(I.WEIGHT).alias("w"), F.explode(F.arrays_zip(
        F.array(*[F.lit(x) for x in labels]).alias("cls"), prob.alias("p"))).alias("z"))
    return long.groupBy(F.col("z.cls").alias("cls")).agg(
        F.sum("w").cast("long").alias("n"), F.round(F.sum(F.col("z.p") * F.col("w")) / F.sum("w"), 3).alias("mean_prob"))


def _optimality(spark, sf, target):
    """Per class and dummy, sum of w p x + coefficient / C: at the optimum of the penalised
    likelihood, and nowhere else, it is the sum of w x over the cases of that class."""
    from pyspark.ml.functions import vector_to_array

    from tallyrake.operators import impute as I
    df, _ = _prepared(spark, sf, persist=True)
    preds = I.PREDICTORS[target]
    cases = I.aggregate_cases(df, preds, target)
    model = I.fit_classifier(df, preds, target)
    table = I.coefficient_table(spark, model)
    cats = [c for c in preds if c not in I.NUMERIC_PREDICTORS]
    x = F.array(F.struct(F.lit("intercept").alias("predictor"), F.lit("").alias("level"), F.lit(1.0).alias("x")),
                *[F.struct(F.lit(c).alias("predictor"), F.col(c).alias("level"), F.lit(1.0).alias("x")) for c in cats],
                *[F.struct(F.lit(c).alias("predictor"), F.lit("").alias("level"), F.col(c).cast("double").alias("x"))
                  for c in preds if c in I.NUMERIC_PREDICTORS])
    probs = F.arrays_zip(F.array(*[F.lit(v) for v in model.stages[-1].getLabels()]).alias("cls"), vector_to_array("probability").alias("p"))
    sums = (model.transform(cases).select(F.col(I.WEIGHT).alias("w"), F.explode(probs).alias("z"), x.alias("xs"))
            .select("w", "z", F.explode("xs").alias("x"))
            .groupBy(F.col("z.cls").alias("cls"), "x.predictor", "x.level").agg(F.sum(F.col("w") * F.col("z.p") * F.col("x.x")).alias("s")))
    penalty = F.when(F.col("predictor") == "intercept", 0.0).otherwise(F.col("coefficient") / I.C_INVERSE_REG)
    return sums.join(F.broadcast(table), ["cls", "predictor", "level"]).select(
        "cls", "predictor", "level", F.round(F.col("s") + penalty, 0).cast("long").alias("total"))


def logit_optimality_vote(spark: SparkSession, sf: str) -> DataFrame:
    """M2, M7: the vote classifier against the equations of its optimum."""
    return _optimality(spark, sf, "voto")


def ledger_checks(spark: SparkSession, sf: str) -> DataFrame:
    """A run per territory name; names outside the population catalogue are
    rejected, the others are stored and listed newest first with the total."""
    from tallyrake.session import scratch_path
    from tallyrake.sources import ledger as L
    df, _ = _prepared(spark, sf)
    runs = df.groupBy("estrato").agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.concat(F.lit("run-"), F.col("estrato")).alias("run_id"), F.current_timestamp().alias("run_ts"),
        F.col("estrato").alias("population"), "n_rows", F.array(F.lit("sexo")).alias("calib_vars"))
    path = scratch_path(spark, "ledger")
    bad = L.append_runs(runs, path)
    L.append_runs(runs, path)                          # a repeated job adds nothing
    listed, total = L.list_runs(spark, path)
    return (listed.select("run_id", "population", "n_rows", F.lit("stored").alias("state"))
            .unionByName(bad.select("run_id", "population", "n_rows", F.lit("rejected").alias("state")))
            .withColumn("total", F.lit(total).cast("long")))


def process_entry_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Entry 1 as one call: impute, retrain, rake by day, week and month, report and ledger; the
    stored run with its metrics, the nulls left in the imputed columns, and the windows raked."""
    from tallyrake.plans.process import process_entry
    from tallyrake.session import scratch_path
    from tallyrake.sources import ledger as L
    path = scratch_path(spark, "ledger")
    res = process_entry(spark, survey_view(spark, sf), "pampeana", "run-1", path, scratch_path(spark, "models"))
    nulls = res.null_profile.filter(F.col("column").isin("voto", "voto_anterior", "imagen_del_candidato")).agg(
        F.sum("null_pct").alias("null_pct_left")).first()[0]
    windows = {f"{u}s_{k}": F.lit(v) for u, d in res.process.diagnostics.items()
               for k, v in d.agg(F.count("*").alias("all"), F.count_if(F.col("status") == "ok").alias("raked")).first().asDict().items()}
    return r6(L.history_with_metrics(spark, path).drop("run_ts").withColumns({"null_pct_left": F.lit(nulls), **windows}))


# ----------------------------------------------------------------------- streaming

def stream_week_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Structured Streaming: the survey view arrives as three CSV uploads (one per
    micro-batch); each batch is cleaned, de-duplicated against stored interviews and
    only its touched weeks are re-raked, to tolerance.  The final weights equal the
    batch weekly rake."""
    from tallyrake.session import scratch_path
    from tallyrake.sources.survey_csv import REQUIRED_COLUMNS
    from tallyrake.streaming.incremental import start_incremental_rake
    inbox, store, ckpt = (scratch_path(spark, n) for n in ("inbox", "store", "stream-ckpt"))
    upload = survey_view(spark, sf).select(
        *[F.col("integrantes_hogar" if c == "cantidad_de_integrantes_en_el_hogar" else c).alias(c)
          for c in REQUIRED_COLUMNS])
    (upload.repartition(3, "encuesta").write.option("header", True)
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(inbox))
    q = start_incremental_rake(spark, inbox, store, ckpt, "pampeana", unit="week",
                               max_files_per_trigger=1)
    q.awaitTermination()
    return r6(spark.read.parquet(f"{store}/weighted").select("encuesta", "win_s", "peso"))


QUERIES = {
    "survey_clean": survey_clean,
    "survey_dedup_lines": survey_dedup_lines,
    "survey_null_profile": survey_null_profile,
    "survey_normalize_nacional": survey_normalize_nacional,
    "survey_normalize_bsas": survey_normalize_bsas,
    "window_counts": window_counts,
    "rake_month_weights": rake_month_weights,
    "rake_month_diagnostics": rake_month_diagnostics,
    "rake_week_diagnostics": rake_week_diagnostics,
    "rake_day_diagnostics": rake_day_diagnostics,
    "rake_units_weights": rake_units_weights,
    "rake_month_bsas": rake_month_bsas,
    "rake_month_native": rake_month_native,
    "rake_month_nacional_diagnostics": rake_month_nacional_diagnostics,
    "track_score_month": track_score_month,
    "track_vote_month": track_vote_month,
    "track_vote_month_wide": track_vote_month_wide,
    "track_vote_month_melt": track_vote_month_melt,
    "intervals_score_month": intervals_score_month,
    "intervals_score_shifted": intervals_score_shifted,
    "intervals_vote_month": intervals_vote_month,
    "track_events_day": track_events_day,
    "vote_events_week": vote_events_week,
    "intervals_events_week": intervals_events_week,
    "test_stats_first_last_week": test_stats_first_last_week,
    "test_stats_events_weeks": test_stats_events_weeks,
    "test_decision_first_last_week": test_decision_first_last_week,
    "test_decision_events_days": test_decision_events_days,
    "report_metrics": report_metrics,
    "report_asmd": report_asmd,
    "report_weight_summary": report_weight_summary,
    "report_sample_vs_target": report_sample_vs_target,
    "calibration_value_shares": calibration_value_shares,
    "survey_csv_load": survey_csv_load,
    "survey_csv_quoted": survey_csv_quoted,
    "survey_sorted_output": survey_sorted_output,
    "ledger_newest_first": ledger_newest_first,
    "calibration_targets_bsas": calibration_targets_bsas,
    "ledger_history": ledger_history,
    "history_monthly_batches": history_monthly_batches,
    "impute_score_gate": impute_score_gate,
    "impute_score_regression": impute_score_regression,
    "impute_votes_chain": impute_votes_chain,
    "model_eval_vote": model_eval_vote,
    "split_vote_counts": split_vote_counts,
    "report_vote_rule": report_vote_rule,
    "report_score_rule": report_score_rule,
    "train_score_cold_start": train_score_cold_start,
    "survey_null_profile_imputed": survey_null_profile_imputed,
    "ols_level_means": ols_level_means,
    "logit_class_shares": logit_class_shares,
    "logit_optimality_vote": logit_optimality_vote,
    "ledger_checks": ledger_checks,
    "process_entry_ledger": process_entry_ledger,
    "stream_week_weights": stream_week_weights,
    "process_impute_rake_track": process_impute_rake_track,
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Survey -> clean -> recode -> month buckets -> rake to convergence (tol 5e-4) ->
    trim -> normalise -> weighted mean score per month (with the rake status)."""
    df, flag = _prepared(spark, sf)
    res = rake(df, "win_m", calibration_variables("pampeana", flag),
               calibration_targets(spark, "pampeana", flag), weight_col="peso")
    track = trk.score_intervals(res.weighted, "win_m", "peso")
    return r6(track.join(res.diagnostics.select("win_m", "status", "iterations"), "win_m", "left"))


QUERIES["flagship_track_month"] = flagship


# ----------------------------------------------------------------------- bench workloads
# The production shapes (rake to convergence, tol 5e-4), timed by bench.py.

def bench_rake_month(spark: SparkSession, sf: str) -> DataFrame:
    df, flag = _prepared(spark, sf, persist=True)
    res = rake(df, "win_m", calibration_variables("pampeana", flag), calibration_targets(spark, "pampeana", flag))
    return res.weighted


def bench_rake_week(spark: SparkSession, sf: str) -> DataFrame:
    df, flag = _prepared(spark, sf, persist=True)
    res = rake(df, "win_s", calibration_variables("pampeana", flag), calibration_targets(spark, "pampeana", flag))
    return res.weighted


def bench_tracking_intervals(spark: SparkSession, sf: str) -> DataFrame:
    w = bench_rake_month(spark, sf)
    s = trk.score_intervals(w, "win_m", "peso")
    v = trk.vote_intervals(w, "win_m", "peso", cands=["a", "b", "c"])
    return v.join(s, "win_m")


def bench_report(spark: SparkSession, sf: str) -> DataFrame:
    from tallyrake.operators.report import asmd, report_rake, weight_metrics, weight_summary
    df, flag = _prepared(spark, sf, persist=True)
    rep = report_rake(df, calibration_variables("pampeana", flag), calibration_targets(spark, "pampeana", flag))
    return (weight_summary(rep).select("stat", "value")
            .unionByName(asmd(rep).select(F.col("variable").alias("stat"), F.col("asmd_after").alias("value")))
            .unionByName(weight_metrics(rep).select(F.lit("deff").alias("stat"), F.col("deff").alias("value"))))


def bench_test_consecutive(spark: SparkSession, sf: str) -> DataFrame:
    from tallyrake.operators.hypothesis import test_change
    df, _ = _prepared(spark, sf, persist=True)
    return test_change(df, "win_s", "imagen_del_candidato", "consecutive")


def bench_impute_score(spark: SparkSession, sf: str) -> DataFrame:
    from tallyrake.operators import impute as I
    from tallyrake.session import scratch_path
    df, _ = _prepared(spark, sf, persist=True)       # read by every fit and by the scoring
    imputed = I.impute_survey(df).imputed
    model_dir = scratch_path(spark, "bench-models")
    I.update_all_models(df, model_dir)
    return I.score(imputed.select("encuesta", *I.PREDICTORS[I.NUMERIC_TARGET]), model_dir)


BENCH = {
    "rake_month": bench_rake_month,
    "rake_week": bench_rake_week,
    "tracking_intervals": bench_tracking_intervals,
    "report": bench_report,
    "test_consecutive_weeks": bench_test_consecutive,
    "impute_score": bench_impute_score,
}
