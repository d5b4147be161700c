"""Supervised imputation, evaluation, incremental retraining and batch scoring: M1-M12.

Chained order (the reference's): ``voto_anterior`` <- edad, sexo, estrato,
nivel_educativo; ``voto`` <- + voto_anterior (imputed); ``imagen_del_candidato`` <-
+ voto, voto_anterior.  Categorical targets use multinomial logistic regression, the
score uses OLS unless its R2 on a 70/30 split is <= 0.15, in which case the exact
median fills it.

Encoding (M1, J6): drop-first one-hot of the sorted training levels, numbers pass
through, unseen or null levels give all zeros.  The dictionary of levels
and the sparse indicators are stages *inside* the saved ``PipelineModel``, so the encoding used at training is the
one used at imputation and scoring (fixes D1 / D2 of the survey).  Every fit is a
distributed ``pyspark.ml`` fit over the complete cases; nothing is collected but the
level lists (bounded by the category cardinality) and the metrics.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrake.functions.recode import norm_text
from tallyrake.session import cut_lineage

# Predictors per target (chained order), gates and split.
PREDICTORS = {
    "voto_anterior": ["edad", "sexo", "estrato", "nivel_educativo"],
    "voto": ["edad", "sexo", "estrato", "nivel_educativo", "voto_anterior"],
    "imagen_del_candidato": ["edad", "sexo", "estrato", "nivel_educativo", "voto", "voto_anterior"],
}
CATEGORICAL_TARGETS = ["voto_anterior", "voto"]
NUMERIC_TARGET = "imagen_del_candidato"
NUMERIC_PREDICTORS = {"edad"}
R2_GATE = 0.15
MIN_CASES = 10
TRAIN_FRACTION = 0.7
SPLIT_SEED = 42
MAX_ITER = 2000
C_INVERSE_REG = 1.0
SCORE_RANGE = (0.0, 100.0)

FEATURES = "features"
LABEL = "_label"
PRED_INDEX = "_pred_idx"


class ImputationError(ValueError):
    pass


# ----------------------------------------------------------------------- encoding (M1)

def level_sets(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted distinct non-null values of several columns in **one** pass, distributed by (column,
    value); the driver gets the lists, which are part of the model it keeps."""
    if not columns:
        return {}
    named = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    out: dict[str, list[str]] = {c: [] for c in columns}
    for c, v in df.select(F.explode(named).alias("x")).select("x.*").filter("v is not null").distinct().toLocalIterator():
        out[c].append(v)
    return {c: sorted(v) for c, v in out.items()}


def dummy_levels(df: DataFrame, predictors: list[str]) -> dict[str, list[str]]:
    """Sorted distinct levels of each categorical predictor, first level dropped."""
    cats = [c for c in predictors if c not in NUMERIC_PREDICTORS]
    return {c: v[1:] for c, v in level_sets(df, cats).items()}


def encoding_stages(predictors: list[str], levels: dict[str, list[str]]) -> list:
    """Dictionary lookup, sparse indicators and assembler; the stored training levels decide, so a
    row's encoding never depends on its own batch.

    The first level is left out of the dictionary: it, unseen levels and null share the index after
    the last one, which the encoder drops, so all three give zeros."""
    cats = [c for c in predictors if c not in NUMERIC_PREDICTORS and levels[c]]
    names = [c if c in NUMERIC_PREDICTORS else f"_d_{c}" for c in predictors if c in NUMERIC_PREDICTORS or c in cats]
    stages: list = []
    if cats:
        stages = [StringIndexerModel.from_labels(levels[c], inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep") for c in cats]
        none = SparkSession.active().createDataFrame([], ", ".join(f"`{c}` string" for c in cats))
        for st in stages:
            none = st.transform(none)
        stages.append(OneHotEncoder(inputCols=[f"_i_{c}" for c in cats], outputCols=[f"_d_{c}" for c in cats],
                                    dropLast=True).fit(none))             # sizes are in the columns' metadata
    return [*stages, VectorAssembler(inputCols=names, outputCol=FEATURES, handleInvalid="keep")]


TEXT_COLUMNS = ["sexo", "estrato", "nivel_educativo", "voto", "voto_anterior"]


def normalize_text_columns(df: DataFrame, columns: list[str] = TEXT_COLUMNS) -> DataFrame:
    """F16: null-preserving trim + lower of the model's text columns.  Applied before
    training *and* before imputation, so history never holds ``A`` and ``a`` as two
    classes (D3)."""
    return df.withColumns({c: norm_text(c) for c in columns if c in df.columns})


#: Most features that Spark's normal equations take (it holds a triangle of their products).
NORMAL_FEATURES = 4000

# ----------------------------------------------------------------------- split (M4)

SPLIT_ID = "encuesta"


TRAIN = "_train"


def split_sides(df: DataFrame, target: str | None = None, fraction: float = TRAIN_FRACTION, seed: int = SPLIT_SEED) -> DataFrame:
    """Deterministic 70/30 split, stratified by ``target``, as the column ``_train``: of each class
    the first ``floor(fraction * n + 0.5)`` interviews in the order of ``md5(seed|id)`` are the
    training side (without an id column: of all columns; equal rows are interchangeable).

    The hash depends on the interview alone, so membership is the same under any
    partitioning and when a stage is run again.  Counts by (class, 16-bit hash bucket) give the
    one bucket of each class where the training side ends; only that bucket's rows are ranked,
    every other row is told by its own bucket, so the survey is neither shuffled nor sorted."""
    cls = F.coalesce(F.col(target).cast("string"), F.lit("")) if target else F.lit("")
    key = [SPLIT_ID] if SPLIT_ID in df.columns else df.columns
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    tagged = (df.withColumns({"_cls": cls, "_h": F.md5(text)})
                .withColumn("_bucket", F.substring("_h", 1, 4)))
    own = Window.partitionBy("_cls")             # at most 65,536 buckets a class
    upto = F.sum("_n").over(own.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    left = F.floor(fraction * F.sum("_n").over(own) + 0.5) - (upto - F.col("_n"))
    cuts = cut_lineage(tagged.groupBy("_cls", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
                       .select("_cls", F.col("_bucket").alias("_cut"), "_n", left.alias("_left"))
                       .filter("_left >= 0 and _left < _n").drop("_n"))            # a row per class; none if all train
    sides = tagged.join(F.broadcast(cuts), "_cls", "left")
    rank = F.row_number().over(own.orderBy("_h", *key))
    edge = cut_lineage(sides.filter("_bucket = _cut").withColumn(TRAIN, rank <= F.col("_left"))
                       .select(*df.columns, TRAIN))
    others = sides.filter("_cut is null or _bucket != _cut").withColumn(TRAIN, F.expr("_cut is null or _bucket < _cut"))
    return others.select(*df.columns, TRAIN).union(edge)


def split(df: DataFrame, target: str | None = None, fraction: float = TRAIN_FRACTION, seed: int = SPLIT_SEED,
          ) -> tuple[DataFrame, DataFrame]:
    """The training and the test side of ``split_sides``."""
    sides = split_sides(df, target, fraction, seed)
    return sides.filter(TRAIN).drop(TRAIN), sides.filter(~F.col(TRAIN)).drop(TRAIN)


def split_cases(data: DataFrame, predictors: list[str], target: str, stratify: str | None = None) -> DataFrame:
    """Both sides collapsed to distinct (side, predictors, target) rows with a count by one pass over
    the interviews; persisted, and read by the level lists, the fit and the report."""
    return (split_sides(data, stratify).groupBy(TRAIN, *predictors, target)
            .agg(F.count(F.lit(1)).cast("double").alias(WEIGHT)).persist(StorageLevel.MEMORY_AND_DISK))


def with_id(df: DataFrame, columns: list[str]) -> DataFrame:
    """Complete cases of ``columns``, with the interview id where the survey has one."""
    extra = [SPLIT_ID] if SPLIT_ID in df.columns and SPLIT_ID not in columns else []
    return df.select(*extra, *columns).dropna(subset=columns)


# ----------------------------------------------------------------------- fits (M2, M3)

WEIGHT = "_cases"
# Distinct cases per partition of the (small) fitting table: every optimiser pass is
# one task per partition, so the partition count follows the table size.
CASES_PER_PARTITION = 200_000


def aggregate_cases(df: DataFrame, predictors: list[str], target: str) -> DataFrame:
    """Complete cases collapsed to distinct (predictors, target) rows with a count.

    A weighted fit on this table has exactly the row-level likelihood, while every
    optimiser pass reads at most the number of distinct cases instead of every
    interview.  Pre-aggregation has map-side combine, so duplicated profiles cost
    nothing extra."""
    w = F.col(WEIGHT) if WEIGHT in df.columns else F.lit(1)           # cases counted before
    return (df.select(*predictors, target, w.alias(WEIGHT)).dropna()
              .groupBy(*predictors, target).agg(F.sum(WEIGHT).cast("double").alias(WEIGHT)))


def aggregate_profiles(df: DataFrame, predictors: list[str], target: str) -> DataFrame:
    """Complete cases collapsed to distinct predictor profiles: mean target and count.

    Rows of one profile share the design row, so weighted least squares on
    (profile, mean, count) has the row-level OLS normal equations; the table is
    bounded by the product of the predictor levels, whatever the number of rows."""
    if WEIGHT in df.columns:                                          # cases counted before
        mean, n = F.sum(F.col(target) * F.col(WEIGHT)) / F.sum(WEIGHT), F.sum(WEIGHT)
    else:
        mean, n = F.avg(target), F.count(F.lit(1)).cast("double")
    kept = [WEIGHT] if WEIGHT in df.columns else []
    return (df.select(*predictors, F.col(target).cast("double").alias(target), *kept).dropna()
              .groupBy(*predictors).agg(mean.alias(target), n.alias(WEIGHT)))


def _fit_input(agg: DataFrame, predictors: list[str], levels: dict[str, list[str]] | None, label_stages: list, label_col: str):
    """Rows, total weight and level lists; then the feature table of sparse vectors, sized to
    ~CASES_PER_PARTITION rows per partition and persisted for the optimiser passes.  ``agg`` is
    persisted by the caller and filled by the count here, each of its partitions by a task of
    its own: the few tasks that read it afterwards aggregate nothing."""
    cats = [c for c in predictors if c not in NUMERIC_PREDICTORS]
    row = agg.agg(F.count(F.lit(1)).alias("_rows"), F.sum(WEIGHT).alias("_n")).first()
    levels = levels or {c: v[1:] for c, v in level_sets(agg, cats).items()}
    enc = encoding_stages(predictors, levels)
    x = agg
    for st in label_stages:
        x = st.transform(x)
    for st in enc:
        x = st.transform(x)
    feats = x.select(FEATURES, label_col, WEIGHT)
    parts = max(1, -(-(row["_rows"] or 0) // CASES_PER_PARTITION))
    feats = feats.coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)
    return feats, enc, (row["_n"] or 0.0)


def fit_classifier(train: DataFrame, predictors: list[str], target: str,
                   levels: dict[str, list[str]] | None = None) -> PipelineModel:
    """Multinomial (or binary) logistic regression with L2, C = 1 in the reference's
    scale (``regParam = 1 / (C n)``), no standardisation, intercept unpenalised;
    fit on the aggregated complete cases with their counts as weights."""
    agg = aggregate_cases(train, predictors, target).persist(StorageLevel.MEMORY_AND_DISK)
    feats = None
    try:
        labels = level_sets(agg, [target])[target]
        if len(labels) == 0:
            raise ImputationError(f"no complete cases to train {target}")
        if len(labels) < 2:
            raise ImputationError(f"{target} has a single class; cannot train")
        indexer = StringIndexerModel.from_labels(labels, inputCol=target, outputCol=LABEL)
        feats, enc, n = _fit_input(agg, predictors, levels, [indexer], LABEL)
        lr = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, predictionCol=PRED_INDEX,
                                weightCol=WEIGHT, family="auto", regParam=1.0 / (C_INVERSE_REG * n),
                                elasticNetParam=0.0, standardization=False, maxIter=MAX_ITER)
        model = lr.fit(feats)
    finally:
        if feats is not None:
            feats.unpersist()
        agg.unpersist()
    back = IndexToString(inputCol=PRED_INDEX, outputCol=f"{target}_pred", labels=labels)
    return PipelineModel(stages=[*enc, model, back])


def coefficient_table(spark, model: PipelineModel) -> DataFrame:
    """``(cls, predictor, level, coefficient)`` of a classifier or regressor (``cls`` null), with the
    intercepts; a binary classifier is told as its two classes with opposite halves."""
    at = next(i for i, st in enumerate(model.stages) if isinstance(st, VectorAssembler))
    fitted, names = model.stages[at + 1], []
    levels = {st.getInputCol(): st.labels for st in model.stages[:max(0, at - 1)]}
    for c in model.stages[at].getInputCols():
        names += [(c[3:], v) for v in levels[c[3:]]] if c.startswith("_d_") else [(c, "")]
    if hasattr(fitted, "coefficientMatrix"):
        classes, matrix = model.stages[at + 2].getLabels(), fitted.coefficientMatrix.toArray()
        intercepts = list(fitted.interceptVector.toArray())
        if len(matrix) == 1:
            matrix, intercepts = [-matrix[0] / 2, matrix[0] / 2], [-intercepts[0] / 2, intercepts[0] / 2]
    else:
        classes, matrix, intercepts = [None], [fitted.coefficients.toArray()], [fitted.intercept]
    rows = [(k, *name, float(v)) for k, line in zip(classes, matrix) for name, v in zip(names, line)]
    rows += [(k, "intercept", "", float(v)) for k, v in zip(classes, intercepts)]
    return spark.createDataFrame(rows, "cls string, predictor string, level string, coefficient double")


def fit_regressor(train: DataFrame, predictors: list[str], target: str,
                  levels: dict[str, list[str]] | None = None) -> PipelineModel:
    """Ordinary least squares (no penalty) on predictor profiles: normal equations up to
    ``NORMAL_FEATURES`` indicators, beyond that by gradients to the same optimum."""
    agg = aggregate_profiles(train, predictors, target).persist(StorageLevel.MEMORY_AND_DISK)
    feats = None
    try:
        feats, enc, n = _fit_input(agg, predictors, levels, [], target)
        if n == 0:
            raise ImputationError(f"no complete cases to train {target}")
        width = sum(len(st.labels) for st in enc[:-2])
        model = LinearRegression(featuresCol=FEATURES, labelCol=target, predictionCol=f"{target}_pred",
                                 weightCol=WEIGHT, regParam=0.0, solver="normal" if width < NORMAL_FEATURES else "l-bfgs").fit(feats)
    finally:
        if feats is not None:
            feats.unpersist()
        agg.unpersist()
    return PipelineModel(stages=[*enc, model])


def _drop_model_cols(df: DataFrame) -> DataFrame:
    junk = [c for c in df.columns if c.startswith(("_d_", "_i_")) or c in (FEATURES, "rawPrediction", "probability",
                                                                   PRED_INDEX)]
    return df.drop(*junk)


# ----------------------------------------------------------------------- evaluation (M5, M6)

@dataclass
class Evaluation:
    r2_score: float
    metrics: dict[str, DataFrame] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)      # targets without a report, and why


def classifier_report(pred: DataFrame, target: str) -> DataFrame:
    """M5: per class precision, recall, F1, support, plus accuracy, from the
    confusion table ``groupBy(label, prediction).count()`` (classes^2 rows)."""
    conf = confusion(pred, target)
    tp = conf.filter(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("cls"),
                                                                   F.col("count").alias("tp"))
    sup = conf.groupBy(F.col("actual").alias("cls")).agg(F.sum("count").alias("support"))
    prd = conf.groupBy(F.col("predicted").alias("cls")).agg(F.sum("count").alias("n_pred"))
    rep = (sup.join(prd, "cls", "full").join(tp, "cls", "left").na.fill(0, ["tp", "support", "n_pred"])
              .withColumn("precision", F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0))
              .withColumn("recall", F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0))
              .withColumn("f1", F.when((F.col("precision") + F.col("recall")) > 0,
                                       2 * F.col("precision") * F.col("recall")
                                       / (F.col("precision") + F.col("recall"))).otherwise(0.0)))
    every = Window.partitionBy()      # one row per class: a tiny table
    return rep.withColumn("accuracy", F.sum("tp").over(every) / F.sum("support").over(every))


def confusion(pred: DataFrame, target: str) -> DataFrame:
    """Confusion counts; rows may carry a case count (aggregated cases)."""
    w = F.col(WEIGHT) if WEIGHT in pred.columns else F.lit(1.0)
    return (pred.groupBy(F.col(target).alias("actual"), F.col(f"{target}_pred").alias("predicted"))
                .agg(F.sum(w).cast("long").alias("count")))


def regression_report(pred: DataFrame, target: str) -> DataFrame:
    """M6: MAE, RMSE, R2 = 1 - SSE/SST in one aggregation."""
    y, p = F.col(target).cast("double"), F.col(f"{target}_pred")
    w = F.col(WEIGHT) if WEIGHT in pred.columns else F.lit(1.0)
    mean = pred.agg(F.try_divide(F.sum(w * y), F.sum(w))).first()[0]        # centred: no difference of large sums
    a = pred.agg(F.sum(w).alias("n"), F.sum(w * F.abs(y - p)).alias("_sae"), F.sum(w * F.pow(y - p, 2)).alias("_sse"),
                 F.sum(w * F.pow(y - F.lit(mean).cast("double"), 2)).alias("_sst"))
    sst = F.col("_sst")
    return a.select(F.col("n").cast("long").alias("n"), F.try_divide(F.col("_sae"), F.col("n")).alias("mae"),
                    F.sqrt(F.try_divide(F.col("_sse"), F.col("n"))).alias("rmse"),
                    F.when(sst > 0, 1 - F.col("_sse") / sst).alias("r2"))


def _score_report(df: DataFrame) -> DataFrame | None:
    """Hold-out report of the score regression (None below 10 complete cases)."""
    preds = PREDICTORS[NUMERIC_TARGET]
    cases = split_cases(with_id(df, [*preds, NUMERIC_TARGET]), preds, NUMERIC_TARGET)
    try:
        if (cases.agg(F.sum(WEIGHT)).first()[0] or 0) < MIN_CASES:
            return None
        m = fit_regressor(cases.filter(TRAIN), preds, NUMERIC_TARGET, dummy_levels(cases, preds))
        return cut_lineage(regression_report(m.transform(cases.filter(~F.col(TRAIN))), NUMERIC_TARGET))
    finally:
        cases.unpersist()


def _r2(report: DataFrame | None) -> float:
    val = report.first()["r2"] if report is not None else None
    return float(val) if val is not None else float("-inf")


def score_r2(df: DataFrame) -> float:
    """Hold-out R2 of the score regression (-inf below 10 complete cases)."""
    return _r2(_score_report(df))


def evaluate_models(df: DataFrame) -> Evaluation:
    """Hold-out evaluation of the three models on complete cases.

    Classifiers need >= 10 cases and >= 2 classes; the regression needs >= 10 cases,
    else its R2 is -inf (which sends the score to the median branch)."""
    metrics: dict[str, DataFrame] = {}
    skipped: dict[str, str] = {}
    for target in CATEGORICAL_TARGETS:
        preds = PREDICTORS[target]
        data = with_id(df, [*preds, target])
        if data.count() >= MIN_CASES and data.select(target).distinct().count() >= 2:
            tr, te = split(data, target)
            try:
                m = fit_classifier(tr, preds, target, dummy_levels(data, preds))
                out = m.transform(aggregate_cases(te, preds, target))
                metrics[f"{target}_report"] = classifier_report(out, target)
                metrics[f"{target}_confusion"] = confusion(out, target)
            except ImputationError as e:
                skipped[target] = str(e)
        else:
            skipped[target] = f"fewer than {MIN_CASES} complete cases or a single class"
    report = _score_report(df)
    if report is not None:
        metrics[f"{NUMERIC_TARGET}_report"] = report
    return Evaluation(_r2(report), metrics, skipped)


# ----------------------------------------------------------------------- imputation (M7-M9)

def impute_categorical(df: DataFrame, target: str, predictors: list[str],
                       model: PipelineModel | None = None) -> DataFrame:
    """M7: fill nulls of ``target`` with the stored model, else a temporary model fit
    on this survey's complete cases; ``coalesce(observed, predicted)``."""
    if df.filter(F.col(target).isNull()).isEmpty():
        return df
    if model is None:
        model = fit_classifier(df.filter(F.col(target).isNotNull()), predictors, target)
    return _fill_predicted(df, target, model)


def _fill_predicted(df: DataFrame, target: str, model: PipelineModel) -> DataFrame:
    out = model.transform(df)
    return _drop_model_cols(out.withColumn(target, F.coalesce(F.col(target), F.col(f"{target}_pred")))
                            .drop(f"{target}_pred"))


# Largest table of filled votes joined back by broadcast (estimated bytes); above it a shuffle join is used.
BROADCAST_BYTES = 64 << 20
PROFILE_BYTES = 320


def _norm(target: str) -> str:
    return f"_n_{target}"


def impute_votes(df: DataFrame, model_dir: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """M7 for both votes, in chained order: ``df`` with its missing votes filled, and each vote's
    normalised text (F15) beside it as ``_n_<vote>``.

    The interviews are counted once by predictors and votes.  Both models are fit on those counts
    and predict for the distinct profiles that lack a vote, not for every interview in every later
    pass.  Only rows that lack a vote carry a join key (a hash; the profile itself is compared too,
    so rows whose hashes agree by chance are not mixed)."""
    key = [*PREDICTORS["voto"], "voto"]
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        told = counted.withColumns({f"_k_{c}": F.col(c) for c in key})
        for target in CATEGORICAL_TARGETS:
            if told.filter(F.col(target).isNull()).isEmpty():
                continue
            model = load_model(df.sparkSession, model_dir, target)
            if model is None:
                model = fit_classifier(told.filter(F.col(target).isNotNull()), PREDICTORS[target], target)
            told = _fill_predicted(told, target, model)
        lacks = reduce(lambda a, b: a | b, [F.col(f"_k_{t}").isNull() for t in CATEGORICAL_TARGETS])
        fills = cut_lineage(told.filter(lacks).select(
            F.xxhash64(*[f"_k_{c}" for c in key]).alias("_h"), *[f"_k_{c}" for c in key],
            *[F.col(t).alias(f"_f_{t}") for t in CATEGORICAL_TARGETS],
            *[norm_text(t).alias(f"_f{_norm(t)}") for t in CATEGORICAL_TARGETS]))
    finally:
        counted.unpersist()
    missing = reduce(lambda a, b: a | b, [F.col(t).isNull() for t in CATEGORICAL_TARGETS])
    hashed = F.when(missing, F.xxhash64(*key))
    if fills.count() * PROFILE_BYTES <= broadcast_bytes:
        fills = F.broadcast(fills)
    else:
        hashed = hashed.otherwise(F.xxhash64(*df.columns))      # rows that match nothing are dealt to all tasks
    same = [F.col("_row_h") == F.col("_h"), *[F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key]]
    rows = df.withColumn("_row_h", hashed).join(fills, reduce(lambda a, b: a & b, same), "left")
    return rows.select(*[F.coalesce(F.col(c), F.col(f"_f_{c}")).alias(c) if c in CATEGORICAL_TARGETS else F.col(c) for c in df.columns],
                       *[F.coalesce(F.col(t), F.col(f"_f{_norm(t)}")).alias(_norm(t)) for t in CATEGORICAL_TARGETS])


def impute_numeric(df: DataFrame, target: str, predictors: list[str], r2: float,
                   model: PipelineModel | None = None, observed: DataFrame | None = None) -> tuple[DataFrame, str]:
    """M8: median (exact, over the whole column) when ``r2 <= 0.15`` or no complete
    case exists; else the stored or a temporary OLS model.  Returns (df, method).

    ``observed`` (default: ``df``) holds the same ``target`` values without the steps that filled
    the other columns; the nulls and the median are read there."""
    observed = df if observed is None else observed
    if observed.filter(F.col(target).isNull()).isEmpty():
        return df, "none"
    if r2 <= R2_GATE:
        return fill_median(df, target, observed), "median"
    if model is None:
        complete = df.select(*predictors, target).dropna()
        if complete.isEmpty():
            return fill_median(df, target, observed), "median"
        model = fit_regressor(complete, predictors, target)
    out = model.transform(df)
    return (_drop_model_cols(out.withColumn(target, F.coalesce(F.col(target).cast("double"),
                                                               F.col(f"{target}_pred")))
                             .drop(f"{target}_pred")), "regression")


def fill_median(df: DataFrame, target: str, observed: DataFrame | None = None) -> DataFrame:
    """Exact median of the observed values (of ``observed``, by default ``df``) fills the nulls
    (bounded selection, see ``functions.quantile``; never one task holding the whole column)."""
    from tallyrake.functions.quantile import exact_median
    med = exact_median(df if observed is None else observed, target)
    return df.withColumn(target, F.coalesce(F.col(target).cast("double"), F.lit(med).cast("double")))


@dataclass
class ImputeResult:
    imputed: DataFrame
    r2_score: float
    score_method: str
    evaluation: Evaluation


def model_r2(df: DataFrame, model: PipelineModel) -> float:
    """R2 of a given score model on this survey's complete cases (D8 option)."""
    preds = PREDICTORS[NUMERIC_TARGET]
    cases = aggregate_cases(df, preds, NUMERIC_TARGET)
    val = regression_report(model.transform(cases), NUMERIC_TARGET).first()["r2"]
    return float(val) if val is not None else float("-inf")


def impute_survey(df: DataFrame, model_dir: str | None = None, evaluate: str = "gate",
                  gate_on: str = "fresh", normalized: bool = False) -> ImputeResult:
    """Imputation: evaluate, impute in chained order, clip the score, normalise votes.

    ``evaluate``: ``'gate'`` computes only the score regression's hold-out R2 (the one
    number the imputation uses), ``'all'`` also the classifier reports, ``'none'``
    skips it (R2 = -inf, so the score takes the median).  ``gate_on='used'`` gates on
    the R2 of the stored score model when one is used (the reference always gates on
    a fresh model of this survey, D8).  ``model_dir`` holds stored
    models (``<dir>/<target>/model``); when absent or missing a model, a temporary
    model is fit on this survey.  ``normalized`` says that the text columns went through
    ``normalize_text_columns`` already (before the survey was persisted, so that its passes do not)."""
    spark = df.sparkSession
    df = df if normalized else normalize_text_columns(df)
    if evaluate == "all":
        ev = evaluate_models(df)
    elif evaluate == "gate":
        ev = Evaluation(score_r2(df))
    else:
        ev = Evaluation(float("-inf"))
    out = impute_votes(df, model_dir)
    stored = load_model(spark, model_dir, NUMERIC_TARGET)
    r2 = ev.r2_score
    if gate_on == "used" and stored is not None:
        r2 = model_r2(df, stored)
    out, method = impute_numeric(out, NUMERIC_TARGET, PREDICTORS[NUMERIC_TARGET], r2, stored, observed=df)
    lo, hi = SCORE_RANGE
    out = out.withColumns({
        NUMERIC_TARGET: F.least(F.greatest(F.col(NUMERIC_TARGET), F.lit(lo)), F.lit(hi)),   # F14
        **{t: F.col(_norm(t)) for t in CATEGORICAL_TARGETS},                                # F15
    }).drop(*[_norm(t) for t in CATEGORICAL_TARGETS])
    return ImputeResult(out, ev.r2_score, method, ev)


# ----------------------------------------------------------------------- storage, retraining

def _model_path(model_dir: str, target: str) -> str:
    return f"{model_dir.rstrip('/')}/{target}/model"


def _history_path(model_dir: str, target: str) -> str:
    return f"{model_dir.rstrip('/')}/{target}/history"


def load_model(spark: SparkSession, model_dir: str | None, target: str) -> PipelineModel | None:
    """The stored pipeline, or None when absent."""
    from tallyrake.session import path_exists
    if not model_dir or not path_exists(spark, _model_path(model_dir, target)):
        return None
    return PipelineModel.load(_model_path(model_dir, target))


def update_model(df_observed: DataFrame, target: str, model_dir: str, survey_id: str | None = None,
                 ) -> tuple[PipelineModel | None, int]:
    """Append this survey's complete cases (observed values only) to the
    target's history unless the survey is already there, refit on the whole history
    and store the model.  Returns (model or None, rows appended)."""
    from tallyrake.sources.history import SURVEY_ID, append_history, fingerprint, read_history, survey_columns
    spark = df_observed.sparkSession
    preds = PREDICTORS[target]
    data = df_observed.select(*preds, target).dropna()
    if data.isEmpty():
        return load_model(spark, model_dir, target), 0
    if survey_id is None:
        survey_id = fingerprint(df_observed, survey_columns(df_observed)).first()[SURVEY_ID]
    appended = append_history(spark, _history_path(model_dir, target), data.withColumn(SURVEY_ID, F.lit(survey_id)))
    hist = read_history(spark, _history_path(model_dir, target)).drop(SURVEY_ID)
    try:
        if target == NUMERIC_TARGET:
            model = fit_regressor(hist, preds, target)
        else:
            model = fit_classifier(hist, preds, target)
    except ImputationError:
        return load_model(spark, model_dir, target), appended
    model.write().overwrite().save(_model_path(model_dir, target))
    return model, appended


def update_all_models(df_observed: DataFrame, model_dir: str, normalized: bool = False) -> dict[str, int]:
    """Retrain the three models on their histories (one fingerprint for the survey); ``normalized``
    as in ``impute_survey``."""
    from tallyrake.sources.history import SURVEY_ID, fingerprint, survey_columns
    observed = df_observed if normalized else normalize_text_columns(df_observed)
    sid = fingerprint(observed, survey_columns(observed)).first()[SURVEY_ID]
    return {t: update_model(observed, t, model_dir, sid)[1] for t in PREDICTORS}


# ----------------------------------------------------------------------- scoring

def score(df: DataFrame, model_dir: str) -> DataFrame:
    """Batch scoring with the stored models: previous vote, vote, the vote's
    class probabilities as a map, and the score rounded to one decimal.  Each model
    encodes with its own stored training levels (fixes D1)."""
    spark = df.sparkSession
    models = {t: load_model(spark, model_dir, t) for t in PREDICTORS}
    missing = [t for t, m in models.items() if m is None]
    if missing:
        raise ImputationError(f"models not available: {missing}")
    out = _drop_model_cols(models["voto_anterior"].transform(df))
    vm = models["voto"]
    labels = vm.stages[-1].getLabels()
    out = vm.transform(out)
    out = out.withColumn("probabilidades_voto", F.map_from_arrays(
        F.array(*[F.lit(x) for x in labels]), vector_to_array(F.col("probability"))))
    out = _drop_model_cols(out)
    out = _drop_model_cols(models[NUMERIC_TARGET].transform(out))
    return out.withColumn(f"{NUMERIC_TARGET}_pred", F.round(F.col(f"{NUMERIC_TARGET}_pred"), 1))
