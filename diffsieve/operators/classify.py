"""Training and applying a text classifier with MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import percent, prefix, tokens
from ..schemas import FINDING_COLUMNS
from ..staging import stage
from .evaluate import class_balance, classification_metrics
from .scan import as_findings, unit_scores

FEATURES = 1 << 14
# Folds of out-of-fold scores; scores are rounded to 1/STEPS before they are calibrated, so that a calibration has that many points at most.
FOLDS, STEPS, BINS = 3, 1000, 10


def with_split(rows: DataFrame, key: str) -> DataFrame:
    """Fixed train/validation/test split by a digest of the id: 80/10/10."""
    digest = F.substring(F.md5(F.col(key).cast("string")), 1, 8)
    bucket = F.conv(digest, 16, 10).cast("bigint") % 10
    return rows.withColumn("split", F.when(bucket < 8, "train").when(bucket == 8, "validation").otherwise("test"))


def split_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def with_tokens(rows: DataFrame, text: str) -> DataFrame:
    """The first 512 words of a text."""
    return rows.withColumn("words", tokens(F.col(text), fv.MAX_TOKENS))


def pipeline(reg_param: float) -> Pipeline:
    return Pipeline(stages=[
        HashingTF(inputCol="words", outputCol="counts", numFeatures=FEATURES),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", regParam=reg_param, maxIter=20),
    ])


def fit(train: DataFrame, reg_param: float) -> PipelineModel:
    return pipeline(reg_param).fit(train)


def train_text_classifier(
    labelled: DataFrame, key: str, text: str, candidates: tuple[float, ...] = (0.01, 0.1)
) -> tuple[PipelineModel, DataFrame]:
    """The candidate with the best validation F1, and its metrics on validation and test.

    The test split is looked at once, by the chosen model. Expects a 0/1 column ``label``.
    """
    rows = stage(with_tokens(with_split(labelled, key), text).select(key, "words", "label", "split"))
    part = lambda name: rows.filter(F.col("split") == name)
    best = None
    for reg_param in candidates:
        model = fit(part("train"), reg_param)
        measured = classification_metrics(model.transform(part("validation")), ["split"]).first()
        f1 = measured["f1"] if measured else 0.0
        if best is None or f1 > best[0]:
            best = (f1, reg_param, model)
    _, reg_param, model = best
    held_out = model.transform(rows.filter(F.col("split") != "train"))
    baseline = class_balance(part("test"), "label").first()["majority_baseline"]
    result = classification_metrics(held_out, ["split"]).withColumns({
        "majority_baseline": F.lit(baseline).cast("double"), "reg_param": F.lit(reg_param),
    })
    return model, result


def score_texts(model: PipelineModel, rows: DataFrame, text: str) -> DataFrame:
    """Rows with ``score``, the probability of class 1."""
    scored = model.transform(with_tokens(rows, text))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop(
        "words", "counts", "features", "rawPrediction", "probability", "prediction"
    )


def score_units(model: PipelineModel, units: DataFrame) -> DataFrame:
    """Units with the model's score; where it has none, the weighted-pattern score stands in."""
    scored = score_texts(model, unit_scores(units).withColumnRenamed("score", "pattern_score"), "source")
    return scored.withColumn("score", F.coalesce(F.nanvl("score", F.lit(None).cast("double")), "pattern_score"))


def scored_findings(scored: DataFrame) -> DataFrame:
    """One finding per unit whose score passes."""
    passed = scored.filter(F.col("score") >= fv.SCORE_THRESHOLD)
    rows = passed.select(
        "review_id", "file_ord", F.lit(3).alias("layer"), F.col("unit_ord").alias("seq"), F.lit(0).alias("sub"),
        "filename", F.col("start_line").alias("line"),
        F.when(F.col("score") > fv.HIGH_SCORE, F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
        F.lit(fv.MODEL_CATEGORY).alias("category"),
        F.lit(None).cast("string").alias("cwe_id"), F.lit(None).cast("string").alias("owasp"),
        F.format_string(fv.MODEL_TEXT, F.col("name"), percent(F.col("score"))).alias("description"),
        F.lit(fv.SOURCE_UNITS).alias("source"),
        prefix(F.col("source"), fv.UNIT_SNIPPET).alias("code_snippet"),
    )
    return as_findings(rows).select(*FINDING_COLUMNS)


# ---- scores that mean probabilities -----------------------------------------------------------------------------------


def out_of_fold(
    labelled: DataFrame, key: str, text: str, candidates: tuple[float, ...] = (0.01, 0.1), folds: int = FOLDS
) -> tuple[PipelineModel, DataFrame]:
    """The classifier of the best candidate by cross-validation, fitted on all rows, and ``key, label, fold, score`` of every row by a model
    that has not seen its fold. Folds follow a digest of the key. Expects a 0/1 column ``label``."""
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string")), 9, 8), 16, 10).cast("bigint")
    whole = pipeline(candidates[0])
    hashing, *later = whole.getStages()
    # words are hashed once; folds and candidates fit on the counts
    rows = stage(hashing.transform(with_tokens(labelled, text).select(
        key, "words", F.col("label").cast("double").alias("label"), (digest % folds).cast("int").alias("fold"))).drop("words"))
    estimator = Pipeline(stages=later)
    regression = later[-1]
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=ParamGridBuilder().addGrid(regression.regParam, list(candidates)).build(),
        evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=folds, foldCol="fold", collectSubModels=True)
    found = search.fit(rows)
    best = max(range(len(candidates)), key=lambda i: found.avgMetrics[i])
    parts = None
    for fold in range(folds):
        scored = found.subModels[fold][best].transform(rows.filter(F.col("fold") == fold)).select(
            key, F.col("label").cast("int").alias("label"), "fold", vector_to_array("probability")[1].alias("score"))
        parts = scored if parts is None else parts.unionByName(scored)
    return PipelineModel([hashing, *found.bestModel.stages]), stage(parts)


def fit_calibration(scored: DataFrame) -> IsotonicRegressionModel:
    """The rising step function from scores to shares of label 1; equal rounded scores are added up first."""
    points = scored.groupBy(F.round(F.col("score") * STEPS).alias("_step")).agg(
        F.avg(F.col("label").cast("double")).alias("share"), F.count(F.lit(1)).cast("double").alias("weight"))
    return IsotonicRegression(featuresCol="at", labelCol="share", weightCol="weight", predictionCol="calibrated").fit(
        points.select((F.col("_step") / STEPS).alias("at"), "share", "weight"))


def calibrate(model: IsotonicRegressionModel, scored: DataFrame) -> DataFrame:
    """``scored`` with ``calibrated``, the probability that its score stands for."""
    return model.transform(scored.withColumn("at", F.round(F.col("score") * STEPS) / STEPS)).drop("at")


def calibrated_out_of_fold(scored: DataFrame, folds: int = FOLDS) -> DataFrame:
    """``scored(label, fold, score)`` with ``calibrated``; the calibration of a fold is fitted on the others."""
    parts = [
        calibrate(fit_calibration(scored.filter(F.col("fold") != k)), scored.filter(F.col("fold") == k)) for k in range(folds)]
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result


def calibration_report(calibrated: DataFrame) -> DataFrame:
    """For raw and calibrated scores: rows, expected calibration error over BINS bins of equal width, and the confusion counts at 0.5."""
    both = calibrated.select("label", F.explode(F.array(
        F.struct(F.lit("raw").alias("scores"), F.col("score").alias("p")),
        F.struct(F.lit("calibrated").alias("scores"), F.col("calibrated").alias("p")))).alias("s")).select("label", "s.*")
    flag, label = F.col("p") >= fv.SCORE_THRESHOLD, F.col("label") == 1
    bins = both.groupBy("scores", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.abs(F.sum("p") - F.sum("label")).alias("_off"),
        F.count_if(flag & label).alias("_tp"), F.count_if(flag & ~label).alias("_fp"),
        F.count_if(~flag & label).alias("_fn"), F.count_if(~flag & ~label).alias("_tn"))
    return bins.groupBy("scores").agg(
        F.sum("_n").alias("n"), (F.sum("_off") / F.sum("_n")).alias("calibration_error"),
        *[F.sum(f"_{c}").alias(c) for c in ("tp", "fp", "fn", "tn")])
