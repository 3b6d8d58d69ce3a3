"""Classifiers over the matrix: boosted trees, a forest, and a rule model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funcrisk import constants as C
from funcrisk.operators.matrix import align_features, drop_label_columns
from funcrisk.operators.scoring import boost_and_flag, rule_score

KINDS = ("boosted", "forest", "rule")
NOT_FEATURES = {*C.KEY, "label", "split", "weight"}
FACTS = "kind string, features array<string>, means map<string, double>"


@dataclass(frozen=True)
class Model:
    """kind, the feature order it expects, a fitted MLlib model or the rule table, and a rule model's feature means."""

    kind: str
    features: list[str]
    fitted: object
    means: dict[str, float | None] | None = None


def feature_columns(matrix: DataFrame) -> list[str]:
    return [c for c in drop_label_columns(matrix).columns if c not in NOT_FEATURES]


def class_weights(labels: DataFrame, fn_cost: float = 5.0, scale_pos: float | None = None) -> DataFrame:
    """labels with weight: negatives 1; positives (negatives / positives, or scale_pos) times fn_cost."""
    counts = labels.agg(
        F.count_if(F.col("label") == 1).cast("double").alias("pos"),
        F.count_if(F.col("label") == 0).cast("double").alias("neg"),
    )
    if scale_pos is not None:
        scale = F.lit(float(scale_pos))
    else:
        balance = F.when(F.col("pos") > 0, F.col("neg") / F.nullif(F.col("pos"), F.lit(0.0))).otherwise(F.lit(1.0))
        labels = labels.withColumn("_scale", counts.select(balance).scalar())
        scale = F.col("_scale")
    weighted = labels.withColumn("weight", F.when(F.col("label") == 1, scale * fn_cost).otherwise(F.lit(1.0)))
    return weighted.drop("_scale")


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def _numbers(matrix: DataFrame, features: Sequence[str], extra: Sequence[str]) -> DataFrame:
    return matrix.select(*extra, *[F.col(f"`{c}`").cast("double").alias(c) for c in features])


def fit_gbt(train: DataFrame, params: dict | None = None, features: Sequence[str] | None = None) -> Model:
    """Boosted trees on train(label, weight, features...)."""
    features = list(features or feature_columns(train))
    settings = {"maxIter": 50, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8,
                "featureSubsetStrategy": "0.8", "minInstancesPerNode": 1, "seed": 42} | (params or {})
    trees = GBTClassifier(labelCol="label", weightCol="weight", featuresCol="features", **settings)
    rows = _numbers(train, features, ["label", "weight"])
    return Model("boosted", features, Pipeline(stages=[_assembler(features), trees]).fit(rows))


def fit_forest(train: DataFrame, params: dict | None = None, features: Sequence[str] | None = None) -> Model:
    """Random forest on train(label, features...), unweighted."""
    features = list(features or feature_columns(train))
    settings = {"numTrees": 100, "maxDepth": 6, "seed": 42} | (params or {})
    trees = RandomForestClassifier(labelCol="label", featuresCol="features", **settings)
    rows = _numbers(train, features, ["label"])
    return Model("forest", features, Pipeline(stages=[_assembler(features), trees]).fit(rows))


def feature_moments(train: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Per feature: position, feature, correlation with the label, middle of the two classes' means, mean, mean_label.

    Rows become (position, value) pairs that are summed up before they shuffle, so that the plan is the same for ten
    features and for thousands. Null values are left out; a constant feature has no correlation.
    """
    features = list(features or feature_columns(train))
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in features]).cast("array<double>")
    pairs = train.select(F.col("label").cast("double").alias("y"), F.posexplode(values).alias("position", "x"))
    classes = [F.avg(F.when(F.col("y") == k, F.col("x"))) for k in (1, 0)]
    return pairs.groupBy("position").agg(
        F.abs(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))).alias("correlation"),
        ((classes[0] + classes[1]) / 2).alias("middle"), F.avg("x").alias("mean"), F.avg("y").alias("mean_label"),
    ).withColumn("feature", F.element_at(F.lit(features).cast("array<string>"), F.col("position") + 1))


def _ranked(moments: DataFrame) -> DataFrame:
    # One row per feature.
    best = Window.orderBy(F.col("correlation").desc_nulls_last(), "position")
    rank = F.row_number().over(best)
    return moments.withColumn("rank", rank).withColumn("threshold", F.when(F.col("rank") <= 5, F.col("middle")))


def rule_table(train: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """The ten features that go with the label most: rank, feature, correlation, threshold, mean.

    threshold is the middle between the two classes' means for the top five and null below. mean_label is the same on
    every row.
    """
    top = _ranked(feature_moments(train, features)).filter(F.col("rank") <= 10)
    return top.select("rank", "feature", "correlation", "threshold", "mean", "mean_label")


def fit_rule_model(train: DataFrame, features: Sequence[str] | None = None) -> Model:
    """The ten best features with thresholds, and the means of all."""
    features = list(features or feature_columns(train))
    # One row per feature.
    rows = [r.asDict() for r in _ranked(feature_moments(train, features)).drop("position", "middle").orderBy("rank").collect()]
    return Model("rule", features, rows[:10], {r["feature"]: r["mean"] for r in rows})


def predict_rule_model(matrix: DataFrame, model: Model) -> DataFrame:
    """The matrix with score: 0.2 for each of the five features above its threshold, through a sigmoid.

    Without thresholds, 0.2 times the sum of the five features.
    """
    top = [r for r in model.fitted if r["rank"] <= 5]
    limits = [r for r in top if r["threshold"] is not None]
    total = F.lit(0.0)
    for r in limits or top:
        if r["feature"] in matrix.columns:
            value = F.col(f"`{r['feature']}`").cast("double")
            total = total + (F.when(value > r["threshold"], 0.2).otherwise(0.0) if limits else value * 0.2)
    return matrix.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-total)))


def score_matrix(matrix: DataFrame, model: Model | None = None, constant: str = "raw") -> DataFrame:
    """(firmware_id, func_id, score) by the model given, or by the rule score."""
    rows = drop_label_columns(matrix)
    if model is None:
        # Only what the rule score reads, so that no other feature is worked out.
        used = [c for c in C.RULE_WEIGHTS if c in rows.columns]
        return rule_score(rows.select(*C.KEY, *used), constant).select(*C.KEY, "score")
    rows = align_features(rows, model.features)
    if model.kind == "rule":
        return predict_rule_model(rows, model).select(*C.KEY, "score")
    scored = model.fitted.transform(_numbers(rows, model.features, C.KEY))
    return scored.select(*C.KEY, vector_to_array("probability")[1].alias("score"))


def predict(
    matrix: DataFrame, labels: DataFrame | None = None, model: Model | None = None,
    threshold: float = 0.7, boost: float = 0.3, constant: str = "raw",
) -> DataFrame:
    """Predictions: (firmware_id, func_id, score, cwe, is_vulnerable)."""
    return boost_and_flag(score_matrix(matrix, model, constant), labels, threshold, boost)


def accuracy_metrics(scored: DataFrame) -> DataFrame:
    """(split, accuracy, samples) from (split, score, label), at a cut of 0.5."""
    right = (F.col("score") > 0.5) == (F.col("label") == 1)
    return scored.groupBy("split").agg(
        F.avg(right.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("samples")
    )


def fit(train: DataFrame, kind: str = "boosted", params: dict | None = None, fn_cost: float = 5.0,
        scale_pos: float | None = None) -> Model:
    """A model of the kind asked for from train(label, features...)."""
    features = feature_columns(train)
    if kind == "boosted":
        return fit_gbt(class_weights(train, fn_cost, scale_pos), params, features)
    if kind == "forest":
        return fit_forest(train, params, features)
    if kind == "rule":
        return fit_rule_model(train, features)
    raise ValueError(f"unknown model kind {kind!r}")


def save_model(spark: SparkSession, model: Model, folder: str) -> None:
    """The model's kind, features and their means as one JSON row, beside the fitted part."""
    facts = spark.createDataFrame([(model.kind, model.features, model.means)], FACTS)
    facts.coalesce(1).write.mode("overwrite").json(f"{folder}/facts")
    if model.kind == "rule":
        schema = "rank int, feature string, correlation double, threshold double, mean double, mean_label double"
        rows = [tuple(r[c.split()[0]] for c in schema.split(", ")) for r in model.fitted]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/rules")
    else:
        model.fitted.write().overwrite().save(f"{folder}/fitted")


def load_model(spark: SparkSession, folder: str) -> Model:
    facts = spark.read.schema(FACTS).json(f"{folder}/facts").first()
    if facts["kind"] == "rule":
        rules = spark.read.parquet(f"{folder}/rules").orderBy("rank").collect()
        means = facts["means"]
        return Model("rule", list(facts["features"]), [r.asDict() for r in rules], None if means is None else {c: means.get(c) for c in facts["features"]})
    return Model(facts["kind"], list(facts["features"]), PipelineModel.load(f"{folder}/fitted"))
