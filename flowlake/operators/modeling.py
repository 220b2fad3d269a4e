"""Tree classifiers on Spark ML: building, fitting, probabilities, importance, attribution."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassifier)
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlake.functions.scalars import finite, name, number
from flowlake.operators import scoring
from flowlake.operators.splits import SEED, row_hash
from flowlake.plans.bounded import localized

# Defaults of the two model families and the preset for foreign data sets.
BOOSTED = {"max_depth": 6, "n_estimators": 100, "learning_rate": 0.1}
FOREST = {"n_estimators": 200, "max_depth": 30}
HARDENED = {
    "max_depth": 4, "min_child_weight": 10, "reg_lambda": 2.0, "reg_alpha": 0.1,
    "subsample": 0.8, "colsample_bytree": 0.8, "learning_rate": 0.05, "n_estimators": 300,
}
#: Rows whose values replace others in the attribution, and rows of a drawn sample.
ATTRIBUTION_DONORS = SAMPLE_ROWS = 2000

#: Parameters without a counterpart here; they are recorded but have no effect.
WITHOUT_EFFECT = ("reg_alpha", "reg_lambda")

FEATURES, LABEL, WEIGHT, PROBABILITIES = "features", "label_index", "weight", "probabilities_array"


def _spark_params(params: Mapping[str, float], forest: bool) -> dict:
    rounds = "numTrees" if forest else "maxIter"
    to = {"max_depth": "maxDepth", "n_estimators": rounds, "learning_rate": "stepSize",
          "subsample": "subsamplingRate", "min_child_weight": "minInstancesPerNode",
          "gamma": "minInfoGain"}
    out = {to[k]: v for k, v in params.items() if k in to and not (forest and k == "learning_rate")}
    if "colsample_bytree" in params:
        share = float(params["colsample_bytree"])
        out["featureSubsetStrategy"] = "all" if share >= 1 else str(share)
    unknown = set(params) - set(to) - {"colsample_bytree", *WITHOUT_EFFECT}
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return out


def build_model(kind: str, n_classes: int, params: Mapping[str, float] | None = None,
                weighted: bool = True, parallelism: int = 4) -> Estimator:
    """``boosted`` trees (one booster per class beyond two classes) or a random ``forest``."""
    common = {"featuresCol": FEATURES, "labelCol": LABEL, "seed": SEED}
    if weighted:
        common["weightCol"] = WEIGHT
    if kind == "forest":
        return RandomForestClassifier(
            **common, **_spark_params({**FOREST, **(params or {})}, True))
    if kind != "boosted":
        raise ValueError(f"unknown model kind {kind!r}")
    booster = GBTClassifier(**common, **_spark_params({**BOOSTED, **(params or {})}, False))
    if n_classes <= 2:
        return booster
    return OneVsRest(classifier=booster, featuresCol=FEATURES, labelCol=LABEL,
                     weightCol=WEIGHT if weighted else None, parallelism=parallelism)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the feature vector; null, unreadable and non-finite values enter it as 0."""
    text = {c for c, kind in df.dtypes if kind == "string"}
    values = [finite(number(name(c)) if c in text else name(c)) for c in features]
    return df.withColumn(FEATURES, array_to_vector(F.array(*values)))


def encode_labels(train: DataFrame, label: str):
    """Sorted distinct training labels to 0..k-1; rows with other labels are left out."""
    return StringIndexer(inputCol=label, outputCol=LABEL, stringOrderType="alphabetAsc",
                         handleInvalid="skip").fit(train)


def with_probabilities(model: Model, assembled: DataFrame) -> DataFrame:
    """``assembled`` plus ``prediction_index`` and the array of probabilities, which add up to 1."""
    if isinstance(model, OneVsRestModel):
        return _one_versus_rest(model, assembled)
    out = model.transform(assembled)
    return (out.withColumn(PROBABILITIES, vector_to_array("probability"))
            .withColumnRenamed("prediction", "prediction_index")
            .drop("rawPrediction", "probability"))


def _one_versus_rest(model: OneVsRestModel, assembled: DataFrame) -> DataFrame:
    """The largest raw output wins, and the members' probabilities are divided by their sum.

    The members add plain columns, so that all of it is generated code: arrays that grow by a member each and
    lambdas that compute the sum again for every class take most of the time of a large table.
    """
    out, classes = assembled, range(len(model.models))
    for i, member in enumerate(model.models):
        out = member.copy({member.rawPredictionCol: f"_vector{i}", member.probabilityCol: "",
                           member.predictionCol: ""}).transform(out)
    out = out.withColumns({f"_raw{i}": F.get(vector_to_array(f"_vector{i}"), F.lit(1)) for i in classes})
    out = out.withColumns({f"_each{i}": 1.0 / (1.0 + F.exp(-2.0 * F.col(f"_raw{i}"))) for i in classes})
    out = out.withColumn("_total", sum((F.col(f"_each{i}") for i in classes), F.lit(0.0)))
    raw = F.array(*[F.col(f"_raw{i}") for i in classes])
    return out.select(*[name(c) for c in assembled.columns],
                      (F.array_position(raw, F.array_max(raw)) - 1).cast("double").alias("prediction_index"),
                      F.array(*[F.col(f"_each{i}") / F.col("_total") for i in classes]).alias(PROBABILITIES))


@dataclass
class Classifier:
    """A fitted model with the names of its features and classes."""

    model: Model
    features: list[str]
    labels: list[str]

    def score(self, df: DataFrame, digits: int | None = None) -> DataFrame:
        """Input columns plus prediction, confidence and the probability map."""
        scored = with_probabilities(self.model, assemble(self.aligned(df), self.features))
        return scoring.prediction_columns(
            scored, PROBABILITIES, self.labels, "prediction_index", digits).drop(FEATURES)

    def aligned(self, df: DataFrame) -> DataFrame:
        scoring.align_features(df, self.features)
        return df

    def save(self, path: str) -> None:
        PipelineModel([self.model]).write().overwrite().save(f"{path}/model")
        spark = SparkSession.getActiveSession()
        (spark.createDataFrame([(self.features, self.labels)],
                               "features array<string>, labels array<string>")
         .coalesce(1).write.mode("overwrite").json(f"{path}/names"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> Classifier:
        names = (spark.read.schema("features array<string>, labels array<string>")
                 .json(f"{path}/names").first())
        return Classifier(PipelineModel.load(f"{path}/model").stages[0],
                          list(names["features"]), list(names["labels"]))


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, kind: str = "boosted",
                   params: Mapping[str, float] | None = None, weighted: bool = True) -> Classifier:
    """Fit on rows that carry ``weight`` where ``weighted``; classes come from these rows."""
    indexer = encode_labels(train, label)
    columns = [FEATURES, LABEL] + ([WEIGHT] if weighted else [])
    # Boosting passes over these rows once per tree level and class.
    rows = (indexer.transform(assemble(train, features)).select(*columns)
            .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        # A copy is without the training summary, which for a forest of two classes holds the session:
        # in a session that has observed rows it cannot be sent to tasks.
        model = build_model(kind, len(indexer.labels), params, weighted).fit(rows).copy()
    finally:
        rows.unpersist()
    return Classifier(model, list(features), list(indexer.labels))


def evaluate_rows(clf: Classifier, test: DataFrame, label: str) -> DataFrame:
    """``(y, yhat, probabilities_array)`` for the test rows of known classes.

    The classes are the model's own, so the list is short and travels in the expression.
    """
    known = test.where(name(label).isin(clf.labels))
    scored = with_probabilities(clf.model, assemble(clf.aligned(known), clf.features))
    return scored.select(name(label).alias("y"),
                         scoring.decode_class(F.col("prediction_index"), clf.labels).alias("yhat"),
                         PROBABILITIES)


def unseen_labels(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Test classes that training lacks, with their row counts."""
    seen = localized(train.select(name(label)).distinct())
    return (test.groupBy(name(label)).agg(F.count("*").alias("n"))
            .join(seen, [label], "left_anti"))


def feature_importance(clf: Classifier) -> DataFrame:
    """``(feature, importance)``, largest first; boosters of one class each are averaged."""
    members = clf.model.models if isinstance(clf.model, OneVsRestModel) else [clf.model]
    vectors = [m.featureImportances.toArray() for m in members]
    mean = sum(vectors) / len(vectors)
    spark = SparkSession.getActiveSession()
    return (spark.createDataFrame([(f, float(v)) for f, v in zip(clf.features, mean)],
                                  "feature string, importance double")
            .orderBy(F.desc("importance"), "feature"))


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """``n`` rows by smallest seeded hash of their key: the same rows in every run."""
    return df.withColumn("_h", row_hash(key, seed)).orderBy("_h", *key).limit(n).drop("_h")


def attribution(clf: Classifier, df: DataFrame, key: Sequence[str], n: int = ATTRIBUTION_DONORS,
                seed: int = SEED) -> DataFrame:
    """``(feature, class, effect)``: mean absolute change of a class probability when the
    feature takes the value of another row.

    The mean is over all rows; the other row is one of at most ``n`` drawn donors.
    """
    rows = assemble(clf.aligned(df), clf.features).select(*[name(k) for k in key], FEATURES)
    given = localized(sample_rows(rows, n, key, seed).select(
        *[name(k) for k in key], vector_to_array(FEATURES).alias("donor")))
    base = with_probabilities(clf.model, rows)
    base = base.select(*[name(k) for k in key], vector_to_array(FEATURES).alias("x"),
                       F.col(PROBABILITIES).alias("p0"))
    donors = given.select(F.row_number().over(_by_key(key)).alias("slot"), "donor")
    size = max(1, given.count())
    k = len(clf.features)
    variants = (base.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
                .withColumn("slot", (F.pmod(F.xxhash64(F.lit(seed + 1), "j", *[name(c) for c in key]),
                                            F.lit(size)) + 1).cast("int"))
                .join(donors, "slot"))
    changed = variants.withColumn(FEATURES, array_to_vector(F.array(*[
        F.when(F.col("j") == i, F.get("donor", F.lit(i))).otherwise(F.get("x", F.lit(i))) for i in range(k)])))
    moved = with_probabilities(clf.model, changed)
    # One sum for each class, so that a variant stays one row.
    effect = [F.avg(F.abs(F.get("p0", F.lit(c)) - F.get(PROBABILITIES, F.lit(c)))) for c in range(len(clf.labels))]
    out = moved.groupBy("j").agg(F.array(*effect).alias("effects")).select("j", F.posexplode("effects").alias("c", "effect"))
    return out.select(scoring.decode_class(F.col("j"), clf.features).alias("feature"),
                      scoring.decode_class(F.col("c"), clf.labels).alias("class"), "effect")


def _by_key(key: Sequence[str]):
    # There are at most ATTRIBUTION_DONORS donors, so one task may number them.
    return Window.orderBy(*key)


def parameters_json(params: Mapping[str, object]) -> dict[str, str]:
    return {k: json.dumps(v, default=str) for k, v in params.items()}
