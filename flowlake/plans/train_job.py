"""The whole training run, the comparison reports built from it, and batch scoring."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake import schema as S
from flowlake.functions.scalars import name, safe_label
from flowlake.operators import metrics as M
from flowlake.operators import modeling as MD
from flowlake.operators import scoring, splits, tuning
from flowlake.operators.clean import feature_columns, validate_labelled
from flowlake.operators.selection import FeatureSelector, FeatureSelectorModel
from flowlake.sources import sinks

log = logging.getLogger(__name__)


@dataclass
class TrainConfig:
    kind: str = "boosted"
    strategy: str = "file_holdout"
    tune: str | None = None
    draws: int | None = None
    corr_threshold: float = 0.95
    drop_port: bool = False
    drop_env: bool = False
    hardened: bool = False
    class_weights: bool = True
    params: Mapping[str, float] = field(default_factory=dict)
    cv: bool = True
    folds: int = 5
    label: str | None = None
    key: Sequence[str] = ("Source_File", S.ROW_ORD)
    seed: int = splits.SEED


@dataclass
class TrainResult:
    classifier: MD.Classifier
    selector: FeatureSelectorModel
    metrics: dict
    per_class: dict[str, dict]
    cv_scores: list[tuple[int, float]]
    params: dict
    n_train: int
    n_test: int


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent content hash: row count and sum of 64-bit row hashes, in one pass."""
    cols = [name(c) for c in sorted(df.columns)]
    return df.agg(F.count("*").alias("n_rows"),
                  F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("hash_sum")).select(
        "n_rows", F.substring(F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"),
                                                 F.col("hash_sum").cast("string")), 256), 1, 16)
        .alias("fingerprint"))


def _candidates(cfg: TrainConfig) -> list[dict]:
    if cfg.tune == "listed":
        return tuning.draws(tuning.LISTED_SPACE, cfg.draws or tuning.LISTED_DRAWS, cfg.seed)
    return tuning.draws(tuning.RANGED_SPACE, cfg.draws or tuning.RANGED_DRAWS, cfg.seed)


def _check(cfg: TrainConfig) -> None:
    if cfg.tune not in (None, "listed", "ranged"):
        raise ValueError(f"unknown search {cfg.tune!r}")
    if cfg.tune and (cfg.kind != "boosted" or cfg.hardened):
        raise ValueError("a search covers plain boosted trees only")
    if cfg.hardened and cfg.kind != "boosted":
        raise ValueError("the hardened preset is one of boosted trees")


def with_folds(train: DataFrame, cfg: TrainConfig, label: str) -> DataFrame:
    """Group folds where files are known, else stratified ones."""
    if "Source_File" in train.columns:
        return splits.group_folds(train, "Source_File", cfg.folds)
    return splits.stratified_folds(train, label, cfg.key, cfg.folds, cfg.seed)


def train_model(df: DataFrame, cfg: TrainConfig) -> TrainResult:
    """Split, select on the training side, weigh, tune or fit, cross-validate, evaluate."""
    _check(cfg)
    label = cfg.label or ("Attack Type" if "Attack Type" in df.columns else "Label")
    validate_labelled(df, label, [c for c in feature_columns(df) if c != label])
    tagged = splits.assign_split(df, cfg.strategy, label, cfg.key, cfg.seed)
    train = tagged.where("split = 'train'").drop("split")
    test = tagged.where("split = 'test'").drop("split")
    meta = {*S.METADATA, label}
    selector = FeatureSelector(corrThreshold=cfg.corr_threshold, dropPort=cfg.drop_port,
                               dropEnv=cfg.drop_env).fit(
        train.select(*[name(c) for c in feature_columns(train) if c not in meta]))
    features = selector.features
    keep = [c for c in train.columns if c in features or c in meta or c in cfg.key]
    train, test = train.select(*map(name, keep)), test.select(*map(name, keep))
    if cfg.class_weights:
        train = M.attach_weights(train, label, MD.WEIGHT)
    train = with_folds(train, cfg, label)
    # Each fit stores the vectors it passes over; the rows they come from are worth storing for several fits only.
    again = cfg.cv or cfg.tune
    if again:
        train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        params = dict(cfg.params)
        if cfg.tune:
            rows, fold = train, "fold"
            if cfg.tune == "listed":
                rows = splits.stratified_folds(train.drop("fold"), label, cfg.key, 5, cfg.seed)
            weighted = cfg.class_weights and cfg.tune == "ranged"
            params = tuning.search(rows, features, label, _candidates(cfg), fold, weighted)[0][0]
        elif cfg.hardened:
            params = {**MD.HARDENED, **params}
        clf = MD.fit_classifier(train, features, label, cfg.kind, params, cfg.class_weights)
        cv = (tuning.cross_validate(train, features, label, "fold", cfg.kind, params,
                                    cfg.class_weights) if cfg.cv else [])
        n_train = train.count()
    finally:
        if again:
            train.unpersist()
    rows = MD.evaluate_rows(clf, test, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cm = M.confusion(rows, "y", "yhat")
        summary = M.summary_metrics(cm).first().asDict()
        per_class = {r["label"]: r.asDict() for r in M.per_class_metrics(cm).collect()}
        scores = {v: F.col(MD.PROBABILITIES)[i] for i, v in enumerate(clf.labels)}
        present = sorted(per_class)
        if len(present) >= 2:
            auc = M.roc_auc_ovr(rows, "y", scores)
            if len(clf.labels) == 2:
                auc = auc.where(F.col("label") == clf.labels[1])
            summary["roc_auc_macro"] = M.roc_auc_macro(auc).first()[0]
    finally:
        rows.unpersist()
    n_test = summary.pop("n") or 0
    return TrainResult(clf, selector, summary, per_class, cv, params, n_train, n_test)


def experiment_record(spark: SparkSession, df: DataFrame, cfg: TrainConfig, out: TrainResult,
                      dataset_path: str = "") -> DataFrame:
    """One nested row that describes a run."""
    cv = [s for _, s in out.cv_scores]
    shown = {**(MD.BOOSTED if cfg.kind == "boosted" else MD.FOREST), **out.params}
    chosen = out.selector.summary(spark)
    layout = T.StructType.fromDDL(
        "timestamp string, model_type string, params map<string,string>, split_strategy string, "
        "tune_method string, n_train long, n_test long, classes array<string>, "
        "metrics map<string,double>, "
        "per_class map<string,struct<precision:double,recall:double,f1:double,support:bigint>>, "
        "cv_f1_macro double, dataset_path string, dataset_hash string, class_weights boolean, "
        "drop_port boolean, drop_env_features boolean, hardened_hp boolean"
    ).add("feature_selection", chosen.schema)
    return spark.createDataFrame(
        [(datetime.now(timezone.utc).isoformat(), cfg.kind, MD.parameters_json(shown),
          cfg.strategy, cfg.tune, out.n_train, out.n_test, out.classifier.labels,
          {k: float(v) for k, v in out.metrics.items() if v is not None},
          {k: (v["precision"], v["recall"], v["f1"], v["support"]) for k, v in out.per_class.items()},
          sum(cv) / len(cv) if cv else None, dataset_path, fingerprint(df).first()["fingerprint"],
          cfg.class_weights, cfg.drop_port, cfg.drop_env, cfg.hardened, chosen.first())], layout)


def run(spark: SparkSession, df: DataFrame, cfg: TrainConfig, folder: str,
        dataset_path: str = "") -> TrainResult:
    """Train, then store model, selector, importance table and experiment record."""
    out = train_model(df, cfg)
    out.classifier.save(f"{folder}/classifier")
    out.selector.write().overwrite().save(f"{folder}/selector")
    MD.feature_importance(out.classifier).coalesce(1).write.mode("overwrite").csv(
        f"{folder}/feature_importance", header=True)
    sinks.append_record(experiment_record(spark, df, cfg, out, dataset_path),
                        f"{folder}/experiments")
    return out


def compare(df: DataFrame, runs: Iterable[tuple[str, TrainConfig]]) -> DataFrame:
    """Headline metrics of several runs, one row each."""
    rows = []
    for title, cfg in runs:
        out = train_model(df, cfg)
        rows.append((title, cfg.strategy, out.n_train, out.n_test, len(out.classifier.features),
                     float(out.metrics["accuracy"]), float(out.metrics["f1_macro"]),
                     float(out.metrics["f1_weighted"])))
    return df.sparkSession.createDataFrame(
        rows, "run string, strategy string, n_train long, n_test long, n_features int, "
              "accuracy double, f1_macro double, f1_weighted double")


def generalisation(df: DataFrame, cfg: TrainConfig, strategies: Sequence[str]) -> DataFrame:
    """Macro F1 per split strategy and its distance from the first one."""
    out = compare(df, [(s, replace(cfg, strategy=s)) for s in strategies])
    first = out.where(F.col("run") == strategies[0]).first()["f1_macro"]
    return out.withColumn("gap", F.lit(first) - F.col("f1_macro"))


def ablation(df: DataFrame, cfg: TrainConfig) -> DataFrame:
    """With and without the port, without environment features, with the hardened preset."""
    return compare(df, [("full", cfg), ("without port", replace(cfg, drop_port=True)),
                        ("without environment", replace(cfg, drop_env=True)),
                        ("hardened", replace(cfg, drop_env=True, hardened=True))])


def score_table(clf: MD.Classifier, df: DataFrame) -> DataFrame:
    """The input's own columns plus ``Prediction`` and ``Probability_<class>``."""
    tidy = df.toDF(*[c.strip() for c in df.columns])
    scored = clf.score(tidy)
    wide = scoring.probability_columns(scored, MD.PROBABILITIES, clf.labels)
    out = [F.col("prediction").alias("Prediction")]
    out += [F.col(f"`Probability_{safe_label(v)}`") for v in clf.labels]
    return wide.select(*[name(c.strip()).alias(c) for c in df.columns], *out)
