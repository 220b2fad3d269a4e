"""Classification metrics from one count per (true, predicted) pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.scalars import name, ratio
from flowlake.plans.bounded import localized
from flowlake.plans.ordered import running_before
from flowlake.session import cut_lineage

def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, weight)`` with balanced weight ``rows / (classes * n)``."""
    counts = df.groupBy(name(label)).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row per class
    return counts.select(name(label), "n", (
        F.sum("n").over(every).cast("double") / (F.count("*").over(every) * F.col("n")))
        .alias("weight"))


def confusion(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """``(y, yhat, n)`` for the pairs that occur; every metric below derives from it."""
    return df.groupBy(name(y).alias("y"), name(yhat).alias("yhat")).agg(F.count("*").alias("n"))


def confusion_matrix(cm: DataFrame) -> DataFrame:
    """Square matrix: a row per label, a column ``pred_<label>`` per label of either side."""
    labels = [r[0] for r in cm.select(F.col("y")).union(cm.select(F.col("yhat"))).distinct()
              .orderBy("y").collect()]
    all_labels = cm.sparkSession.createDataFrame([(v,) for v in labels], cm.select("y").schema)
    wide = cm.groupBy("y").agg(*[
        F.sum(F.when(F.col("yhat") == v, F.col("n")).otherwise(0)).alias(f"pred_{v}") for v in labels])
    return all_labels.join(wide, "y", "left").na.fill(0)


def _by_label(cm: DataFrame) -> DataFrame:
    """True positives, support and predictions per label of either side."""
    hit = F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)
    true = cm.select(F.col("y").alias("label"), hit.alias("tp"), F.col("n").alias("support"),
                     F.lit(0).cast("long").alias("predicted"))
    pred = cm.select(F.col("yhat").alias("label"), F.lit(0).cast("long").alias("tp"),
                     F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"))
    s = true.unionByName(pred).groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"))
    return s.select(
        "label", ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support", "tp")


def per_class_metrics(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of the labels that truly occur; 0/0 is 0."""
    return _by_label(cm).where("support > 0").drop("tp")


def summary_metrics(cm: DataFrame) -> DataFrame:
    """Accuracy, and macro (over the labels of either side) and weighted averages, in one row."""
    weighted = [ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"{m}_weighted")
                for m in ("precision", "recall", "f1")]
    macro = [F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")]
    return _by_label(cm).agg(ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
                             *weighted, *macro, F.sum("support").alias("n"))


def classification_report(cm: DataFrame) -> DataFrame:
    """Per-class rows, then accuracy and the averages over the labels that truly occur."""
    shown = _by_label(cm).where("support > 0")
    cols = ("precision", "recall", "f1")
    macro = shown.agg(*[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support"))
    weight = shown.agg(*[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
                         for c in cols], F.sum("support").alias("support"))
    micro = shown.agg(*[ratio(F.sum("tp"), F.sum("support")).alias(c) for c in cols],
                      F.sum("support").alias("support"))
    out = shown.select(F.col("label").cast("string"), *cols, "support")
    for label, part in (("accuracy", micro), ("macro avg", macro), ("weighted avg", weight)):
        out = out.unionByName(part.withColumn("label", F.lit(label)))
    return out


def roc_auc_ovr(df: DataFrame, y: str, scores: dict[str, Column]) -> DataFrame:
    """One-versus-rest AUC of each class that truly occurs: ``(label, n_pos, n_neg, auc)``.

    ``scores`` maps each class to its score column.  Equal scores are summed before anything
    is ordered, so a score shared by most rows is one row here.  The distinct scores are cut
    into ranges by Spark's range partitioning, which follows their distribution; the ranges
    are stored, so that the totals and the ranks see the same ones.
    """
    entries = F.array(*[F.struct(F.lit(k).alias("label"), c.cast("double").alias("score"))
                        for k, c in scores.items()])
    long = (df.select(name(y).alias("_y"), F.explode(entries).alias("e"))
            .select("_y", "e.label", "e.score"))
    hist = long.groupBy("label", "score").agg(
        F.count_if(F.col("_y") == F.col("label")).alias("pos"),
        F.count_if(F.col("_y") != F.col("label")).alias("neg"))
    ranges = cut_lineage(hist.repartitionByRange("label", "score")
                         .withColumn("range", F.spark_partition_id()))
    ranked = running_before(ranges, ["label"], F.col("range"), ["score"], ["neg"])
    area = F.sum(F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / 2.0))
    total = ranked.groupBy("label").agg(
        area.alias("_area"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return total.where("n_pos > 0").select(
        "label", "n_pos", "n_neg",
        F.try_divide(F.col("_area"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"))


def roc_auc_macro(per_class: DataFrame) -> DataFrame:
    return per_class.agg(F.avg("auc").alias("roc_auc_macro"))


def fold_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """Mean and twice the population deviation of fold scores."""
    return scores.agg(F.count("*").alias("folds"), F.avg(score).alias("mean"),
                      (2 * F.stddev_pop(score)).alias("spread"))


def fold_f1(df: DataFrame, fold: str, y: str, yhat: str) -> DataFrame:
    """Macro F1 of each fold, all folds in one aggregate over (fold, true, predicted)."""
    cm = df.groupBy(fold, name(y).alias("y"), name(yhat).alias("yhat")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)
    both = (cm.select(fold, F.col("y").alias("label"), hit.alias("tp"), F.col("n").alias("size"))
            .unionByName(cm.select(fold, F.col("yhat").alias("label"),
                                   F.lit(0).cast("long").alias("tp"), F.col("n").alias("size"))))
    return (both.groupBy(fold, "label").agg(ratio(2 * F.sum("tp"), F.sum("size")).alias("f1"))
            .groupBy(fold).agg(F.avg("f1").alias("score")))


def labels_of(df: DataFrame, label: str) -> Sequence[str]:
    """Sorted distinct classes (a short list by nature)."""
    return [r[0] for r in df.select(name(label)).distinct().orderBy(name(label)).collect()]


def attach_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Rows with the balanced weight of their class."""
    weights = localized(class_weights(df, label).select(name(label), F.col("weight").alias(out)))
    return df.join(weights, [label]).select(*[name(c) for c in df.columns], out)
