"""Training, tuning, scoring and the reports on top of them.

The parameters are small so that a run takes seconds; the rows are always whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake import schema as S
from flowlake.operators import metrics as M
from flowlake.operators import modeling as MD
from flowlake.operators import splits, tuning
from flowlake.plans import train_job as J
from flowlake.queries.bindings import LINEITEM_SQL, lineitem, table
from flowlake.session import new_folder

SMALL = {"max_depth": 3, "n_estimators": 3, "learning_rate": 0.3}
SMALL_FOREST = {"max_depth": 5, "n_estimators": 10}


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as flows of three classes that price, quantity and discount explain."""
    li = lineitem(spark, d)
    group = (F.when(F.col("l_extendedprice") > 60000, "DoS")
             .when((F.col("l_quantity") < 12) & (F.col("l_discount") > 0.03), "Bot")
             .otherwise("Normal Traffic"))
    return li.select(
        (F.col("l_suppkey") % 1024).alias("Destination Port"),
        F.col("l_quantity").alias("Fwd IAT Mean"), F.col("l_extendedprice").alias("Flow Bytes/s"),
        F.col("l_discount").alias("Flow IAT Std"), F.col("l_tax").alias("Idle Std"),
        (F.col("l_linenumber") * 20).cast("long").alias("Fwd Header Length"),
        (F.col("l_quantity") * 3 + 1).alias("Fwd IAT Max"), F.lit(1.0).alias("Bwd Avg Bulk Rate"),
        group.alias("Attack Type"), "Source_File", "Dataset", S.ROW_ORD)


def _train_config(**more) -> J.TrainConfig:
    return J.TrainConfig(**{"params": SMALL, "cv": False, **more})


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Embeddings as 64 feature columns with their class."""
    names = [f"e{i}" for i in range(64)]
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("Label"),
        *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)])
    return rows, names


def _forest(spark: SparkSession, d: str):
    rows, names = vectors(spark, d)
    tagged = M.attach_weights(splits.split_random(rows, "Label", ["vec_id"]), "Label", MD.WEIGHT)
    train = tagged.where("split = 'train'")
    return MD.fit_classifier(train, names, "Label", "forest", SMALL_FOREST), tagged


def train_forest(spark: SparkSession, d: str) -> DataFrame:
    clf, tagged = _forest(spark, d)
    rows = MD.evaluate_rows(clf, tagged.where("split = 'test'"), "Label")
    return M.per_class_metrics(M.confusion(rows, "y", "yhat"))


def train_boosted(spark: SparkSession, d: str) -> DataFrame:
    df = labelled(spark, d)
    cfg = _train_config()
    return J.experiment_record(spark, df, cfg, J.train_model(df, cfg))


def _boosted(spark: SparkSession, d: str) -> tuple[MD.Classifier, DataFrame]:
    rows = M.attach_weights(labelled(spark, d), "Attack Type", MD.WEIGHT)
    names = ["Destination Port", "Fwd IAT Mean", "Flow Bytes/s", "Flow IAT Std"]
    return MD.fit_classifier(rows, names, "Attack Type", "boosted", SMALL), rows


def train_binary(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).withColumn(
        "Label", F.when(F.col("Attack Type") == "Normal Traffic", "BENIGN").otherwise("ATTACK"))
    names = ["Fwd IAT Mean", "Flow Bytes/s", "Flow IAT Std"]
    clf = MD.fit_classifier(rows, names, "Label", "boosted", SMALL, weighted=False)
    return M.per_class_metrics(M.confusion(MD.evaluate_rows(clf, rows, "Label"), "y", "yhat"))


def cv_scores(spark: SparkSession, d: str) -> DataFrame:
    rows, names = vectors(spark, d)
    folded = splits.stratified_folds(rows, "Label", ["vec_id"], 3)
    scores = tuning.cross_validate(folded, names, "Label", "fold", "forest", SMALL_FOREST, False)
    return tuning.fold_frame(spark, scores)


SEARCH_DRAWS, SEARCH_BUDGET = 4, 4


def search(spark: SparkSession, d: str) -> DataFrame:
    """Successive halving over drawn candidates: one round of boosting, then two, then ``SEARCH_BUDGET``."""
    rows = splits.group_folds(labelled(spark, d), k=2)
    found = tuning.halving(rows, ["Fwd IAT Mean", "Flow Bytes/s", "Flow IAT Std"], "Attack Type",
                           tuning.draws(tuning.RANGED_SPACE, SEARCH_DRAWS), first=1, budget=SEARCH_BUDGET)
    return spark.createDataFrame([(i, {k: float(v) for k, v in p.items()}, n, s) for i, (p, n, s) in enumerate(found)],
                                 "place int, params map<string,double>, rounds int, f1_macro double")


def importance(spark: SparkSession, d: str) -> DataFrame:
    clf, _ = _forest(spark, d)
    return MD.feature_importance(clf).limit(10)


def attribution(spark: SparkSession, d: str) -> DataFrame:
    clf, rows = _boosted(spark, d)
    return MD.attribution(clf, rows, ["Source_File", S.ROW_ORD])


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Model stored, loaded again and applied to the whole table."""
    clf, rows = _boosted(spark, d)
    folder = new_folder(spark, "model")
    clf.save(folder)
    return J.score_table(MD.Classifier.load(spark, folder), rows.drop(MD.WEIGHT))


def sample(spark: SparkSession, d: str) -> DataFrame:
    return MD.sample_rows(labelled(spark, d), MD.SAMPLE_ROWS, ["Source_File", S.ROW_ORD])


def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return J.fingerprint(table(spark, d, "lineitem"))


def unseen_labels(spark: SparkSession, d: str) -> DataFrame:
    li = lineitem(spark, d).withColumn("Label", F.concat("l_returnflag", "Dataset"))
    tagged = splits.split_cross(li, "2017", "2018")
    return MD.unseen_labels(tagged.where("split = 'train'"), tagged.where("split = 'test'"), "Label")


def generalisation(spark: SparkSession, d: str) -> DataFrame:
    return J.generalisation(labelled(spark, d), _train_config(kind="forest", params=SMALL_FOREST),
                            ["file_holdout", "mixed_holdout", "cross_dataset_2017to2018", "cross_dataset_2018to2017",
                             "fused_2018holdout", "fused_2017holdout"])


def ablation(spark: SparkSession, d: str) -> DataFrame:
    return J.ablation(labelled(spark, d), _train_config())


QUERIES = {
    "train_forest": train_forest, "train_boosted": train_boosted, "train_binary": train_binary,
    "cv_scores": cv_scores, "search": search, "importance": importance,
    "attribution": attribution, "scored": scored, "fingerprint": fingerprint, "sample": sample,
    "unseen_labels": unseen_labels, "generalisation": generalisation, "ablation": ablation,
}

SQL = {
    "unseen_labels": f"""WITH {LINEITEM_SQL}
SELECT l_returnflag || '2018' AS "Label", count(*) AS n FROM li WHERE "Dataset" = '2018' GROUP BY 1""",
}
