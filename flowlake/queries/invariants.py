"""Checks of the learning queries by what must hold of them, so that SQL can say what to expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake import schema as S
from flowlake.functions.scalars import name
from flowlake.operators import tuning
from flowlake.operators.scoring import safe_label
from flowlake.plans import train_job as J
from flowlake.queries import learning as Q
from flowlake.queries.bindings import LINEITEM_SQL, table

_KEY = ["Source_File", S.ROW_ORD]


def sample_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows drawn, their different keys, and those that are rows of the table."""
    drawn, rows = Q.sample(spark, d), Q.labelled(spark, d)
    found = drawn.intersect(rows.select(drawn.columns)).agg(F.count("*").alias("n_found"))
    return drawn.agg(F.count("*").alias("n"), F.countDistinct(*_KEY).alias("n_different")).crossJoin(found)


def fingerprint_check(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint after moving the rows and after one change."""
    rows = table(spark, d, "lineitem")
    edited = rows.withColumn("l_tax", F.when(F.col("l_orderkey") == rows.agg(F.min("l_orderkey")).first()[0],
                                             F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    whole, moved, other = (J.fingerprint(x).first()["fingerprint"] for x in (rows, rows.repartition(7, "l_partkey"), edited))
    return rows.agg(F.count("*").alias("n"), F.lit(whole == moved).alias("same_when_moved"),
                    F.lit(whole == other).alias("same_when_edited"))


def scored_check(spark: SparkSession, d: str) -> DataFrame:
    """Scored rows, and how many have foreign labels, wrong probabilities or changed columns."""
    out, rows = Q.scored(spark, d), Q.labelled(spark, d)
    labels = sorted(r[0] for r in rows.select("Attack Type").distinct().collect())
    p = {v: F.col(f"`Probability_{safe_label(v)}`") for v in labels}
    own = F.coalesce(*[F.when(F.col("Prediction") == v, c) for v, c in p.items()])
    checks = {"n": F.lit(True), "n_foreign": ~F.col("Prediction").isin(labels),
              "n_not_one": F.abs(sum(p.values(), F.lit(0.0)) - 1) > 1e-6,
              "n_not_largest": own < F.greatest(*p.values()) - 1e-9}
    counted = out.agg(*[F.count_if(c).alias(k) for k, c in checks.items()],
                      (F.avg((F.col("Prediction") == F.col("Attack Type")).cast("double")) > 0.8).alias("right_enough"))
    kept = out.select(*[name(c) for c in rows.columns]).exceptAll(rows).agg(F.count("*").alias("n_changed"))
    return counted.crossJoin(kept)


def train_forest_support(spark: SparkSession, d: str) -> DataFrame:
    """Test rows per class of the forest."""
    return Q.train_forest(spark, d).select("label", F.col("support").cast("long").alias("support"))


def train_binary_support(spark: SparkSession, d: str) -> DataFrame:
    """Rows per class, and whether the rule behind the labels is learned."""
    return Q.train_binary(spark, d).select("label", F.col("support").cast("long").alias("support"),
                                           (F.col("f1") > 0.8).alias("learned"))


def train_boosted_record(spark: SparkSession, d: str) -> DataFrame:
    """What the experiment record says of the rows and classes."""
    return Q.train_boosted(spark, d).select(
        (F.col("n_train") + F.col("n_test")).alias("n"), F.size("classes").alias("n_classes"),
        F.expr("metrics['accuracy'] > 0.8").alias("learned"),
        F.expr("aggregate(map_values(per_class), 0L, (a, x) -> a + x.support) = n_test").alias("support_is_test"))


def cv_check(spark: SparkSession, d: str) -> DataFrame:
    """Folds and whether their scores are shares."""
    out = Q.cv_scores(spark, d)
    score = [c for c, t in out.dtypes if t == "double"][0]
    return out.agg(F.count("*").alias("n_folds"), F.count_if((F.col(score) < 0) | (F.col(score) > 1)).alias("n_wrong"))


def search_check(spark: SparkSession, d: str) -> DataFrame:
    """Candidates, values of theirs that were not drawn, and whether the winner had most rounds and learned the rule."""
    drawn = [{k: float(v) for k, v in p.items()} for p in tuning.draws(tuning.RANGED_SPACE, Q.SEARCH_DRAWS)]
    found = Q.search(spark, d).orderBy("place").collect()
    changed = sum(r["params"] not in drawn for r in found)
    most = found[0]["rounds"] == max(r["rounds"] for r in found) == Q.SEARCH_BUDGET
    halved = sorted(r["rounds"] for r in found)[:len(found) // 2] == [1] * (len(found) // 2)
    return table(spark, d, "lineitem").agg((F.count("*") > 0).alias("any_row")).select(
        F.lit(len(found)).cast("long").alias("n"), F.lit(changed).cast("long").alias("n_changed"), F.lit(most).alias("winner_ran_longest"),
        F.lit(halved).alias("half_left_first"), F.lit(found[0]["f1_macro"] > 0.6).alias("learned"))


def importance_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the table of the ten most important features, and whether they are shares in order."""
    rows = [r["importance"] for r in Q.importance(spark, d).collect()]
    return spark.createDataFrame([(len(rows), rows == sorted(rows, reverse=True), 0 < sum(rows) <= 1 + 1e-9)],
                                 "n long, in_order boolean, are_shares boolean")


def attribution_check(spark: SparkSession, d: str) -> DataFrame:
    """One effect for each feature and class, all of them changes of probabilities."""
    out = Q.attribution(spark, d)
    return out.agg(F.count("*").alias("n"), F.countDistinct("feature").alias("n_features"),
                   F.count_if((F.col("effect") < 0) | (F.col("effect") > 1)).alias("n_wrong"),
                   (F.max("effect") > 0.01).alias("any_effect"))


def _runs(out: DataFrame) -> DataFrame:
    return out.select("run", (F.col("n_train") + F.col("n_test")).alias("n"), F.col("accuracy").between(0, 1).alias("is_share"))


def generalisation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each strategy uses every row once; the gap is that to the first strategy."""
    out = Q.generalisation(spark, d)
    first = out.where("run = 'file_holdout'").select(F.col("f1_macro").alias("_first"))
    right = F.abs(F.col("_first") - F.col("f1_macro") - F.col("gap")) < 1e-9
    return out.crossJoin(first).select("run", (F.col("n_train") + F.col("n_test")).alias("n"), right.alias("gap_is_right"))


def ablation_rows(spark: SparkSession, d: str) -> DataFrame:
    return _runs(Q.ablation(spark, d))


QUERIES = {f.__name__: f for f in (
    sample_check, fingerprint_check, scored_check, train_forest_support, train_binary_support, train_boosted_record,
    cv_check, search_check, importance_check, attribution_check, generalisation_rows, ablation_rows)}

_CLASS = """CASE WHEN l_extendedprice > 60000 THEN 'DoS'
  WHEN l_quantity < 12 AND l_discount > 0.03 THEN 'Bot' ELSE 'Normal Traffic' END"""
_FOLDS = 3
_STRATEGIES = ("file_holdout", "mixed_holdout", "cross_dataset_2017to2018", "cross_dataset_2018to2017",
               "fused_2018holdout", "fused_2017holdout")

SQL = {
    "sample_check": "SELECT least(2000, count(*)) AS n, least(2000, count(*)) AS n_different, least(2000, count(*)) AS n_found FROM lineitem",
    "fingerprint_check": "SELECT count(*) AS n, true AS same_when_moved, false AS same_when_edited FROM lineitem",
    "scored_check": """SELECT count(*) AS n, 0 AS n_foreign, 0 AS n_not_one, 0 AS n_not_largest,
  true AS right_enough, 0 AS n_changed FROM lineitem""",
    "train_forest_support": """SELECT CAST(label AS VARCHAR) AS label, CAST(floor(0.2e0 * count(*) + 0.5e0) AS BIGINT) AS support
FROM embeddings GROUP BY 1""",
    "train_binary_support": f"""WITH {LINEITEM_SQL}
SELECT CASE WHEN {_CLASS} = 'Normal Traffic' THEN 'BENIGN' ELSE 'ATTACK' END AS label, count(*) AS support, true AS learned
FROM li GROUP BY 1""",
    "train_boosted_record": f"""WITH {LINEITEM_SQL}
SELECT count(*) AS n, count(DISTINCT {_CLASS}) AS n_classes, true AS learned, true AS support_is_test FROM li""",
    "cv_check": f"SELECT least({_FOLDS}, count(*)) AS n_folds, 0 AS n_wrong FROM embeddings",
    "search_check": f"""SELECT {Q.SEARCH_DRAWS} AS n, 0 AS n_changed, true AS winner_ran_longest, true AS half_left_first,
  true AS learned FROM (SELECT count(*) AS n FROM lineitem)""",
    "importance_check": "SELECT least(10, len(embedding)) AS n, true AS in_order, true AS are_shares FROM embeddings LIMIT 1",
    "attribution_check": f"""WITH {LINEITEM_SQL}
SELECT 4 * count(DISTINCT {_CLASS}) AS n, 4 AS n_features, 0 AS n_wrong, true AS any_effect FROM li""",
    "generalisation_rows": "SELECT run, n, true AS gap_is_right FROM (SELECT count(*) AS n FROM lineitem), (VALUES "
                           + ", ".join(f"('{s}')" for s in _STRATEGIES) + ") v(run)",
    "ablation_rows": """SELECT run, n, true AS is_share FROM (SELECT count(*) AS n FROM lineitem),
  (VALUES ('full'), ('without port'), ('without environment'), ('hardened')) v(run)""",
}
