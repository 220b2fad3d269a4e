"""Splits, folds and feature selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake import schema as S
from flowlake.functions.scalars import name
from flowlake.operators import selection as SEL
from flowlake.operators import splits as SP
from flowlake.queries.bindings import GROUPED, RAW_SQL, grid, grid_sql
from flowlake.queries.cleaning import _derived, headerless
from flowlake.operators.clean import group_labels

# The files the seeded draw picks among the seven of the check tables.
HOLDOUT_LITERAL = ("f1995", "f1996")
MIXED_LITERAL = ("f1996", "f1999")


def grouped(spark: SparkSession, d: str) -> DataFrame:
    return group_labels(headerless(spark, d), S.label_map(spark))


def by_file(strategy: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return SP.split_report(SP.assign_split(grouped(spark, d), strategy))
    return run


def by_row(strategy: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return SP.assign_split(grouped(spark, d), strategy).select("Source_File", S.ROW_ORD, "split")
    return run


def by_class(strategy: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return (SP.assign_split(grouped(spark, d), strategy)
                .groupBy("Attack Type", "Dataset", "split").agg(F.count("*").alias("n"))
                .groupBy("Attack Type", "split").agg(F.sum("n").alias("n")))
    return run


def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return (SP.stratified_folds(grouped(spark, d), "Attack Type")
            .groupBy("Attack Type", "fold").agg(F.count("*").alias("n")))


def group_folds(spark: SparkSession, d: str) -> DataFrame:
    return (SP.group_folds(grouped(spark, d)).groupBy("Source_File", "fold")
            .agg(F.count("*").alias("n")))


def zero_variance(spark: SparkSession, d: str) -> DataFrame:
    rows = _derived(spark, d)
    cols = SEL.numeric_features(rows)
    flat = SEL.zero_variance(rows, cols)
    n = rows.count()
    return spark.createDataFrame([(c, c in flat, n) for c in cols],
                                 "column string, constant boolean, n_rows long")


_CORR = ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "dup", "lin"]


def correlation_pairs(spark: SparkSession, d: str) -> DataFrame:
    return SEL.correlation_pairs(_derived(spark, d), _CORR).withColumn("r", grid(F.col("r"), 5))


def correlated_drop(spark: SparkSession, d: str) -> DataFrame:
    """Selector fitted on the training side of the split, applied to the test side."""
    rows = SP.assign_split(_derived(spark, d), "file")
    train = rows.where("split = 'train'").drop("split")
    model = SEL.FeatureSelector(irrelevant=["l_discount"]).fit(train)
    test = model.transform(rows.where("split = 'test'").drop("split"))
    return test.groupBy().agg(
        F.count("*").alias("n_test"), F.lit(",".join(model.features)).alias("kept"),
        *[F.sum(name(c)).cast("double").alias(f"sum_{c}") for c in model.features]).select(
            "n_test", "kept", *[grid(F.col(f"sum_{c}"), 2).alias(f"sum_{c}") for c in model.features])


QUERIES = {
    "split_per_file": by_row("per_file"), "split_temporal": by_row("temporal"),
    "split_file": by_row("file"), "split_file_holdout": by_row("file_holdout"),
    "split_mixed": by_row("mixed_holdout"), "split_cross_1718": by_row("cross_dataset_2017to2018"),
    "split_cross_1817": by_row("cross_dataset_2018to2017"), "split_random": by_class("random"),
    "split_fused_18": by_class("fused_2018holdout"), "split_fused_17": by_class("fused_2017holdout"),
    "split_report": by_file("file_holdout"), "stratified_folds": stratified_folds,
    "group_folds": group_folds, "zero_variance": zero_variance,
    "correlation_pairs": correlation_pairs, "correlated_drop": correlated_drop,
}

_GROUPED = f"""{RAW_SQL}, g AS (SELECT {GROUPED} AS "Attack Type", "Source_File", "Dataset", row_ord
  FROM raw WHERE trim("Label") <> 'Label')"""


def _rows(test: str) -> str:
    return f"""WITH {_GROUPED}
SELECT "Source_File", row_ord, CASE WHEN {test} THEN 'test' ELSE 'train' END AS split FROM g"""


def _in(files) -> str:
    return '"Source_File" IN (' + ", ".join(f"'{f}'" for f in files) + ")"


def _fused(holdout: str) -> str:
    return f"""WITH {_GROUPED}, c AS (
  SELECT "Attack Type", count(*) FILTER ("Dataset" = '{holdout}') AS h, count(*) AS n FROM g GROUP BY 1),
t AS (SELECT *, CASE WHEN h < 2 THEN 0 ELSE CAST(floor(0.2e0 * h + 0.5e0) AS BIGINT) END AS k FROM c)
SELECT "Attack Type", 'test' AS split, k AS n FROM t WHERE k > 0
UNION ALL SELECT "Attack Type", 'train', n - k FROM t WHERE n > k"""


SQL = {
    "split_per_file": f"""WITH {_GROUPED}, r AS (
  SELECT *, row_number() OVER (PARTITION BY "Source_File" ORDER BY row_ord) AS rn,
         count(*) OVER (PARTITION BY "Source_File") AS n FROM g)
SELECT "Source_File", row_ord, CASE WHEN rn <= floor(0.7e0 * n) THEN 'train' ELSE 'test' END AS split FROM r""",
    "split_temporal": f"""WITH {_GROUPED}, r AS (
  SELECT *, row_number() OVER (ORDER BY "Dataset", "Source_File", row_ord) AS rn, count(*) OVER () AS n FROM g)
SELECT "Source_File", row_ord, CASE WHEN rn <= floor(0.8e0 * n) THEN 'train' ELSE 'test' END AS split FROM r""",
    "split_file": _rows("\"Source_File\" = (SELECT max(\"Source_File\") FROM g)"),
    "split_file_holdout": _rows(_in(HOLDOUT_LITERAL)),
    "split_mixed": _rows(_in(MIXED_LITERAL)),
    "split_cross_1718": _rows("\"Dataset\" = '2018'"),
    "split_cross_1817": _rows("\"Dataset\" = '2017'"),
    "split_random": f"""WITH {_GROUPED}, c AS (
  SELECT "Attack Type", count(*) AS n, CAST(floor(0.2e0 * count(*) + 0.5e0) AS BIGINT) AS k FROM g GROUP BY 1)
SELECT "Attack Type", 'test' AS split, k AS n FROM c UNION ALL SELECT "Attack Type", 'train', n - k FROM c""",
    "split_fused_18": _fused("2018"), "split_fused_17": _fused("2017"),
    "split_report": f"""WITH {_GROUPED}
SELECT CASE WHEN {_in(HOLDOUT_LITERAL)} THEN 'test' ELSE 'train' END AS split, "Source_File",
       count(*) AS n FROM g GROUP BY 1, 2""",
    "stratified_folds": f"""WITH {_GROUPED}, r AS (
  SELECT "Attack Type", row_number() OVER (PARTITION BY "Attack Type" ORDER BY "Source_File", row_ord) AS rn FROM g)
SELECT "Attack Type", CAST((rn - 1) % 5 AS INTEGER) AS fold, count(*) AS n FROM r GROUP BY 1, 2""",
    "group_folds": f"""WITH RECURSIVE {_GROUPED}, s AS (
  SELECT "Source_File", count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, "Source_File" DESC) AS rn
  FROM g GROUP BY 1),
a AS (
  SELECT CAST(0 AS BIGINT) AS rn, '' AS "Source_File", CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS fold,
         CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load
  UNION ALL
  SELECT s.rn, s."Source_File", s.n, list_position(a.load, list_min(a.load)) - 1,
         list_transform(range(5), lambda i: a.load[i + 1]
           + CASE WHEN i + 1 = list_position(a.load, list_min(a.load)) THEN s.n ELSE 0 END)
  FROM a JOIN s ON s.rn = a.rn + 1)
SELECT "Source_File", CAST(fold AS INTEGER) AS fold, n FROM a WHERE rn > 0""",
    "zero_variance": """WITH v AS (
  SELECT l_quantity, l_discount, l_tax, l_extendedprice, l_tax AS dup, 1.0e0 AS "const",
         2 * l_quantity + 0.01e0 * l_discount AS lin, l_linenumber - l_linenumber AS zero FROM lineitem),
n AS (SELECT count(*) AS n_rows FROM v)
""" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", (SELECT count(DISTINCT \"{c}\") <= 1 FROM v) AS constant, n_rows FROM n"
        for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice", "dup", "const", "lin", "zero")),
    "correlation_pairs": """WITH v AS (
  SELECT l_quantity, l_discount, l_tax, l_extendedprice, l_tax AS dup,
         2 * l_quantity + 0.01e0 * l_discount AS lin FROM lineitem)
""" + "\nUNION ALL ".join(
        f"SELECT '{_CORR[i]}' AS feature_a, '{_CORR[j]}' AS feature_b, "
        f"{grid_sql(f'abs(corr({_CORR[i]}, {_CORR[j]}))', 5)} AS r FROM v"
        for j in range(len(_CORR)) for i in range(j)),
    "correlated_drop": f"""WITH v AS (
  SELECT *, year(l_shipdate) AS y, 2 * l_quantity + 0.01e0 * l_discount AS lin FROM lineitem),
t AS (SELECT * FROM v WHERE y < (SELECT max(y) FROM v)),
k AS (SELECT abs(corr(l_quantity, l_tax)) <= 0.95 AS tax, abs(corr(l_quantity, l_extendedprice)) <= 0.95 AS price,
      abs(corr(l_quantity, lin)) > 0.95 AS lin FROM t)
SELECT count(*) AS n_test,
       (SELECT 'l_quantity' || CASE WHEN tax THEN ',l_tax' ELSE '' END
               || CASE WHEN price THEN ',l_extendedprice' ELSE '' END
               || CASE WHEN lin THEN '' ELSE ',lin' END FROM k) AS kept,
       {grid_sql('sum(l_quantity)', 2)} AS sum_l_quantity, {grid_sql('sum(l_tax)', 2)} AS sum_l_tax,
       {grid_sql('sum(l_extendedprice)', 2)} AS sum_l_extendedprice
FROM v WHERE y = (SELECT max(y) FROM v)""",
}
