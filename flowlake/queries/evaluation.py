"""Classification metrics over a rule that plays the classifier, and scoring helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake import schema as S
from flowlake.functions.scalars import name
from flowlake.operators import metrics as M
from flowlake.operators import scoring as SC
from flowlake.operators import splits as SP
from flowlake.operators.clean import number
from flowlake.queries.bindings import (
    LINEITEM_SQL, RAW_SQL, grid, grid_sql, lineitem, raw_flows, table)
from flowlake.queries.cleaning import headerless

# The rule predicts X now and then, a class that never truly occurs.
_RULE = """CASE WHEN l_linestatus = 'F' AND l_quantity < 25 THEN 'A' WHEN l_linestatus = 'F' THEN 'R'
  WHEN l_quantity >= 49 THEN 'X' ELSE 'N' END"""


def ruled(spark: SparkSession, d: str) -> DataFrame:
    return lineitem(spark, d).select(F.col("l_returnflag").alias("y"), F.expr(_RULE).alias("yhat"),
                                     "Source_File", S.ROW_ORD)


def _cm(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(ruled(spark, d), "y", "yhat")


def _grid_all(df: DataFrame, columns) -> DataFrame:
    return df.select(*[grid(F.col(c)).alias(c) if c in columns else name(c) for c in df.columns])


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion_matrix(_cm(spark, d))


def per_class(spark: SparkSession, d: str) -> DataFrame:
    return _grid_all(M.per_class_metrics(_cm(spark, d)), ("precision", "recall", "f1"))


def summary_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = M.summary_metrics(_cm(spark, d))
    return _grid_all(out, [c for c in out.columns if c != "n"])


def report(spark: SparkSession, d: str) -> DataFrame:
    return _grid_all(M.classification_report(_cm(spark, d)), ("precision", "recall", "f1"))


def _auc(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    scores = {"A": F.col("l_discount"), "N": F.col("l_tax"), "R": F.col("l_extendedprice") / 1e6}
    return M.roc_auc_ovr(li, "l_returnflag", scores)


def roc_auc_ovr(spark: SparkSession, d: str) -> DataFrame:
    return _auc(spark, d).withColumn("auc", grid(F.col("auc")))


def roc_auc_macro(spark: SparkSession, d: str) -> DataFrame:
    return M.roc_auc_macro(_auc(spark, d)).select(grid(F.col("roc_auc_macro")).alias("roc_auc_macro"))


def fold_scores(spark: SparkSession, d: str) -> DataFrame:
    return M.fold_f1(SP.group_folds(ruled(spark, d)), "fold", "y", "yhat")


def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    return _grid_all(M.fold_summary(fold_scores(spark, d)), ("mean", "spread"))


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    w = M.class_weights(table(spark, d, "labels"), "quality")
    return w.withColumn("weight", grid(F.col("weight")))


def row_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights attached to the rows; per class they add up to rows / classes."""
    rows = M.attach_weights(headerless(spark, d), "Label")
    return rows.groupBy("Label").agg(F.count("*").alias("n"), grid(F.sum("weight"), 3).alias("total"))


def impute_score_input(spark: SparkSession, d: str) -> DataFrame:
    """Identifier and label columns out, text read, every gap 0, features in model order."""
    raw = raw_flows(spark, d).withColumn("q", number(F.col("q"))).withColumn("Src IP", F.lit("x"))
    keyed = raw.withColumn("_key", F.col(S.ROW_ORD))
    out = SC.align_features(SC.impute_scoring(SC.drop_for_scoring(keyed)),
                            ["l_tax", "q", "l_discount"], keep=["_key"])
    return out.withColumnRenamed("_key", "row_key")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Three class probabilities per order line and the winning class."""
    li = lineitem(spark, d)
    a, b = F.col("l_discount") * 4 + 0.1, F.col("l_tax") * 5 + 0.2
    c = F.col("l_quantity") / 100.0 + 0.05
    total = a + b + c
    return SC.prediction_columns(li.select(
        S.ROW_ORD, "l_shipdate", "l_quantity", F.array(a / total, b / total, c / total).alias("p")),
        "p", ["Normal Traffic", "DoS", "Web Attacks/X"])


def alerts(spark: SparkSession, d: str) -> DataFrame:
    out = SC.alerts(predictions(spark, d), only_non_benign=True, min_confidence=0.45)
    return out.select(S.ROW_ORD, "prediction", grid(F.col("confidence"), 4).alias("confidence"))


def top_probs(spark: SparkSession, d: str) -> DataFrame:
    out = SC.top_probabilities(predictions(spark, d), 2)
    return out.select(S.ROW_ORD, *[x for i in (0, 1) for x in (
        F.col("top")[i]["key"].alias(f"class{i + 1}"),
        grid(F.col("top")[i]["value"], 4).alias(f"p{i + 1}"))])


def alert_json(spark: SparkSession, d: str) -> DataFrame:
    """The JSON text of each alert, parsed again so that engines compare values."""
    p = SC.alerts(predictions(spark, d), True, 0.0).select(
        F.col("l_shipdate").cast("timestamp").alias("end_time"), F.lit("h1").alias("src_ip"),
        F.lit("h2").alias("dst_ip"), F.lit(1).alias("src_port"), F.lit(2).alias("dst_port"),
        F.lit("TCP").alias("protocol"), (F.col("l_quantity") / 7).alias("duration_s"),
        F.col(S.ROW_ORD).alias("packets"), "prediction", "confidence", "probabilities")
    layout = ("ts string, proto string, prediction string, packets long, duration_s double, "
              "probabilities map<string,double>")
    back = SC.to_alert_json(p).select(F.from_json("value", layout).alias("a")).select("a.*")
    return back.select("ts", "proto", "prediction", "packets",
                       grid(F.col("duration_s"), 4).alias("duration_s"),
                       grid(F.col("probabilities")["DoS"], 4).alias("dos"))


def prediction_summary(spark: SparkSession, d: str) -> DataFrame:
    return SC.prediction_counts(predictions(spark, d))


def prediction_head(spark: SparkSession, d: str) -> DataFrame:
    wide = SC.probability_columns(predictions(spark, d), "p", ["Normal Traffic", "DoS", "Web Attacks/X"])
    out = SC.head_of_predictions(wide, [S.ROW_ORD])
    return out.select(*[grid(F.col(c), 4).alias(c) if kind == "double" else F.col(c)
                        for c, kind in out.dtypes])


QUERIES = {
    "confusion": confusion, "per_class": per_class, "summary_metrics": summary_metrics,
    "report": report, "roc_auc_ovr": roc_auc_ovr, "roc_auc_macro": roc_auc_macro,
    "fold_summary": fold_summary, "class_weights": class_weights, "row_weights": row_weights,
    "impute_score_input": impute_score_input, "alerts": alerts, "top_probs": top_probs,
    "alert_json": alert_json, "prediction_summary": prediction_summary,
    "prediction_head": prediction_head,
}

_RULED = f"""{LINEITEM_SQL}, r AS (SELECT l_returnflag AS y, {_RULE} AS yhat, "Source_File" FROM li)"""
_LAB = f"""{_RULED}, lab AS (SELECT y AS label FROM r UNION SELECT yhat FROM r),
m AS (SELECT label, (SELECT count(*) FROM r WHERE y = label AND yhat = label) AS tp,
             (SELECT count(*) FROM r WHERE y = label) AS support,
             (SELECT count(*) FROM r WHERE yhat = label) AS predicted FROM lab),
x AS (SELECT label, tp, support,
  CASE WHEN predicted = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / predicted END AS "precision",
  CASE WHEN support = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / support END AS recall,
  CASE WHEN predicted + support = 0 THEN 0 ELSE 2.0e0 * tp / (predicted + support) END AS f1 FROM m)"""
_G3 = ", ".join(f'{grid_sql(c)} AS {c}' for c in ('"precision"', "recall", "f1"))

_PRED = f"""{LINEITEM_SQL}, z AS (SELECT *, l_discount * 4 + 0.1e0 AS a, l_tax * 5 + 0.2e0 AS b,
  l_quantity / 100.0e0 + 0.05e0 AS c FROM li),
pr AS (SELECT row_ord, l_shipdate, l_quantity, round(a / (a + b + c), 6) AS p0,
  round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2 FROM z),
best AS (SELECT *, greatest(p0, p1, p2) AS confidence, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'Normal Traffic'
  WHEN p1 >= p2 THEN 'DoS' ELSE 'Web Attacks/X' END AS prediction FROM pr)"""


def _auc_sql(label: str, score: str) -> str:
    return f"""SELECT '{label}' AS label, count(*) FILTER (y) AS n_pos, count(*) FILTER (NOT y) AS n_neg,
  (sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0e0)
    / (CAST(count(*) FILTER (y) AS DOUBLE) * count(*) FILTER (NOT y)) AS auc
FROM (SELECT l_returnflag = '{label}' AS y, rank() OVER (ORDER BY {score})
        + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0e0 AS rk FROM lineitem)"""


_AUCS = "\nUNION ALL ".join(_auc_sql(k, s) for k, s in
                            (("A", "l_discount"), ("N", "l_tax"), ("R", "l_extendedprice")))

SQL = {
    "confusion": f"""WITH {_RULED}, lab AS (SELECT y FROM r UNION SELECT yhat FROM r)
SELECT lab.y, """ + ", ".join(f"count(*) FILTER (r.yhat = '{v}') AS \"pred_{v}\"" for v in "ANRX")
    + " FROM lab LEFT JOIN r ON r.y = lab.y GROUP BY lab.y",
    "per_class": f"""WITH {_LAB} SELECT label, {_G3}, support FROM x WHERE support > 0""",
    "summary_metrics": f"""WITH {_LAB}
SELECT {grid_sql('sum(tp) / CAST(sum(support) AS DOUBLE)')} AS accuracy, """ + ", ".join(
        f"{grid_sql(f'sum({q} * support) / sum(support)')} AS {c}_weighted, {grid_sql(f'avg({q})')} AS {c}_macro"
        for c, q in (("precision", '"precision"'), ("recall", "recall"), ("f1", "f1")))
    + ", CAST(sum(support) AS BIGINT) AS n FROM x",
    "report": f"""WITH {_LAB}, s AS (SELECT * FROM x WHERE support > 0), u AS (
  SELECT label, "precision", recall, f1, support FROM s
  UNION ALL SELECT 'accuracy', sum(tp) / CAST(sum(support) AS DOUBLE), sum(tp) / CAST(sum(support) AS DOUBLE),
         sum(tp) / CAST(sum(support) AS DOUBLE), sum(support) FROM s
  UNION ALL SELECT 'macro avg', avg("precision"), avg(recall), avg(f1), sum(support) FROM s
  UNION ALL SELECT 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1 * support) / sum(support), sum(support) FROM s)
SELECT label, {_G3}, CAST(support AS BIGINT) AS support FROM u""",
    "roc_auc_ovr": f"WITH t AS ({_AUCS}) SELECT label, n_pos, n_neg, {grid_sql('auc')} AS auc FROM t",
    "roc_auc_macro": f"WITH t AS ({_AUCS}) SELECT {grid_sql('avg(auc)')} AS roc_auc_macro FROM t",
    "fold_summary": f"""WITH RECURSIVE {_RULED}, s AS (
  SELECT "Source_File", count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, "Source_File" DESC) AS rn
  FROM r GROUP BY 1),
a AS (
  SELECT CAST(0 AS BIGINT) AS rn, '' AS "Source_File", CAST(-1 AS BIGINT) AS fold,
         CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load
  UNION ALL
  SELECT s.rn, s."Source_File", list_position(a.load, list_min(a.load)) - 1,
         list_transform(range(5), lambda i: a.load[i + 1]
           + CASE WHEN i + 1 = list_position(a.load, list_min(a.load)) THEN s.n ELSE 0 END)
  FROM a JOIN s ON s.rn = a.rn + 1),
q AS (SELECT fold, y, yhat FROM r JOIN a USING ("Source_File")),
h AS (SELECT fold, label, sum(tp) AS tp, sum(size) AS size FROM (
  SELECT fold, y AS label, CASE WHEN y = yhat THEN 1 ELSE 0 END AS tp, 1 AS size FROM q
  UNION ALL SELECT fold, yhat, 0, 1 FROM q) GROUP BY 1, 2),
f AS (SELECT fold, avg(2.0e0 * tp / size) AS score FROM h GROUP BY 1)
SELECT count(*) AS folds, {grid_sql('avg(score)')} AS mean, {grid_sql('2 * stddev_pop(score)')} AS spread FROM f""",
    "class_weights": f"""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
SELECT quality, n, {grid_sql('CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n)')} AS weight FROM c""",
    "row_weights": f"""WITH {RAW_SQL}, c AS (
  SELECT "Label", count(*) AS n FROM raw WHERE trim("Label") <> 'Label' GROUP BY 1)
SELECT "Label", n, {grid_sql('CAST(sum(n) OVER () AS DOUBLE) / count(*) OVER ()', 3)} AS total FROM c""",
    "impute_score_input": f"""WITH {RAW_SQL}, v AS (SELECT *, TRY_CAST(q AS DOUBLE) AS x FROM raw)
SELECT l_tax, CASE WHEN x IS NULL OR NOT isfinite(x) THEN 0 ELSE x END AS q, l_discount, row_ord AS row_key FROM v""",
    "alerts": f"""WITH {_PRED} SELECT row_ord, prediction, {grid_sql('confidence', 4)} AS confidence FROM best
WHERE prediction <> 'Normal Traffic' AND confidence >= 0.45e0""",
    "top_probs": f"""WITH {_PRED}, u AS (
  SELECT row_ord, 'Normal Traffic' AS k, p0 AS p FROM pr UNION ALL SELECT row_ord, 'DoS', p1 FROM pr
  UNION ALL SELECT row_ord, 'Web Attacks/X', p2 FROM pr),
t AS (SELECT *, row_number() OVER (PARTITION BY row_ord ORDER BY p DESC, k) AS rn FROM u)
SELECT row_ord, max(k) FILTER (rn = 1) AS class1, {grid_sql('max(p) FILTER (rn = 1)', 4)} AS p1,
       max(k) FILTER (rn = 2) AS class2, {grid_sql('max(p) FILTER (rn = 2)', 4)} AS p2 FROM t GROUP BY 1""",
    "alert_json": f"""WITH {_PRED}
SELECT strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS ts, 'TCP' AS proto, prediction, row_ord AS packets,
       {grid_sql('round(l_quantity / 7, 6)', 4)} AS duration_s, {grid_sql('p1', 4)} AS dos
FROM best WHERE prediction <> 'Normal Traffic'""",
    "prediction_summary": f"""WITH {_PRED} SELECT prediction AS "Prediction", count(*) AS n FROM best GROUP BY 1""",
    "prediction_head": f"""WITH {_PRED}
SELECT row_ord, prediction, {grid_sql('confidence', 4)} AS confidence, {grid_sql('p0', 4)} AS "Probability_Normal_Traffic",
       {grid_sql('p1', 4)} AS "Probability_DoS", {grid_sql('p2', 4)} AS "Probability_Web_Attacks_X"
FROM best ORDER BY row_ord LIMIT 10""",
}
