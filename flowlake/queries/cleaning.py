"""Ingest and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake import schema as S
from flowlake.functions.scalars import name
from flowlake.operators import canonical as K
from flowlake.operators import clean as C
from flowlake.operators.metrics import class_weights
from flowlake.plans import clean_job
from flowlake.queries.bindings import (
    CLEAN_SQL, GROUPED, LINEITEM_SQL, RAW_SQL, grid, grid_sql, lineitem, raw_flows)
from flowlake.session import new_folder
from flowlake.sources import flow_csv

RARE_BELOW = 1000
#: Rows of an input file of the cleaning job; a compressed file is read by one task.
CSV_ROWS = 100_000


def headerless(spark: SparkSession, d: str) -> DataFrame:
    return K.drop_embedded_headers(raw_flows(spark, d))


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return clean_job.clean_rows(headerless(spark, d))


def clean_flows(spark: SparkSession, d: str) -> DataFrame:
    out = clean_job.clean_flows(headerless(spark, d), RARE_BELOW, drop_duplicate_columns=False)
    return out.select("Label", *[grid(F.col(c), 4).alias(c) for c in ("q", "l_discount", "l_tax")],
                      "Source_File", "Dataset", S.ROW_ORD, name("Attack Type"))


def class_balance(spark: SparkSession, d: str, min_count: int = RARE_BELOW) -> DataFrame:
    """Clean, group, drop rare classes, then size and weight of each class."""
    rows = clean_job.clean_flows(headerless(spark, d), min_count, drop_duplicate_columns=False)
    return class_weights(rows, "Attack Type").select(
        name("Attack Type"), "n", grid(F.col("weight")).alias("weight"))


_GROUPED_SQL = CLEAN_SQL + f""", grouped AS (
  SELECT trim("Label") AS "Label", q, l_discount, l_tax, "Source_File", "Dataset", row_ord,
         {GROUPED} AS "Attack Type" FROM clean),
kept AS (SELECT * FROM grouped WHERE "Attack Type" NOT IN ('Infiltration', 'Heartbleed')
  AND "Attack Type" IN (SELECT "Attack Type" FROM grouped GROUP BY 1 HAVING count(*) >= {RARE_BELOW}))"""


def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return C.label_distribution(headerless(spark, d))


def group_distribution(spark: SparkSession, d: str) -> DataFrame:
    return C.label_distribution(C.group_labels(cleaned(spark, d), S.label_map(spark)), "Attack Type")


def rows_per_file(spark: SparkSession, d: str) -> DataFrame:
    return C.rows_per_file(headerless(spark, d))


def unmapped_labels(spark: SparkSession, d: str) -> DataFrame:
    return C.unmapped_labels(raw_flows(spark, d), S.label_map(spark))


def drop_rare(spark: SparkSession, d: str) -> DataFrame:
    grouped = C.group_labels(headerless(spark, d), S.label_map(spark))
    return (C.drop_rare_classes(grouped, min_count=RARE_BELOW)
            .groupBy("Attack Type", "Source_File").agg(F.count("*").alias("n")))


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    rows = C.coerce_numeric(headerless(spark, d))
    return C.quality_report(rows).withColumn("incomplete_pct", grid(F.col("incomplete_pct")))


def dedup_rows(spark: SparkSession, d: str) -> DataFrame:
    """Exact de-duplication of the raw text rows, first position kept."""
    return C.dedup_rows(headerless(spark, d)).select(
        K.stripped(F.col("Label")).alias("Label"), C.number(F.col("q")).alias("q"),
        "l_discount", "l_tax", "Source_File", "Dataset", S.ROW_ORD)


def dedup_report(spark: SparkSession, d: str) -> DataFrame:
    rows = C.drop_incomplete(C.nullify_infinite(C.coerce_numeric(headerless(spark, d))))
    return C.dedup_report(rows).withColumn("removed_pct", grid(F.col("removed_pct")))


def _half(spark: SparkSession, d: str, dialect: str) -> DataFrame:
    """Lineitem under the column names of one dialect, stray spaces included."""
    li = lineitem(spark, d).where(F.col("Dataset") == dialect)
    label = F.when(F.col("l_orderkey") % 101 == 0, " Label").otherwise(F.col("l_returnflag"))
    if dialect == "2018":
        return li.select(
            F.col("l_suppkey").alias("Dst Port"), F.lit(6).alias("Protocol"),
            F.col("l_shipdate").alias("Timestamp"), F.col("l_partkey").alias("Flow Duration "),
            F.col("l_linenumber").alias("Tot Fwd Pkts"), F.col("l_quantity").alias("Flow Byts/s"),
            label.alias("Label"), F.col("l_tax").alias("Surplus"), "Source_File", S.ROW_ORD)
    return li.select(
        F.col("l_suppkey").alias(" Destination Port"), F.col("l_partkey").alias(" Flow Duration"),
        F.col("l_linenumber").alias(" Total Fwd Packets"), F.col("l_quantity").alias("Flow Bytes/s"),
        F.col("l_tax").alias(" Fwd Header Length.1"), label.alias(" Label"), "Source_File", S.ROW_ORD)


def canonicalize(spark: SparkSession, d: str) -> DataFrame:
    both = K.canonicalize(_half(spark, d, "2017"), "2017").unionByName(
        K.canonicalize(_half(spark, d, "2018"), "2018"))
    absent = sum((name(c).isNull().cast("int") for c in S.CANONICAL_COLUMNS), F.lit(0))
    return both.select(
        *[name(c) for c in ("Destination Port", "Flow Duration", "Total Fwd Packets",
                            "Flow Bytes/s", "Label", "Source_File", "Dataset")],
        absent.alias("absent"), S.ROW_ORD)


def schema_drift(spark: SparkSession, d: str) -> DataFrame:
    """Missing and extra columns of each file with the number of rows they concern."""
    per_file = []
    for dialect in ("2017", "2018"):
        half = _half(spark, d, dialect)
        header = [c for c in half.columns if c not in ("Source_File", S.ROW_ORD)]
        files = half.groupBy("Source_File").agg(F.count("*").alias("n_rows")).collect()
        per_file += [(f, header, n) for f, n in files]
    report = K.drift_report(spark, [(f, h) for f, h, _ in per_file])
    rows = spark.createDataFrame([(f, n) for f, _, n in per_file], "source_file string, n_rows long")
    return report.join(rows, "source_file")


def cap_per_file(spark: SparkSession, d: str) -> DataFrame:
    return K.cap_per_file(headerless(spark, d), 1000).select("Source_File", S.ROW_ORD)


def csv_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Both dialects written as CSV, read back through dialect detection and cleaned."""
    folder = new_folder(spark, "csv")
    for dialect in ("2017", "2018"):
        _half(spark, d, dialect).drop("Source_File", S.ROW_ORD).write.csv(
            f"{folder}/{dialect}", header=True)
    flows = flow_csv.read_flows(spark, [f"{folder}/2017", f"{folder}/2018", f"{folder}/none"])
    typed = C.coerce_numeric(flows)
    return typed.groupBy("Dataset", "Label").agg(
        F.count("*").alias("n"), F.sum(name("Destination Port")).alias("ports"),
        F.sum(name("Flow Duration")).alias("duration"),
        F.sum(name("Total Fwd Packets")).alias("packets"),
        F.sum(name("Flow Bytes/s").cast("double")).alias("rate"))


def clean_job_rows(spark: SparkSession, d: str) -> DataFrame:
    """The whole job over files of both dialects that arrive one after the other, with what the writes counted.

    Every feature has a value; some rates are no numbers, and every row is different.
    """
    folder, short = new_folder(spark, "job"), {v: k for k, v in S.RENAME_2018.items()}
    rows = raw_flows(spark, d).select("Label", "q", S.ROW_ORD, "Dataset")
    report: dict = {}
    for dialect in ("2017", "2018"):
        part = rows.where(F.col("Dataset") == dialect)
        values = [F.col("q") if c == "Flow Bytes/s" else (F.col(S.ROW_ORD) * 2 + i).cast("string") for i, c in enumerate(S.FEATURES)]
        names = [f" {c}" if dialect == "2017" else short.get(c, c) for c in S.FEATURES]
        part.select(*[v.alias(c) for v, c in zip(values, names)], F.trim("Label").alias("Label")).write.option(
            "maxRecordsPerFile", CSV_ROWS).csv(f"{folder}/{dialect}", header=True, compression="gzip")
        inputs = [f"{folder}/{x}" for x in ("2017", "2018")]
        table = clean_job.run_new(spark, inputs, f"{folder}/merged", f"{folder}/clean{dialect}", RARE_BELOW, report=report)
    counts = {k: report[k] for k in ("n_rows", "incomplete_rows", "n_read", "n_kept", "n_clean")}
    return table.groupBy("Attack Type", "Dataset").agg(
        F.count("*").alias("n"), F.sum(name("Destination Port")).alias("ports"),
        *[F.lit(v).cast("long").alias(k) for k, v in counts.items()])


def _derived(spark: SparkSession, d: str) -> DataFrame:
    return lineitem(spark, d).select(
        "l_quantity", "l_discount", "l_tax", "l_extendedprice", F.col("l_tax").alias("dup"),
        F.lit(1.0).alias("const"),
        (2 * F.col("l_quantity") + 0.01 * F.col("l_discount")).alias("lin"),
        (F.col("l_linenumber") - F.col("l_linenumber")).alias("zero"), "Source_File", S.ROW_ORD)


def duplicate_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = _derived(spark, d)
    twins = C.duplicate_columns(rows)
    kept = [c for c in C.feature_columns(rows) if c not in twins]
    n = rows.count()
    return spark.createDataFrame([(c, c in twins, n) for c in kept + twins],
                                 "column string, dropped boolean, n_rows long")


QUERIES = {
    "clean_flows": clean_flows, "class_balance": class_balance,
    "label_distribution": label_distribution, "group_distribution": group_distribution,
    "rows_per_file": rows_per_file, "unmapped_labels": unmapped_labels, "drop_rare": drop_rare,
    "quality_report": quality_report, "dedup_rows": dedup_rows, "dedup_report": dedup_report,
    "canonicalize": canonicalize, "schema_drift": schema_drift, "cap_per_file": cap_per_file,
    "csv_ingest": csv_ingest, "clean_job": clean_job_rows, "duplicate_columns": duplicate_columns,
}

_HALF_HEADER = {
    "2017": [" Destination Port", " Flow Duration", " Total Fwd Packets", "Flow Bytes/s",
             " Fwd Header Length.1", " Label"],
    "2018": ["Dst Port", "Protocol", "Timestamp", "Flow Duration ", "Tot Fwd Pkts", "Flow Byts/s",
             "Label", "Surplus"],
}
_PRESENT = ["Destination Port", "Flow Duration", "Total Fwd Packets", "Flow Bytes/s", "Label",
            "Source_File", "Dataset"]
_MISSING = ", ".join(f"('{c}')" for c in S.CANONICAL_COLUMNS if c not in _PRESENT)

SQL = {
    "clean_flows": f"""WITH {_GROUPED_SQL}
SELECT "Label", {grid_sql('q', 4)} AS q, {grid_sql('l_discount', 4)} AS l_discount,
       {grid_sql('l_tax', 4)} AS l_tax, "Source_File", "Dataset", row_ord, "Attack Type" FROM kept""",
    "class_balance": f"""WITH {_GROUPED_SQL}, c AS (
  SELECT "Attack Type", count(*) AS n FROM kept GROUP BY 1)
SELECT "Attack Type", n, {grid_sql('CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n)')} AS weight FROM c""",
    "label_distribution": f"""WITH {RAW_SQL}
SELECT "Label", count(*) AS n FROM raw WHERE trim("Label") <> 'Label' GROUP BY 1""",
    "group_distribution": f"""WITH {CLEAN_SQL}
SELECT {GROUPED} AS "Attack Type", count(*) AS n FROM clean GROUP BY 1""",
    "rows_per_file": f"""WITH {RAW_SQL}, c AS (
  SELECT "Source_File", count(*) AS n FROM raw WHERE trim("Label") <> 'Label' GROUP BY 1)
SELECT *, CAST(sum(n) OVER (ORDER BY "Source_File") AS BIGINT) AS cumulative FROM c""",
    "unmapped_labels": f"""WITH {RAW_SQL}
SELECT DISTINCT trim("Label") AS "Label" FROM raw
WHERE trim("Label") NOT IN ('BENIGN', 'DoS Hulk', 'Bot', 'Heartbleed')""",
    "drop_rare": f"""WITH {RAW_SQL}, g AS (
  SELECT {GROUPED} AS "Attack Type", "Source_File" FROM raw WHERE trim("Label") <> 'Label')
SELECT "Attack Type", "Source_File", count(*) AS n FROM g
WHERE "Attack Type" <> 'Heartbleed' AND "Attack Type" IN (
  SELECT "Attack Type" FROM g GROUP BY 1 HAVING count(*) >= {RARE_BELOW}) GROUP BY 1, 2""",
    "quality_report": f"""WITH {RAW_SQL}, v AS (
  SELECT TRY_CAST(q AS DOUBLE) AS q FROM raw WHERE trim("Label") <> 'Label'), a AS (
  SELECT count(*) AS n_rows, count(*) FILTER (isinf(q)) AS inf_cells,
         count(*) FILTER (q IS NULL OR NOT isfinite(q)) AS incomplete_rows FROM v)
SELECT *, {grid_sql('incomplete_rows * 100.0e0 / n_rows')} AS incomplete_pct FROM a""",
    "dedup_rows": f"""WITH {RAW_SQL}, t AS (
  SELECT "Label" AS lab, q AS q_text, l_discount, l_tax, "Source_File", "Dataset", min(row_ord) AS row_ord
  FROM raw WHERE trim("Label") <> 'Label' GROUP BY ALL)
SELECT trim(lab) AS "Label", TRY_CAST(q_text AS DOUBLE) AS q, l_discount, l_tax, "Source_File",
       "Dataset", row_ord FROM t""",
    "dedup_report": f"""WITH {CLEAN_SQL}, r AS (
  SELECT (SELECT count(*) FROM num WHERE q IS NOT NULL AND isfinite(q)) AS n_read,
         (SELECT count(*) FROM clean) AS n_kept)
SELECT *, n_read - n_kept AS n_removed, {grid_sql('(n_read - n_kept) * 100.0e0 / n_read')} AS removed_pct FROM r""",
    "canonicalize": f"""WITH {LINEITEM_SQL}
SELECT l_suppkey AS "Destination Port", l_partkey AS "Flow Duration", l_linenumber AS "Total Fwd Packets",
       l_quantity AS "Flow Bytes/s", l_returnflag AS "Label", "Source_File", "Dataset",
       {len(S.CANONICAL_COLUMNS) - len(_PRESENT)} AS absent, row_ord FROM li WHERE l_orderkey % 101 <> 0""",
    "schema_drift": f"""WITH {LINEITEM_SQL}, f AS (
  SELECT "Source_File" AS source_file, "Dataset" AS ds, count(*) AS n_rows FROM li GROUP BY 1, 2),
m("column") AS (VALUES {_MISSING})
SELECT source_file, "column", 'missing' AS status, n_rows FROM f, m
UNION ALL SELECT source_file, 'Surplus', 'extra', n_rows FROM f WHERE ds = '2018'""",
    "cap_per_file": f"""WITH {RAW_SQL}
SELECT "Source_File", row_ord FROM raw WHERE trim("Label") <> 'Label'
QUALIFY row_number() OVER (PARTITION BY "Source_File" ORDER BY row_ord) <= 1000""",
    "csv_ingest": f"""WITH {LINEITEM_SQL}
SELECT "Dataset", l_returnflag AS "Label", count(*) AS n, CAST(sum(l_suppkey) AS BIGINT) AS ports,
       CAST(sum(l_partkey) AS BIGINT) AS duration, CAST(sum(l_linenumber) AS BIGINT) AS packets,
       sum(l_quantity) AS rate FROM li WHERE l_orderkey % 101 <> 0 GROUP BY 1, 2""",
    "clean_job": f"""WITH {RAW_SQL}, v AS (
  SELECT {GROUPED} AS "Attack Type", "Dataset", 2 * row_ord AS port,
         coalesce(isfinite(TRY_CAST(q AS DOUBLE)), false) AS whole FROM raw WHERE trim("Label") <> 'Label'),
g AS (SELECT *, count(*) OVER (PARTITION BY "Attack Type") AS size FROM v WHERE whole),
k AS (SELECT * FROM g WHERE size >= {RARE_BELOW} AND "Attack Type" <> 'Heartbleed')
SELECT "Attack Type", "Dataset", count(*) AS n, CAST(sum(port) AS DOUBLE) AS ports, (SELECT count(*) FROM v) AS n_rows,
       (SELECT count(*) FROM v WHERE NOT whole) AS incomplete_rows, (SELECT count(*) FROM g) AS n_read,
       (SELECT count(*) FROM g) AS n_kept, (SELECT count(*) FROM k) AS n_clean FROM k GROUP BY 1, 2""",
    "duplicate_columns": """WITH v AS (
  SELECT l_quantity, l_discount, l_tax, l_extendedprice, l_tax AS dup, 1.0e0 AS "const",
         2 * l_quantity + 0.01e0 * l_discount AS lin FROM lineitem),
e AS (SELECT count(*) FILTER (l_tax IS DISTINCT FROM dup) AS dup, count(*) FILTER (l_quantity IS DISTINCT FROM l_discount
  AND l_quantity IS DISTINCT FROM l_tax AND l_discount IS DISTINCT FROM l_tax) AS other, count(*) AS n FROM v)
SELECT 'l_quantity' AS "column", false AS dropped, n AS n_rows FROM e
UNION ALL SELECT 'l_discount', false, n FROM e UNION ALL SELECT 'l_tax', false, n FROM e
UNION ALL SELECT 'l_extendedprice', false, n FROM e UNION ALL SELECT 'dup', dup = 0, n FROM e
UNION ALL SELECT 'const', false, n FROM e UNION ALL SELECT 'lin', false, n FROM e
UNION ALL SELECT 'zero', false, n FROM e""",
}
