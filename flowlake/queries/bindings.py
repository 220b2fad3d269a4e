"""The given tables bound to the layouts the operators work on, in Spark and in SQL.

``lineitem`` stands for labelled flows with dirty text, ``events`` for decoded packets.
Positions are those of the rows in the Parquet file.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.schema import PACKETS, ROW_ORD

# Fixed values of the packet binding: timeouts in seconds that suit the event rate.
IDLE_S, ACTIVE_S, GAP_S = 21_600, 28_800, 7_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def grid(x: Column, digits: int = 6) -> Column:
    """``x`` on a decimal grid.  The odd offset keeps natural halves off the rounding edge,
    so both engines land on the same grid point."""
    return F.floor(x.cast("double") * float(10 ** digits) + F.lit(0.4142)) / float(10 ** digits)


def grid_sql(x: str, digits: int = 6) -> str:
    return f"floor(CAST({x} AS DOUBLE) * 1e{digits} + 0.4142e0) / 1e{digits}"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` plus the position of the row, its file and data set."""
    return (table(spark, sf_dir, "lineitem")
            .select("*", F.col("_metadata.row_index").alias(ROW_ORD))
            .withColumn("Source_File", F.expr("concat('f', year(l_shipdate))"))
            .withColumn("Dataset", F.expr("if(year(l_shipdate) <= 1998, '2017', '2018')")))


LINEITEM_SQL = """li AS (
  SELECT *, 'f' || CAST(year(l_shipdate) AS VARCHAR) AS "Source_File",
         CASE WHEN year(l_shipdate) <= 1998 THEN '2017' ELSE '2018' END AS "Dataset"
  FROM (SELECT *, row_number() OVER () - 1 AS row_ord FROM lineitem))"""

_LABEL = """CASE WHEN l_orderkey % 101 = 0 THEN 'Label' ELSE concat(' ',
  CASE WHEN l_returnflag = 'A' THEN 'BENIGN' WHEN l_returnflag = 'N' THEN 'DoS Hulk'
       WHEN l_partkey % 50 = 0 THEN 'Heartbleed' WHEN l_partkey % 7 = 0 THEN 'Zeta'
       ELSE 'Bot' END, ' ') END"""
_Q = """CASE WHEN l_orderkey % 97 = 0 THEN 'Infinity' WHEN l_orderkey % 89 = 0 THEN 'NaN'
  WHEN l_orderkey % 83 = 0 THEN 'x' ELSE CAST(l_quantity AS {text}) END"""


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty labelled flows: embedded headers, padded labels, unreadable numbers."""
    return lineitem(spark, sf_dir).select(
        F.expr(_LABEL).alias("Label"), F.expr(_Q.format(text="STRING")).alias("q"),
        "l_discount", "l_tax", "Source_File", "Dataset", ROW_ORD)


RAW_SQL = f"""{LINEITEM_SQL}, raw AS (
  SELECT {_LABEL} AS "Label", {_Q.format(text="VARCHAR")} AS q, l_discount, l_tax,
         "Source_File", "Dataset", row_ord FROM li)"""

# Label column trimmed and grouped, as the cleaned rows carry it.
GROUPED = """CASE trim("Label") WHEN 'BENIGN' THEN 'Normal Traffic' WHEN 'DoS Hulk' THEN 'DoS'
  WHEN 'Bot' THEN 'Bot' WHEN 'Heartbleed' THEN 'Heartbleed' ELSE 'Unknown' END"""

#: Cleaned rows: headers out, numbers read, incomplete rows out, copies collapsed.
CLEAN_SQL = RAW_SQL + """, num AS (
  SELECT "Label", CAST(TRY_CAST(q AS DOUBLE) AS FLOAT) AS q, CAST(l_discount AS FLOAT) AS l_discount,
         CAST(l_tax AS FLOAT) AS l_tax, "Source_File", "Dataset", row_ord
  FROM raw WHERE trim("Label") <> 'Label'),
clean AS (
  SELECT "Label", q, l_discount, l_tax, "Source_File", "Dataset", min(row_ord) AS row_ord
  FROM num WHERE q IS NOT NULL AND isfinite(q) GROUP BY ALL)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets between twelve hosts."""
    e = table(spark, sf_dir, "events").withColumn(
        "d", F.get_json_object("props", "$.k").cast("int") % 12)
    e = e.withColumn("s", (F.col("user_id") % 12).cast("int"))
    tcp = F.col("user_id") % 3 != 0
    size = F.floor("value").cast("int")
    flags = F.expr("""CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN 4 WHEN 'click' THEN 8
                      WHEN 'purchase' THEN 16 WHEN 'view' THEN 1 ELSE 0 END""")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("pkt_ord"), ts.alias("ts"), F.unix_micros(ts).alias("us"),
        F.lit(4).alias("ip_version"),
        F.format_string("h%02d", "s").alias("src_ip"), F.format_string("h%02d", "d").alias("dst_ip"),
        (1000 + F.col("s")).alias("src_port"), (1000 + F.col("d")).alias("dst_port"),
        F.when(tcp, 6).otherwise(17).alias("proto"),
        F.when(tcp, 40 + size).otherwise(28 + size).alias("ip_len"), F.lit(5).alias("ip_ihl"),
        F.when(tcp, 5).alias("tcp_dataofs"),
        F.when(tcp, (1000 + F.col("event_id") % 1000).cast("int")).alias("tcp_window"),
        F.when(tcp, flags).otherwise(0).alias("tcp_flags"),
        F.when(~tcp, 8 + size).alias("udp_len")).select(
            *[F.col(f.name).cast(f.dataType) for f in PACKETS.fields])


#: Packets with canonical endpoints (a, b), sender side, payload and header bytes.
PACKETS_SQL = """ev AS (
  SELECT event_id, epoch_us(ts) AS us, value, event_type, CAST(user_id % 12 AS INTEGER) AS s,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 12 AS d, user_id % 3 <> 0 AS tcp
  FROM events),
pk AS (
  SELECT event_id AS pkt_ord, us, 'h' || lpad(CAST(s AS VARCHAR), 2, '0') AS src_ip,
         'h' || lpad(CAST(d AS VARCHAR), 2, '0') AS dst_ip, 1000 + s AS src_port, 1000 + d AS dst_port,
         CASE WHEN tcp THEN 6 ELSE 17 END AS proto,
         CAST(floor(value) AS BIGINT) AS len, CASE WHEN tcp THEN 40 ELSE 20 END AS header,
         CASE WHEN tcp THEN 20 ELSE 0 END AS tcp_header,
         CASE WHEN tcp THEN 1000 + event_id % 1000 END AS tcp_window,
         CASE WHEN NOT tcp THEN 0 ELSE CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN 4
              WHEN 'click' THEN 8 WHEN 'purchase' THEN 16 WHEN 'view' THEN 1 ELSE 0 END END AS flags,
         s <= d AS from_a, least(s, d) AS a, greatest(s, d) AS b
  FROM ev)"""
