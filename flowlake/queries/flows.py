"""Flow assembly and the forty features over events bound as packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake import schema as S
from flowlake.functions.scalars import name
from flowlake.operators import flow_features as FF
from flowlake.operators import flows as FL
from flowlake.queries.bindings import (
    ACTIVE_S, GAP_S, IDLE_S, PACKETS_SQL, grid, grid_sql, packets)

# Features in microseconds are compared in seconds.
IN_SECONDS = [f for f in S.FLOW_FEATURES if " IAT " in f or f.startswith("Active ")
              or f == "Flow Duration"]


def prepared(spark: SparkSession, d: str) -> DataFrame:
    return FL.prepare_packets(packets(spark, d))


def assigned(spark: SparkSession, d: str) -> DataFrame:
    return FL.assign_flows(prepared(spark, d), IDLE_S, ACTIVE_S, active_gap_s=GAP_S)


def features(spark: SparkSession, d: str) -> DataFrame:
    return FF.flow_features(assigned(spark, d))


def on_grid(flows: DataFrame) -> DataFrame:
    return flows.select("flow_id", *[
        grid(name(f) / 1e6 if f in IN_SECONDS else name(f), 3).alias(f) for f in S.FLOW_FEATURES])


def flow_keys(spark: SparkSession, d: str) -> DataFrame:
    return prepared(spark, d).groupBy(*FL.PAIR).agg(
        F.count("*").alias("packets"), F.count_if("from_a").alias("from_a"),
        F.sum("len").alias("bytes"), F.sum("header").alias("header"),
        F.count_if("rst").alias("resets"))


def packet_filter(spark: SparkSession, d: str) -> DataFrame:
    """A user-supplied predicate on the packet columns."""
    p = FL.prepare_packets(packets(spark, d), "proto = 6 and (src_port = 1003 or dst_port = 1003)")
    return p.groupBy("a_ip", "b_ip").agg(F.count("*").alias("packets"), F.sum("len").alias("bytes"))


def flow_segments(spark: SparkSession, d: str) -> DataFrame:
    """Idle gaps and resets alone."""
    return (FL.assign_flows(prepared(spark, d), IDLE_S, None)
            .groupBy("flow_id").agg(F.count("*").alias("packets"), F.count_if("fwd").alias("fwd"),
                                    F.sum("iat").alias("span")))


def flow_assembly(spark: SparkSession, d: str) -> DataFrame:
    return assigned(spark, d).select("pkt_ord", "flow_id", "fwd", "iat", "iat_same")


def flow_summary(spark: SparkSession, d: str) -> DataFrame:
    s = FL.flow_summary(assigned(spark, d))
    return s.select("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
                    grid(F.col("duration_s")).alias("duration_s"), "packets",
                    F.unix_micros("end_time").alias("end_us"))


def first_flows(spark: SparkSession, d: str) -> DataFrame:
    return FL.first_flows(FL.flow_summary(assigned(spark, d)), 100).select(
        "flow_id", "packets", F.unix_micros("end_time").alias("end_us"))


def flow_features(spark: SparkSession, d: str) -> DataFrame:
    return on_grid(features(spark, d))


def feature_contract(spark: SparkSession, d: str) -> DataFrame:
    return FF.check_contract(features(spark, d))


QUERIES = {
    "flow_keys": flow_keys, "packet_filter": packet_filter, "flow_segments": flow_segments,
    "flow_assembly": flow_assembly, "flow_summary": flow_summary, "first_flows": first_flows, "flow_features": flow_features,
    "feature_contract": feature_contract,
}

_I, _A, _G = IDLE_S * 1_000_000, ACTIVE_S * 1_000_000, GAP_S * 1_000_000

_ASSIGNED_SQL = f"""{PACKETS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY a, b, proto ORDER BY us, pkt_ord) AS rn FROM pk),
w AS (
  SELECT a, b, proto, rn, pkt_ord, us, us AS start_us, pkt_ord AS flow_id, from_a AS start_a,
         (flags & 4) <> 0 AS closes FROM o WHERE rn = 1
  UNION ALL
  SELECT o.a, o.b, o.proto, o.rn, o.pkt_ord, o.us,
         CASE WHEN w.closes OR o.us - w.us >= {_I} THEN o.us ELSE w.start_us END,
         CASE WHEN w.closes OR o.us - w.us >= {_I} THEN o.pkt_ord ELSE w.flow_id END,
         CASE WHEN w.closes OR o.us - w.us >= {_I} THEN o.from_a ELSE w.start_a END,
         (o.flags & 4) <> 0 OR o.us - CASE WHEN w.closes OR o.us - w.us >= {_I} THEN o.us ELSE w.start_us END >= {_A}
  FROM w JOIN o ON o.a = w.a AND o.b = w.b AND o.proto = w.proto AND o.rn = w.rn + 1),
f AS (
  SELECT o.*, w.flow_id, w.start_a, o.from_a = w.start_a AS fwd,
         o.us - lag(o.us) OVER (PARTITION BY w.flow_id ORDER BY o.us, o.pkt_ord) AS iat,
         o.us - lag(o.us) OVER (PARTITION BY w.flow_id, o.from_a ORDER BY o.us, o.pkt_ord) AS iat_same
  FROM o JOIN w USING (pkt_ord))"""


def _stat(agg: str, x: str, side: str | None = None) -> str:
    where = f" FILTER ({side})" if side else ""
    return f"coalesce({agg}({x}){where}, 0)"


_DUR = "(max(us) - min(us))"


def _rate(x: str) -> str:
    return f"CASE WHEN count(*) >= 2 AND {_DUR} > 0 THEN {x} / ({_DUR} / 1e6) ELSE 0 END"


_FEATURE_SQL = {
    "Destination Port": "any_value(1000 + CASE WHEN start_a THEN b ELSE a END)",
    "Flow Duration": _DUR,
    "Total Fwd Packets": "count(*) FILTER (fwd)",
    "Total Length of Fwd Packets": _stat("sum", "len", "fwd"),
    "Fwd Packet Length Max": _stat("max", "len", "fwd"),
    "Fwd Packet Length Min": _stat("min", "len", "fwd"),
    "Fwd Packet Length Mean": _stat("avg", "len", "fwd"),
    "Bwd Packet Length Max": _stat("max", "len", "NOT fwd"),
    "Bwd Packet Length Min": _stat("min", "len", "NOT fwd"),
    "Flow Bytes/s": _rate("sum(len)"),
    "Flow Packets/s": _rate("count(*)"),
    "Flow IAT Mean": _stat("avg", "iat"),
    "Flow IAT Std": _stat("stddev_pop", "iat"),
    "Flow IAT Max": _stat("max", "iat"),
    "Flow IAT Min": _stat("min", "iat"),
    "Fwd IAT Mean": _stat("avg", "iat_same", "fwd"),
    "Fwd IAT Std": _stat("stddev_pop", "iat_same", "fwd"),
    "Fwd IAT Min": _stat("min", "iat_same", "fwd"),
    "Bwd IAT Total": "coalesce(max(us) FILTER (NOT fwd) - min(us) FILTER (NOT fwd), 0)",
    "Bwd IAT Mean": _stat("avg", "iat_same", "NOT fwd"),
    "Bwd IAT Std": _stat("stddev_pop", "iat_same", "NOT fwd"),
    "Bwd IAT Max": _stat("max", "iat_same", "NOT fwd"),
    "Bwd IAT Min": _stat("min", "iat_same", "NOT fwd"),
    "Fwd Header Length": _stat("sum", "header", "fwd"),
    "Bwd Header Length": _stat("sum", "header", "NOT fwd"),
    "Bwd Packets/s": _rate("count(*) FILTER (NOT fwd)"),
    "Min Packet Length": "min(len)",
    "Max Packet Length": "max(len)",
    "Packet Length Mean": "avg(len)",
    "Packet Length Variance": "var_pop(len)",
    "FIN Flag Count": "count(*) FILTER ((flags & 1) <> 0)",
    "PSH Flag Count": "count(*) FILTER ((flags & 8) <> 0)",
    "ACK Flag Count": "count(*) FILTER ((flags & 16) <> 0)",
    "Init_Win_bytes_forward":
        "coalesce(first(tcp_window ORDER BY us, pkt_ord) FILTER (fwd AND (flags & 2) <> 0), -1)",
    "Init_Win_bytes_backward":
        "coalesce(first(tcp_window ORDER BY us, pkt_ord) FILTER (NOT fwd AND (flags & 2) <> 0), -1)",
    "act_data_pkt_fwd": "count(*) FILTER (fwd AND proto = 6 AND len > 0)",
    "min_seg_size_forward": _stat("min", "tcp_header", "fwd AND tcp_header > 0"),
}
_ACTIVE_SQL = f"""isl AS (
  SELECT flow_id, us, sum(CASE WHEN iat > {_G} THEN 1 ELSE 0 END)
         OVER (PARTITION BY flow_id ORDER BY us, pkt_ord) AS island FROM f),
act AS (SELECT flow_id, avg(span) AS am, max(span) AS ax, min(span) AS an FROM (
  SELECT flow_id, island, max(us) - min(us) AS span FROM isl GROUP BY 1, 2) GROUP BY 1)"""


def _on_grid_sql() -> str:
    cols = ", ".join(f'{x} AS "{f}"' for f, x in _FEATURE_SQL.items())
    grids = ", ".join(
        "{} AS \"{}\"".format(grid_sql(f'"{f}" / 1e6' if f in IN_SECONDS else f'"{f}"', 3), f)
        for f in _FEATURE_SQL)
    active = ", ".join(f'{grid_sql(f"{c} / 1e6", 3)} AS "Active {n}"'
                       for c, n in (("am", "Mean"), ("ax", "Max"), ("an", "Min")))
    return f"""WITH RECURSIVE {_ASSIGNED_SQL}, {_ACTIVE_SQL},
g AS (SELECT flow_id, {cols} FROM f GROUP BY flow_id)
SELECT flow_id, {grids}, {active} FROM g JOIN act USING (flow_id)"""


FEATURES_ON_GRID_SQL = _on_grid_sql()

SQL = {
    "flow_keys": f"""WITH {PACKETS_SQL}
SELECT 'h' || lpad(CAST(a AS VARCHAR), 2, '0') AS a_ip, 1000 + a AS a_port,
       'h' || lpad(CAST(b AS VARCHAR), 2, '0') AS b_ip, 1000 + b AS b_port, proto,
       count(*) AS packets, count(*) FILTER (from_a) AS from_a, CAST(sum(len) AS BIGINT) AS bytes,
       CAST(sum(header) AS BIGINT) AS header, count(*) FILTER ((flags & 4) <> 0) AS resets
FROM pk GROUP BY a, b, proto""",
    "packet_filter": f"""WITH {PACKETS_SQL}
SELECT 'h' || lpad(CAST(a AS VARCHAR), 2, '0') AS a_ip, 'h' || lpad(CAST(b AS VARCHAR), 2, '0') AS b_ip,
       count(*) AS packets, CAST(sum(len) AS BIGINT) AS bytes
FROM pk WHERE proto = 6 AND (src_port = 1003 OR dst_port = 1003) GROUP BY a, b""",
    "flow_segments": f"""WITH {PACKETS_SQL},
l AS (SELECT *, us - lag(us) OVER k AS gap, lag((flags & 4) <> 0) OVER k AS reset FROM pk
      WINDOW k AS (PARTITION BY a, b, proto ORDER BY us, pkt_ord)),
c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {_I} OR reset THEN 1 ELSE 0 END)
      OVER (PARTITION BY a, b, proto ORDER BY us, pkt_ord) AS seg FROM l),
x AS (SELECT *, first(pkt_ord) OVER s AS flow_id, first(from_a) OVER s AS start_a FROM c
      WINDOW s AS (PARTITION BY a, b, proto, seg ORDER BY us, pkt_ord))
SELECT flow_id, count(*) AS packets, count(*) FILTER (from_a = start_a) AS fwd,
       CASE WHEN count(*) > 1 THEN max(us) - min(us) END AS span FROM x GROUP BY flow_id""",
    "flow_assembly": f"""WITH RECURSIVE {_ASSIGNED_SQL}
SELECT pkt_ord, flow_id, fwd, iat, iat_same FROM f""",
    "flow_summary": f"""WITH RECURSIVE {_ASSIGNED_SQL}, g AS (
  SELECT flow_id, any_value(CASE WHEN start_a THEN a ELSE b END) AS s,
         any_value(CASE WHEN start_a THEN b ELSE a END) AS d, any_value(proto) AS proto,
         max(us) - min(us) AS dur, count(*) AS packets, max(us) AS end_us FROM f GROUP BY 1)
SELECT flow_id, 'h' || lpad(CAST(s AS VARCHAR), 2, '0') AS src_ip,
       'h' || lpad(CAST(d AS VARCHAR), 2, '0') AS dst_ip, 1000 + s AS src_port, 1000 + d AS dst_port,
       CASE proto WHEN 6 THEN 'TCP' ELSE 'UDP' END AS protocol, {grid_sql('dur / 1e6')} AS duration_s,
       packets, end_us FROM g""",
    "first_flows": f"""WITH RECURSIVE {_ASSIGNED_SQL}
SELECT flow_id, count(*) AS packets, max(us) AS end_us FROM f GROUP BY 1 ORDER BY end_us, flow_id LIMIT 100""",
    "flow_features": FEATURES_ON_GRID_SQL,
    "feature_contract": f"""WITH RECURSIVE {_ASSIGNED_SQL}, n AS (SELECT count(DISTINCT flow_id) AS n_flows FROM f)
SELECT feature, 'present' AS status, true AS in_order, CAST(0 AS BIGINT) AS non_finite, n_flows
FROM n, (VALUES {", ".join(f"('{f}')" for f in S.FLOW_FEATURES)}) AS v(feature)""",
}
