"""The streaming jobs, replayed over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake import schema as S
from flowlake.functions.scalars import name
from flowlake.operators import modeling as MD
from flowlake.operators import scoring
from flowlake.queries.bindings import ACTIVE_S, GAP_S, IDLE_S, packets
from flowlake.queries.flows import FEATURES_ON_GRID_SQL, features, on_grid
from flowlake.session import new_folder
from flowlake.sources.packets import stream_packets
from flowlake.streaming import alerts as A

_OPTIONS = {"idle_s": IDLE_S, "active_s": ACTIVE_S, "active_gap_s": GAP_S,
            "watermark": "1 hour", "available_now": True}


def replay(spark: SparkSession, d: str, sink) -> None:
    """Feed the packets through the stream, then the closing packet, to the end."""
    source, checkpoint = new_folder(spark, "packets"), new_folder(spark, "stream")
    recorded = packets(spark, d)
    for part in (recorded, A.closing_packet(spark, recorded, IDLE_S)):
        part.write.mode("append").parquet(source)
        A.run_to_end(lambda: A.start_flow_stream(stream_packets(spark, source), sink, checkpoint,
                                                 **_OPTIONS))


def stream_flows(spark: SparkSession, d: str) -> DataFrame:
    out = new_folder(spark, "flows")
    replay(spark, d, A.feature_sink(out))
    kinds = ", ".join(f"`{f}` double" for f in S.FLOW_FEATURES)
    return on_grid(spark.read.schema(f"flow_id long, {kinds}").json(out))


def flow_model(spark: SparkSession, d: str) -> MD.Classifier:
    """A small forest that tells long, busy flows from the rest."""
    flows = features(spark, d).withColumn("Attack Type", F.when(
        name("Flow Duration") > 3600e6, "DoS").otherwise(S.BENIGN_GROUP))
    return MD.fit_classifier(flows, S.FLOW_FEATURES, "Attack Type", "forest",
                             {"max_depth": 4, "n_estimators": 5}, weighted=False)


def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    return alerts_of(spark, d, flow_model(spark, d))


def alerts_of(spark: SparkSession, d: str, clf: MD.Classifier) -> DataFrame:
    out = new_folder(spark, "alerts")
    replay(spark, d, A.alert_sink(clf, out, only_non_benign=True, min_confidence=0.5))
    return spark.read.text(out).select(
        *[F.get_json_object("value", f"$.{k}").alias(k) for k in
          ("ts", "src_ip", "dst_ip", "proto", "prediction")],
        F.get_json_object("value", "$.packets").cast("long").alias("packets"),
        F.get_json_object("value", "$.confidence").cast("double").alias("confidence"))


def stream_alerts_check(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of the stream that the batch job does not give, those it misses, and whether there are any.

    Both score with one model: a forest draws its rows by their order, so a second fit may be another one.
    """
    key = ["src_ip", "dst_ip", "proto", "ts", "packets", "prediction"]
    flows, clf = features(spark, d), flow_model(spark, d)
    batch = scoring.to_alert_json(scoring.alerts(clf.score(flows, digits=6), True, 0.5))
    batch = batch.select(*[F.get_json_object("value", f"$.{k}").alias(k) for k in key])
    stream = alerts_of(spark, d, clf).select(*[F.col(k).cast("string").alias(k) for k in key])
    sides = stream.withColumn("n", F.lit(1)).unionByName(batch.withColumn("n", F.lit(-1))).groupBy(*key).agg(
        F.sum("n").alias("n"), F.count("*").alias("seen"))
    return sides.agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("only_stream"),
                     F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).alias("only_batch"),
                     (F.sum("seen") > 0).alias("any_alert"))


def stream_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth packet comes after all others, some of them without an address: those that no flow can take."""
    source, checkpoint = new_folder(spark, "packets"), new_folder(spark, "stream")
    out, aside = new_folder(spark, "flows"), new_folder(spark, "aside")
    recorded = packets(spark, d)
    behind = recorded.where("pkt_ord % 50 = 0").withColumn("src_ip", F.expr("if(pkt_ord % 350 = 0, null, src_ip)"))
    for part in (recorded.where("pkt_ord % 50 <> 0"), behind, A.closing_packet(spark, recorded, IDLE_S)):
        part.write.mode("append").parquet(source)
        A.run_to_end(lambda: A.start_flow_stream(stream_packets(spark, source), A.feature_sink(out), checkpoint, quarantine=aside, **_OPTIONS))
    return spark.read.schema("reason string, pkt_ord long, us long").json(aside).select("reason", "pkt_ord", "us")


QUERIES = {"stream_flows": stream_flows, "stream_alerts": stream_alerts, "stream_alerts_check": stream_alerts_check,
           "stream_quarantine": stream_quarantine}

SQL = {
    "stream_flows": FEATURES_ON_GRID_SQL,
    "stream_alerts_check": "SELECT 0::BIGINT AS only_stream, 0::BIGINT AS only_batch, true AS any_alert",
    # The watermark is one hour behind the latest packet of the first arrival, in whole milliseconds.
    "stream_quarantine": """WITH m AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 AS mark FROM events WHERE event_id % 50 <> 0)
SELECT CASE WHEN event_id % 350 = 0 THEN 'no address' ELSE 'late' END AS reason, event_id AS pkt_ord, epoch_us(ts) AS us
FROM events, m WHERE event_id % 50 = 0 AND (event_id % 350 = 0 OR epoch_us(ts) <= mark)""",
}
