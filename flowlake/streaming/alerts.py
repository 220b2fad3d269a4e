"""Packets in, alerts out: one streaming query per run."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlake import schema as S
from flowlake.operators import scoring
from flowlake.operators.flow_features import features_of
from flowlake.operators.flows import ACTIVE_GAP_S, ACTIVE_S, IDLE_S
from flowlake.operators.modeling import Classifier
from flowlake.streaming.flows import closed_flows, set_aside, stream_flows

log = logging.getLogger(__name__)


def start_flow_stream(packets: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                      idle_s: float = IDLE_S, active_s: float = ACTIVE_S,
                      active_gap_s: float = ACTIVE_GAP_S, watermark: str = "10 seconds",
                      available_now: bool = False, predicate: str | None = None,
                      quarantine: str | None = None) -> StreamingQuery:
    """Run ``sink(flow features, batch id)`` for every batch of closed flows.

    Packets that belong to no flow, with the reason, go to the folder ``quarantine`` where one is named.
    """
    def each(settled: DataFrame, batch: int) -> None:
        settled = settled.persist(StorageLevel.MEMORY_AND_DISK)  # the keyed state runs once for both outputs
        try:
            if quarantine:
                set_aside(settled).write.mode("overwrite").json(f"{quarantine}/batch={batch}")
            sink(features_of(closed_flows(settled)), batch)
        finally:
            settled.unpersist()

    writer = (stream_flows(packets, idle_s, active_s, active_gap_s, watermark, predicate)
              .writeStream.outputMode("append").option("checkpointLocation", checkpoint)
              .foreachBatch(each))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_to_end(start: Callable[[], StreamingQuery], attempts: int = 3) -> None:
    """Run an available-now query to its end.

    Where Spark could not start the Python process of the keyed state, the query is started
    again from its checkpoint; any other failure is raised.
    """
    for left in reversed(range(attempts)):
        try:
            start().awaitTermination()
            return
        except StreamingQueryException as e:
            if not left or "STREAMING_PYTHON_RUNNER_INITIALIZATION_FAILURE" not in str(e):
                raise
            log.warning("the state process did not start, trying again: %s", e)


def feature_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Summary and features without scoring; a repeated batch replaces its own folder."""
    def write(flows: DataFrame, batch: int) -> None:
        flows.write.mode("overwrite").json(f"{path}/batch={batch}")
    return write


def alert_sink(clf: Classifier, path: str, only_non_benign: bool = False,
               min_confidence: float = 0.0) -> Callable[[DataFrame, int], None]:
    """Score, filter and write JSON lines."""
    def write(flows: DataFrame, batch: int) -> None:
        kept = scoring.alerts(clf.score(flows, digits=6), only_non_benign, min_confidence)
        scoring.to_alert_json(kept).write.mode("overwrite").text(f"{path}/batch={batch}")
    return write


def run_alert_stream(packets: DataFrame, clf: Classifier, path: str, checkpoint: str,
                     only_non_benign: bool = False, min_confidence: float = 0.0, **options) -> StreamingQuery:
    return start_flow_stream(packets, alert_sink(clf, path, only_non_benign, min_confidence), checkpoint, **options)


def closing_packet(spark: SparkSession, packets: DataFrame, idle_s: float) -> DataFrame:
    """One packet far behind all others in time.

    Open flows leave the state only when a later packet moves the watermark; a finished
    recording gets this packet as its last file.
    """
    end = packets.agg(F.max("us")).first()[0] or 0
    us = end + int(idle_s * 1e6) + 366 * 86_400 * 1_000_000
    filler = {"pkt_ord": -1, "us": us, "ip_version": 4, "src_ip": "0.0.0.0", "dst_ip": "0.0.0.0",
              "src_port": 0, "dst_port": 0, "proto": 17, "ip_len": 28, "ip_ihl": 5, "udp_len": 8}
    row = [tuple(filler.get(f.name) for f in S.PACKETS.fields)]
    return (spark.createDataFrame(row, S.PACKETS)
            .withColumn("ts", F.timestamp_micros("us")).select(*S.PACKETS.names))
