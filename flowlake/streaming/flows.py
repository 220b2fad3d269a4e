"""Flow assembly on a stream of packets.

A packet waits in the state of its pair until the watermark has passed it.  Then it is added to
the running sums of the pair's open flow, by the rules of the batch job, and forgotten.  The
state of a pair is the sums of one flow, of fixed size, and the packets still ahead of the
watermark.  A closed flow leaves as one row of statistics; packets that cannot be added leave
as rows of their own, with the reason.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlake.operators.flows import ACTIVE_GAP_S, ACTIVE_S, IDLE_S, PAIR, prepare_packets
from flowlake.streaming import sums

_KEY = T.StructType([T.StructField("a_ip", T.StringType()), T.StructField("a_port", T.IntegerType()), T.StructField("b_ip", T.StringType()),
                     T.StructField("b_port", T.IntegerType()), T.StructField("proto", T.IntegerType())])
_FLAGS = ("from_a", "fin", "syn", "rst", "psh", "ack")
_BODY = [*_FLAGS, "pkt_ord", "us", "len", "header", "tcp_header", "tcp_window"]

_WHOLE = ["flow_id", "start_us", "n", "lo", "hi", "bytes", "len_min", "len_max", "fin", "psh", "ack", "fwd_win", "bwd_win", "fwd_data", "min_seg",
          "bwd_lo", "bwd_hi", "periods", "active_sum", "active_min", "active_max",
          *[f"{s}_{x}" for s in sums.SIDES for x in ("n", "bytes", "max", "min", "header")],
          *[f"{k}_{x}" for k in ("iat", "fwd_iat", "bwd_iat") for x in ("min", "max")]]
_FRACTIONS = ["len_mean", "len_var", "fwd_mean", "bwd_mean", *[f"{k}_{x}" for k in ("iat", "fwd_iat", "bwd_iat") for x in ("mean", "std")]]
#: A closed flow's statistics, or a packet set aside: ``reason``, ``pkt_ord`` and ``us`` are those of the packet.
SETTLED = T.StructType(
    _KEY.fields + [T.StructField("start_from_a", T.BooleanType())] + [T.StructField(c, T.LongType()) for c in _WHOLE]
    + [T.StructField(c, T.DoubleType()) for c in _FRACTIONS]
    + [T.StructField("reason", T.StringType()), T.StructField("pkt_ord", T.LongType()), T.StructField("us", T.LongType())])

#: State keeps packets as Arrow messages of at most this many rows.
CHUNK_ROWS = 10_000
_CHUNK = T.StructType([T.StructField("chunk", T.BinaryType())])
_OPEN = T.StructType([T.StructField("sums", T.StringType()), T.StructField("first_ahead", T.LongType())])
_ARROW = pa.schema([(c, pa.bool_() if c in _FLAGS else pa.int64()) for c in _BODY])

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def add_settled(opened: dict | None, p: dict[str, np.ndarray], watermark_us: int, proto: int, idle_us: int, active_us: int,
                gap_us: int) -> tuple[list[dict], dict | None]:
    """Sums of the flows that are closed, and of the one left open, after adding packets in time order.

    All of ``p`` lies behind the watermark.  A flow is closed by a reset, by lasting long enough,
    by a gap to the next packet, or by a watermark that leaves no room for a packet within the
    idle timeout.  The work is in whole runs of packets, one for each flow.
    """
    us, rst, closed = p["us"], p["rst"], []
    n = len(us)
    if opened is not None and (watermark_us if not n else us[0]) - opened["hi"] >= idle_us:
        closed.append(opened)
        opened = None
    hard = np.flatnonzero((np.diff(us) >= idle_us) | rst[:-1]) + 1 if n else []
    edges = [0, *[int(x) for x in hard], n] if n else []
    for lo, hi in zip(edges, edges[1:]):
        while lo < hi:
            start = (int(us[lo]), int(p["pkt_ord"][lo]), bool(p["from_a"][lo]))
            if opened is not None:
                start = (opened["start_us"], opened["flow_id"], opened["start_from_a"])
            last = int(np.searchsorted(us[lo:hi], start[0] + active_us)) + lo
            stop = min(last + 1, hi)
            run = sums.of_run(p, lo, stop, start, proto, gap_us)
            opened = run if opened is None else sums.merge(opened, run, gap_us)
            if last < hi or hi < n or rst[hi - 1] or watermark_us - us[hi - 1] >= idle_us:
                closed.append(opened)
                opened = None
            lo = stop
    return closed, opened


def _pack(rows: dict[str, np.ndarray]) -> list[tuple[bytes]]:
    """Packets as Arrow messages of bounded size, the unit of the state."""
    out = []
    for lo in range(0, len(rows["us"]), CHUNK_ROWS):
        batch = pa.RecordBatch.from_arrays([pa.array(rows[c][lo:lo + CHUNK_ROWS], _ARROW.field(c).type) for c in _BODY], schema=_ARROW)
        buffer = io.BytesIO()
        with pa.ipc.new_stream(buffer, _ARROW) as w:
            w.write_batch(batch)
        out.append((buffer.getvalue(),))
    return out


def _unpack(chunks: list[tuple[bytes]]) -> dict[str, np.ndarray]:
    table = pa.concat_tables([pa.ipc.open_stream(c).read_all() for (c,) in chunks])
    return {c: table[c].to_numpy() for c in _BODY}


class FlowCutter(StatefulProcessor):
    """Keyed state of one pair: the sums of its open flow and the packets ahead of the watermark."""

    def __init__(self, idle_us: int, active_us: int, gap_us: int):
        self.idle_us, self.active_us, self.gap_us = idle_us, active_us, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.ahead = handle.getListState("ahead", _CHUNK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows))
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        # Everything up to the watermark has been added, so what arrives there comes too late.
        reason = np.full(len(fresh), None, object)
        reason[(fresh["us"] <= mark).to_numpy(bool, na_value=False) & (mark > 0)] = "late"
        reason[fresh["us"].isna().to_numpy()] = "no time"
        if any(part is None or part != part for part in key):
            reason[:] = "no address"
        aside = fresh[[r is not None for r in reason]]
        if len(aside):
            out = pd.DataFrame(None, index=range(len(aside)), columns=SETTLED.names, dtype=object)
            out["reason"] = [r for r in reason if r is not None]
            out["pkt_ord"], out["us"] = ([None if v != v else int(v) for v in aside[c]] for c in ("pkt_ord", "us"))
            yield self._named(out, key)
        kept = fresh[[r is None for r in reason]]
        if len(kept):
            yield from self._settle(key, {c: kept[c].fillna(-1).to_numpy().astype(bool if c in _FLAGS else np.int64) for c in _BODY}, mark)
        elif self.open.exists():
            yield from self._settle(key, None, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, None, timerValues.getCurrentWatermarkInMs() * 1000)

    def _named(self, out: pd.DataFrame, key) -> pd.DataFrame:
        for column, value in zip(PAIR, key):
            out[column] = [None if value is None or value != value else value] * len(out)
        return out[SETTLED.names]

    def _settle(self, key, fresh: dict | None, mark: int) -> Iterator[pd.DataFrame]:
        held, first = self.open.get() if self.open.exists() else (None, None)
        opened = json.loads(held) if held else None
        done = {c: np.empty(0, bool if c in _FLAGS else np.int64) for c in _BODY}
        if first is not None and first <= mark:
            waiting = _unpack(list(self.ahead.get()))
            over = waiting["us"] <= mark
            order = np.lexsort((waiting["pkt_ord"][over], waiting["us"][over]))
            done = {c: v[over][order] for c, v in waiting.items()}
            rest = {c: v[~over] for c, v in waiting.items()}
            first = int(rest["us"].min()) if len(rest["us"]) else None
            self.ahead.clear()
            if first is not None:
                self.ahead.put(_pack(rest))
        if fresh is not None:
            first = min(int(fresh["us"].min()), first) if first is not None else int(fresh["us"].min())
            self.ahead.appendList(_pack(fresh))
        closed, opened = add_settled(opened, done, mark, int(key[4] or 0), self.idle_us, self.active_us, self.gap_us)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if opened is None and first is None:
            self.open.clear()
        else:
            self.open.update((json.dumps(opened) if opened else None, first))
            due = [t for t in (first, opened["hi"] + self.idle_us if opened else None) if t is not None]
            self.handle.registerTimer(-(-min(due) // 1000))
        if closed:
            yield self._named(pd.DataFrame([sums.statistics(s) for s in closed], dtype=object).reindex(columns=SETTLED.names)
                              .astype(object).where(lambda x: x.notna(), None), key)

    def close(self) -> None:
        pass


def stream_flows(packets: DataFrame, idle_s: float = IDLE_S, active_s: float = ACTIVE_S, active_gap_s: float = ACTIVE_GAP_S,
                 watermark: str = "10 seconds", predicate: str | None = None) -> DataFrame:
    """Streaming packets to statistics of closed flows and packets set aside, in the layout ``SETTLED``.

    A packet at or before the watermark of the batch it arrives in, without a time, or without
    an address is set aside with its reason.  The event-time column ends before the keyed state,
    so that Spark does not drop late packets on the way there.
    """
    spark = packets.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    timed = prepare_packets(packets, predicate).withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", watermark)
    return (timed.select(*PAIR, *_BODY).groupBy(*PAIR)
            .transformWithStateInPandas(
                FlowCutter(int(idle_s * 1e6), int(active_s * 1e6), int(active_gap_s * 1e6)), outputStructType=SETTLED,
                outputMode="Append", timeMode="EventTime"))


def closed_flows(settled: DataFrame) -> DataFrame:
    """The closed flows as the batch aggregate gives them."""
    start = F.struct(F.col("start_us").alias("us"), F.col("flow_id").alias("ord"), F.col("start_from_a").alias("from_a"))
    return settled.where("reason is null").select("*", start.alias("start"))


def set_aside(settled: DataFrame) -> DataFrame:
    """The packets that belong to no flow: ``reason``, endpoints, arrival number and time."""
    return settled.where("reason is not null").select("reason", *PAIR, "pkt_ord", "us")
