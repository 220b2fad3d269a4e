"""Packets to bidirectional flows.

A flow ends before a gap of at least the idle timeout, with an RST packet, or with the
packet that makes it last at least the active timeout.  One pair of endpoints may own a
large share of all packets, so nothing here sorts a whole pair in one task: packets are
sorted inside (pair, time slice), and what a slice needs to know about earlier slices is
carried over through one summary row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions import scalars as X
from flowlake.operators.active_cuts import active_starts
from flowlake.plans.bounded import localized
from flowlake.session import cut_lineage

# Default timeouts in seconds.
IDLE_S, ACTIVE_S, ACTIVE_GAP_S = 15, 120, 5

PAIR = ["a_ip", "a_port", "b_ip", "b_port", "proto"]
SLICE = [*PAIR, "slice"]

_MARK = "struct<us:bigint,ord:bigint,from_a:boolean>"


def prepare_packets(packets: DataFrame, predicate: str | Column | None = None) -> DataFrame:
    """IPv4 TCP and UDP packets with canonical endpoints, sizes and flag columns."""
    if predicate is not None:
        packets = packets.where(predicate)
    p = packets.where(F.col("ip_version") == 4).where(F.col("proto").isin(X.TCP, X.UDP))
    here, there = F.struct("src_ip", "src_port"), F.struct(
        F.col("dst_ip").alias("src_ip"), F.col("dst_port").alias("src_port"))
    tcp = F.col("proto") == X.TCP
    head = X.tcp_header_bytes(F.col("proto"), F.col("tcp_dataofs"))

    def flag(mask: int) -> Column:
        return tcp & X.has_flag(F.col("tcp_flags"), mask)

    return p.select(
        "pkt_ord", "us", "src_ip", "src_port", "dst_ip", "dst_port", "proto",
        F.least(here, there).alias("_a"), F.greatest(here, there).alias("_b"),
        X.payload_bytes(F.col("proto"), F.col("ip_len"), F.col("ip_ihl"), F.col("tcp_dataofs"),
                        F.col("udp_len")).cast("long").alias("len"),
        (F.col("ip_ihl") * 4 + head).cast("long").alias("header"),
        head.cast("long").alias("tcp_header"),
        F.when(tcp, F.col("tcp_window")).cast("long").alias("tcp_window"),
        flag(X.FIN).alias("fin"), flag(X.SYN).alias("syn"), flag(X.RST).alias("rst"),
        flag(X.PSH).alias("psh"), flag(X.ACK).alias("ack")).select(
            F.col("_a.src_ip").alias("a_ip"), F.col("_a.src_port").alias("a_port"),
            F.col("_b.src_ip").alias("b_ip"), F.col("_b.src_port").alias("b_port"), "proto",
            (F.struct("src_ip", "src_port") == F.col("_a")).alias("from_a"),
            "pkt_ord", "us", "len", "header", "tcp_header", "tcp_window",
            "fin", "syn", "rst", "psh", "ack")


def _mark() -> Column:
    """A packet as the start of something: time, arrival, sending side; ordered by time."""
    return F.struct("us", F.col("pkt_ord").alias("ord"), "from_a").cast(_MARK)


def _sliced(p: DataFrame, slice_us: int, close_on_fin: bool) -> DataFrame:
    closes = (F.col("rst") | F.col("fin")) if close_on_fin else F.col("rst")
    return (p.withColumn("slice", F.expr(f"us div {slice_us}"))
            .withColumn("_m", _mark()).withColumn("_closes", closes))


def _cuts_inside(p: DataFrame, idle_us: int, gap_us: int) -> DataFrame:
    """Add ``_prev``, the packet before in the slice; ``_cut_in``, the latest packet of the slice that
    follows an idle gap or a reset inside the slice; ``_pause_in`` and ``_pause_before``, the latest one
    that follows a pause inside the slice, this packet included or not."""
    w = Window.partitionBy(*SLICE).orderBy("us", "pkt_ord")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("_prev", F.lag("_m").over(w)).withColumn(
        "_cut", (F.col("us") - F.col("_prev.us") >= idle_us) | F.lag("_closes").over(w))
    resumed = F.when(F.col("us") - F.col("_prev.us") > gap_us, F.col("_m"))
    return (p.withColumn("_cut_in", F.last(F.when(F.col("_cut"), F.col("_m")), True).over(upto))
            .withColumn("_resumed", resumed).withColumn("_pause_in", F.last("_resumed", True).over(upto))
            .withColumn("_pause_before", F.last("_resumed", True).over(before)).drop("_resumed"))


def _carry(thin: DataFrame, idle_us: int, gap_us: int) -> DataFrame:
    """One row per (pair, slice): what the earlier slices of the pair leave to it.

    ``c_first`` is its first packet where that starts a segment, ``c_seg`` the segment open
    at its beginning, ``c_prev``/``c_a``/``c_b`` the last packets before it (any, a's, b's),
    ``c_out`` the last segment that starts inside, ``c_resume`` its first packet where that follows a pause, ``c_pause`` the latest earlier one.
    """
    ends = thin.groupBy(*SLICE).agg(
        F.min("_m").alias("first"),
        F.max(F.struct("_m", "_closes")).alias("last"), F.max("_cut_in").alias("cut"),
        F.max("_pause_in").alias("pause"),
        F.max(F.when(F.col("from_a"), F.col("_m"))).alias("a"),
        F.max(F.when(~F.col("from_a"), F.col("_m"))).alias("b"))
    by_pair = Window.partitionBy(*PAIR).orderBy("slice")
    earlier = by_pair.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.lag("last").over(by_pair))
    opens = F.coalesce((F.col("first.us") - F.col("before._m.us") >= idle_us)
                       | F.col("before._closes"), F.lit(True))
    ends = ends.withColumn("c_first", F.when(opens, F.col("first"))).withColumn(
        "c_resume", F.when(F.col("first.us") - F.col("before._m.us") > gap_us, F.col("first")))
    return ends.select(
        *SLICE, "first", "c_first", F.coalesce("cut", "c_first").alias("c_out"), "c_resume", F.max(F.coalesce("pause", "c_resume")).over(earlier).alias("c_pause"), F.col("before._m").alias("c_prev"),
        F.max("a").over(earlier).alias("c_a"), F.max("b").over(earlier).alias("c_b"),
        F.max(F.coalesce("cut", "c_first")).over(earlier).alias("c_seg"))


def _segment() -> Column:
    """First packet of the segment between idle gaps and resets."""
    return F.coalesce("_cut_in", "c_first", "c_seg")


def assign_flows(packets: DataFrame, idle_s: float = IDLE_S, active_s: float | None = ACTIVE_S,
                 close_on_fin: bool = False, slice_s: float | None = None,
                 active_gap_s: float = ACTIVE_GAP_S) -> DataFrame:
    """Prepared packets plus ``start`` (first packet of the flow), ``flow_id`` (its arrival
    number), ``fwd``, and the inter-arrival times ``iat`` (any side) and ``iat_same``.

    ``island_us`` is the time at which the flow's current active period began, ``ended`` the
    length of the period before it, on the packet that follows a gap of more than
    ``active_gap_s``.  As the flows of a pair follow each other, the pauses are those of the
    pair, and what a slice needs of earlier ones is one more mark of its summary row.

    A first pass over times, sides and resets finds what each slice inherits; the pass over
    whole packets then shuffles them once, by (pair, slice).  ``slice_s`` bounds what one
    task sorts; by default it is a quarter of the active timeout.
    """
    idle_us, gap_us = int(idle_s * 1e6), int(active_gap_s * 1e6)
    slice_us = int((slice_s or (active_s or idle_s) / 4) * 1e6)
    if active_s is not None and slice_us > active_s * 1e6:
        raise ValueError("a slice may not be longer than the active timeout")
    full = _sliced(packets, slice_us, close_on_fin)
    thin = cut_lineage(_cuts_inside(
        full.select(*SLICE, "us", "pkt_ord", "from_a", "_m", "_closes"), idle_us, gap_us)
        .withColumn("_next", F.lead("_m").over(Window.partitionBy(*SLICE).orderBy("us", "pkt_ord"))))
    inherited = localized(_carry(thin, idle_us, gap_us))
    cuts = active_starts(thin, inherited, PAIR, int(active_s * 1e6)) if active_s is not None else None
    if cuts is not None:
        inherited = localized(inherited.join(cuts, SLICE, "left"))
    same = Window.partitionBy(*SLICE, "from_a").orderBy("us", "pkt_ord")
    rows = (_cuts_inside(full, idle_us, gap_us).withColumn("_same", F.lag("_m").over(same))
            .join(inherited, SLICE))
    start = _segment()
    if cuts is not None:
        start = F.greatest(start, F.col("c_active"), F.when(F.col("c_cut") <= F.col("_m"), F.col("c_cut")))
    prev = F.coalesce("_prev", "c_prev")
    prev_same = F.coalesce("_same", F.when(F.col("from_a"), F.col("c_a")).otherwise(F.col("c_b")))
    pause = F.coalesce("_pause_in", "c_resume", "c_pause")
    before = F.when(F.col("_prev").isNull(), F.col("c_pause")).otherwise(F.coalesce("_pause_before", "c_resume", "c_pause"))
    gap = F.col("us") - prev["us"]
    # A packet before the flow's first one belongs to another flow.
    return rows.withColumn("start", start).select(
        *packets.columns, "start", F.greatest("start", pause)["us"].alias("island_us"),
        F.when((prev >= F.col("start")) & (gap > gap_us), prev["us"] - F.greatest("start", before)["us"]).alias("ended"), F.col("start.ord").alias("flow_id"),
        (F.col("from_a") == F.col("start.from_a")).alias("fwd"),
        F.when(prev >= F.col("start"), F.col("us") - prev["us"]).alias("iat"),
        F.when(prev_same >= F.col("start"), F.col("us") - prev_same["us"]).alias("iat_same"))


def flow_columns() -> list[Column]:
    """Endpoints as the initiator sees them."""
    a_first = F.col("start.from_a")
    return [F.when(a_first, F.col("a_ip")).otherwise(F.col("b_ip")).alias("src_ip"),
            F.when(a_first, F.col("b_ip")).otherwise(F.col("a_ip")).alias("dst_ip"),
            F.when(a_first, F.col("a_port")).otherwise(F.col("b_port")).alias("src_port"),
            F.when(a_first, F.col("b_port")).otherwise(F.col("a_port")).alias("dst_port"),
            X.proto_name(F.col("proto")).alias("protocol")]


def flow_summary(assigned: DataFrame) -> DataFrame:
    """One row per flow: endpoints, protocol name, duration, packets, end time."""
    g = assigned.groupBy("flow_id", "start", *PAIR).agg(
        F.count("*").alias("packets"), F.min("us").alias("_lo"), F.max("us").alias("_hi"))
    return g.select("flow_id", *flow_columns(),
                    ((F.col("_hi") - F.col("_lo")) / 1e6).alias("duration_s"), "packets",
                    F.timestamp_micros("_hi").alias("end_time"))


def first_flows(summary: DataFrame, n: int) -> DataFrame:
    """The ``n`` flows that ended first."""
    return summary.orderBy("end_time", "flow_id").limit(n)
