"""The forty features of a flow as one aggregate over its packets, and their contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake import schema as S
from flowlake.functions.scalars import TCP, is_finite, name
from flowlake.operators.flows import PAIR, flow_columns

SUMMARY = ["flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "duration_s",
           "packets", "end_time"]


def packet_statistics(assigned: DataFrame) -> DataFrame:
    """Counts, sizes, times, flags and active periods per flow and direction.

    Every aggregate is of fixed size and combines before the shuffle: a period's length is
    known to the packet that follows it, the last one ends with the flow.
    """
    fwd, bwd = F.col("fwd"), ~F.col("fwd")

    def on(side: Column, x) -> Column:
        return F.when(side, F.col(x) if isinstance(x, str) else x)

    def first_window(side: Column) -> Column:
        seen = side & F.col("syn") & F.col("tcp_window").isNotNull()
        order = F.when(seen, F.struct("us", "pkt_ord"))
        return F.min_by(F.when(seen, F.col("tcp_window")), order)

    last = F.max("us") - F.max("island_us")
    gaps = F.coalesce(F.sum(F.when(F.col("ended").isNotNull(), F.col("iat"))), F.lit(0))
    iat_fwd, iat_bwd = on(fwd, "iat_same"), on(bwd, "iat_same")
    seg = F.when(fwd & (F.col("proto") == TCP) & (F.col("tcp_header") > 0), F.col("tcp_header"))
    out = [
        F.count("*").alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"),
        F.sum("len").alias("bytes"), F.min("len").alias("len_min"), F.max("len").alias("len_max"),
        F.avg("len").alias("len_mean"), F.var_pop("len").alias("len_var"),
        F.min(on(bwd, "us")).alias("bwd_lo"), F.max(on(bwd, "us")).alias("bwd_hi"),
        F.count_if(F.col("fin")).alias("fin"), F.count_if(F.col("psh")).alias("psh"),
        F.count_if(F.col("ack")).alias("ack"),
        first_window(fwd).alias("fwd_win"), first_window(bwd).alias("bwd_win"),
        F.count_if(fwd & (F.col("proto") == TCP) & (F.col("len") > 0)).alias("fwd_data"),
        F.min(seg).alias("min_seg"), (F.count("ended") + 1).alias("periods"),
        (F.max("us") - F.min("us") - gaps).alias("active_sum"),
        F.greatest(F.max("ended"), last).alias("active_max"), F.least(F.min("ended"), last).alias("active_min"),
    ]
    for side, cond in (("fwd", fwd), ("bwd", bwd)):
        out += [F.count_if(cond).alias(f"{side}_n"), F.sum(on(cond, "len")).alias(f"{side}_bytes"),
                F.max(on(cond, "len")).alias(f"{side}_max"), F.min(on(cond, "len")).alias(f"{side}_min"),
                F.avg(on(cond, "len")).alias(f"{side}_mean"),
                F.sum(on(cond, "header")).alias(f"{side}_header")]
    for tag, x in (("iat", F.col("iat")), ("fwd_iat", iat_fwd), ("bwd_iat", iat_bwd)):
        out += [F.avg(x).alias(f"{tag}_mean"), F.stddev_pop(x).alias(f"{tag}_std"),
                F.max(x).alias(f"{tag}_max"), F.min(x).alias(f"{tag}_min")]
    return assigned.groupBy("flow_id", "start", *PAIR).agg(*out)


def flow_features(assigned: DataFrame) -> DataFrame:
    """Summary columns and the forty features, all finite."""
    return features_of(packet_statistics(assigned))


def features_of(s: DataFrame) -> DataFrame:
    """:func:`flow_features` from the statistics of whole flows, however they were added up."""
    dur = F.col("hi") - F.col("lo")
    moving = (F.col("n") >= 2) & (dur > 0)

    def rate(x: str) -> Column:
        return F.when(moving, F.col(x) / (dur / 1e6))

    several = F.col("n") >= 2
    value = {
        "Destination Port": F.when(F.col("start.from_a"), F.col("b_port")).otherwise(F.col("a_port")),
        "Flow Duration": dur,
        "Total Fwd Packets": F.col("fwd_n"),
        "Total Length of Fwd Packets": F.col("fwd_bytes"),
        "Fwd Packet Length Max": F.col("fwd_max"),
        "Fwd Packet Length Min": F.col("fwd_min"),
        "Fwd Packet Length Mean": F.col("fwd_mean"),
        "Bwd Packet Length Max": F.col("bwd_max"),
        "Bwd Packet Length Min": F.col("bwd_min"),
        "Flow Bytes/s": rate("bytes"),
        "Flow Packets/s": rate("n"),
        "Flow IAT Mean": F.col("iat_mean"),
        "Flow IAT Std": F.col("iat_std"),
        "Flow IAT Max": F.col("iat_max"),
        "Flow IAT Min": F.col("iat_min"),
        "Fwd IAT Mean": F.col("fwd_iat_mean"),
        "Fwd IAT Std": F.col("fwd_iat_std"),
        "Fwd IAT Min": F.col("fwd_iat_min"),
        "Bwd IAT Total": F.col("bwd_hi") - F.col("bwd_lo"),
        "Bwd IAT Mean": F.col("bwd_iat_mean"),
        "Bwd IAT Std": F.col("bwd_iat_std"),
        "Bwd IAT Max": F.col("bwd_iat_max"),
        "Bwd IAT Min": F.col("bwd_iat_min"),
        "Fwd Header Length": F.col("fwd_header"),
        "Bwd Header Length": F.col("bwd_header"),
        "Bwd Packets/s": rate("bwd_n"),
        "Min Packet Length": F.col("len_min"),
        "Max Packet Length": F.col("len_max"),
        "Packet Length Mean": F.col("len_mean"),
        "Packet Length Variance": F.col("len_var"),
        "FIN Flag Count": F.col("fin"),
        "PSH Flag Count": F.col("psh"),
        "ACK Flag Count": F.col("ack"),
        "Init_Win_bytes_forward": F.coalesce("fwd_win", F.lit(-1)),
        "Init_Win_bytes_backward": F.coalesce("bwd_win", F.lit(-1)),
        "act_data_pkt_fwd": F.col("fwd_data"),
        "min_seg_size_forward": F.col("min_seg"),
        "Active Mean": F.when(several, F.col("active_sum") / F.col("periods")),
        "Active Max": F.when(several, F.col("active_max")),
        "Active Min": F.when(several, F.col("active_min")),
    }
    return s.select(
        "flow_id", *flow_columns(), (dur / 1e6).alias("duration_s"), F.col("n").alias("packets"),
        F.timestamp_micros("hi").alias("end_time"),
        # Sums and guarded quotients of whole numbers: the only non-finite value is null.
        *[F.coalesce(value[f].cast("double"), F.lit(0.0)).alias(f) for f in S.FLOW_FEATURES])


def check_contract(flows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per expected or present feature: position, presence, non-finite values, rows."""
    wanted = list(S.FLOW_FEATURES if names is None else names)
    present = [c for c in flows.columns if c not in SUMMARY]
    shared = [c for c in wanted if c in present]
    counts = flows.agg(F.count("*").alias("n"), *[
        F.count_if(~is_finite(name(c))).alias(f"b{i}") for i, c in enumerate(shared)]).first()
    bad = {c: counts[f"b{i}"] for i, c in enumerate(shared)}
    rows = [(c, "present" if c in bad else "missing",
             bool(c in bad and present.index(c) == i), bad.get(c), counts["n"])
            for i, c in enumerate(wanted)]
    rows += [(c, "extra", False, None, counts["n"]) for c in present if c not in wanted]
    return flows.sparkSession.createDataFrame(
        rows, "feature string, status string, in_order boolean, non_finite long, n_flows long")
