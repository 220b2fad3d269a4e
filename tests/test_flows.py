import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.functions.scalars import name
from flowlake.operators import active_cuts as AC
from flowlake.operators import flow_features as FF
from flowlake.operators import flows as FL
from flowlake.schema import FLOW_FEATURES
from tests.conftest import plan_of
from tests.packets import flows_by_walk, frame, packet, random_rows, trace_rows

EXPECTED = {
    "Destination Port": 80, "Flow Duration": 6_040_000, "Total Fwd Packets": 4,
    "Total Length of Fwd Packets": 100, "Fwd Packet Length Max": 100, "Fwd Packet Length Min": 0,
    "Fwd Packet Length Mean": 25, "Bwd Packet Length Max": 500, "Bwd Packet Length Min": 0,
    "Flow Bytes/s": 99.337748, "Flow Packets/s": 0.993377, "Flow IAT Mean": 1_208_000,
    "Flow IAT Std": 2_396_000, "Flow IAT Max": 6_000_000, "Flow IAT Min": 10_000,
    "Fwd IAT Mean": 2_013_333.333, "Fwd IAT Std": 2_826_073.051, "Fwd IAT Min": 10_000,
    "Bwd IAT Total": 6_020_000, "Bwd IAT Mean": 6_020_000, "Bwd IAT Std": 0,
    "Bwd IAT Max": 6_020_000, "Bwd IAT Min": 6_020_000, "Fwd Header Length": 160,
    "Bwd Header Length": 80, "Bwd Packets/s": 0.331126, "Min Packet Length": 0,
    "Max Packet Length": 500, "Packet Length Mean": 100, "Packet Length Variance": 33_333.333,
    "FIN Flag Count": 1, "PSH Flag Count": 2, "ACK Flag Count": 5, "Init_Win_bytes_forward": 8192,
    "Init_Win_bytes_backward": 65535, "act_data_pkt_fwd": 1, "min_seg_size_forward": 20,
    "Active Mean": 20_000, "Active Max": 30_000, "Active Min": 10_000,
}


def ids(assigned):
    return {r["pkt_ord"]: r["flow_id"] for r in assigned.select("pkt_ord", "flow_id").collect()}


def test_hand_trace(spark):
    assigned = FL.assign_flows(FL.prepare_packets(frame(spark, trace_rows())))
    assert ids(assigned) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 6, 7: 6, 8: 8}
    flows = {r["flow_id"]: r for r in FF.flow_features(assigned).collect()}
    assert set(EXPECTED) == set(FLOW_FEATURES)
    for feature, value in EXPECTED.items():
        assert flows[0][feature] == pytest.approx(value, rel=1e-6, abs=1e-6), feature
    for feature in FLOW_FEATURES:
        if "IAT" in feature or "/s" in feature or feature.startswith("Active"):
            assert flows[8][feature] == 0
    assert flows[8]["Init_Win_bytes_backward"] == -1
    assert flows[0]["protocol"] == "TCP" and flows[0]["src_ip"] == "A"
    assert flows[0]["duration_s"] == pytest.approx(6.04) and flows[0]["packets"] == 6


@pytest.mark.parametrize("how", [{}, {"slice_s": 1}, {"slice_s": 40}])
def test_any_trace_matches_the_walk(spark, how):
    """A hot pair, ties in time, tiny and large slices give one answer."""
    rows = random_rows(1)
    got = FL.assign_flows(FL.prepare_packets(frame(spark, rows)), 15, 40, **how)
    assert ids(got) == flows_by_walk(rows, 15, 40)


def test_only_idle_and_reset(spark):
    rows = random_rows(5, n=200)
    got = FL.assign_flows(FL.prepare_packets(frame(spark, rows)), 4, None)
    assert ids(got) == flows_by_walk(rows, 4, None)


def test_timeouts_count_at_equality(spark):
    a, b = ("A", 1), ("B", 2)
    at = [0, 14_999_999, 29_999_999, 45_000_000]
    rows = [packet(i, t, a, b) for i, t in enumerate(at)]
    assert ids(FL.assign_flows(FL.prepare_packets(frame(spark, rows)))) == {0: 0, 1: 0, 2: 2, 3: 3}
    # Ten seconds apart: the packet at exactly 120 s closes the flow and belongs to it.
    rows = [packet(i, i * 10_000_000, a, b) for i in range(15)]
    got = ids(FL.assign_flows(FL.prepare_packets(frame(spark, rows))))
    assert [got[i] for i in range(15)] == [0] * 13 + [13, 13]


def test_times_between_packets(spark):
    rows = random_rows(3, n=250)
    got = FL.assign_flows(FL.prepare_packets(frame(spark, rows)), 15, 40, slice_s=3).collect()
    flows = {}
    for r in sorted(got, key=lambda r: (r["us"], r["pkt_ord"])):
        seen = flows.setdefault(r["flow_id"], {"all": None, True: None, False: None})
        for kind, value in (("all", r["iat"]), (r["fwd"], r["iat_same"])):
            assert value == (None if seen[kind] is None else r["us"] - seen[kind])
            seen[kind] = r["us"]


def test_udp_one_way_and_other_protocols(spark):
    a, b = ("A", 5), ("B", 53)
    rows = [packet(0, 0, a, b, 17, 30), packet(1, 1000, a, b, 17, 50), packet(2, 5, a, b, 1, 0),
            packet(3, 7, a, b, 6, 0, version=6)]
    flows = FF.flow_features(FL.assign_flows(FL.prepare_packets(frame(spark, rows)))).collect()
    assert len(flows) == 1
    f = flows[0]
    assert f["protocol"] == "UDP" and f["Total Length of Fwd Packets"] == 80
    assert f["Fwd Header Length"] == 40 and f["min_seg_size_forward"] == 0
    assert f["Init_Win_bytes_forward"] == -1 and f["Bwd IAT Total"] == 0
    assert f["Bwd Packet Length Max"] == 0 and f["Active Mean"] == 1000


def test_packet_predicate_and_keys(spark):
    p = FL.prepare_packets(frame(spark, trace_rows()), "tcp_window = 65535")
    assert p.count() == 2
    k = FL.prepare_packets(frame(spark, trace_rows())).select(*FL.PAIR).distinct().collect()
    assert [tuple(r) for r in k] == [("A", 1000, "B", 80, 6)]


def test_active_gap_is_strict(spark):
    a, b = ("A", 1), ("B", 2)
    rows = [packet(i, t, a, b) for i, t in enumerate([0, 5_000_000, 10_000_001])]
    f = FF.flow_features(FL.assign_flows(FL.prepare_packets(frame(spark, rows)))).first()
    assert (f["Active Max"], f["Active Min"], f["Active Mean"]) == (5_000_000, 0, 2_500_000)


@pytest.mark.parametrize("slice_s", [None, 2])
def test_active_periods_equal_a_walk(spark, slice_s):
    """Pauses on slice edges, at flow starts and between flows; the aggregate collects nothing."""
    rows = random_rows(13, n=400, span_s=1500)
    assigned = FL.assign_flows(FL.prepare_packets(frame(spark, rows)), 15, 40, slice_s=slice_s, active_gap_s=2)
    flows = FF.flow_features(assigned)
    assert "ObjectHashAggregate" not in plan_of(flows)
    times, flow_of = {}, flows_by_walk(rows, 15, 40)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        times.setdefault(flow_of[r[0]], []).append(r[2])
    for r in flows.collect():
        periods, begin, last = [], None, None
        for t in times[r["flow_id"]]:
            if begin is None or t - last > 2_000_000:
                if begin is not None:
                    periods.append(last - begin)
                begin = t
            last = t
        periods.append(last - begin)
        if len(times[r["flow_id"]]) < 2:
            periods = [0]
        assert (r["Active Max"], r["Active Min"]) == (max(periods), min(periods))
        assert r["Active Mean"] == pytest.approx(sum(periods) / len(periods))


def test_slice_functions_compose_to_the_walk():
    """Any division of a long segment into slices, composed in any association, leads to the walk's open flow."""
    r = random.Random(2)
    active = 40
    for _ in range(200):
        us = sorted(r.randrange(400) for _ in range(r.randrange(2, 120)))
        us = np.array([us[0], *us])
        width = r.randrange(1, active + 1)
        state, slices = None, []
        for s in sorted({t // width for t in us.tolist()}):
            at = np.flatnonzero(us // width == s)
            step = [i for i in at if i == at[0] or us[i] != us[i - 1]]
            nxt = [i + 1 if i < at[-1] else None for i in step]
            outs = AC.Marks(np.array([us[i] if i is not None else 0 for i in nxt]), np.array([i or 0 for i in nxt]), np.zeros(len(step), bool),
                            np.array([i is not None for i in nxt]))
            first = AC.Marks(us[at[:1]], at[:1], np.zeros(1, bool), np.ones(1, bool))
            slices.append(AC.Steps(us[step], outs, None, first, int(us[at[0]])))
        begin, new = 0, True
        for i, t in enumerate(us):
            if new:
                begin, new = i, False
            new = new or t - us[begin] >= active
        while len(slices) > 1:
            i = r.randrange(len(slices) - 1)
            slices[i:i + 2] = [slices[i].then(slices[i + 1], active)]
        got = slices[0](AC.Marks.awaited(), active)
        assert (None if new else begin) == (int(got.ord[0]) if got.known[0] else None)


def test_one_segment_of_many_packets(spark):
    """200,000 packets of one pair without a gap: cut as by the walk, in tasks of a few slices each."""
    n = 200_000
    packets = spark.range(n).select(
        F.col("id").alias("pkt_ord"), (F.col("id") * 37_003).alias("us"), F.lit(4).alias("ip_version"), F.lit("A").alias("src_ip"),
        F.lit("B").alias("dst_ip"), F.lit(1).alias("src_port"), F.lit(2).alias("dst_port"), F.lit(17).alias("proto"), F.lit(28).alias("ip_len"),
        F.lit(5).alias("ip_ihl"), F.lit(None).cast("int").alias("tcp_dataofs"), F.lit(None).cast("int").alias("tcp_window"),
        F.lit(None).cast("int").alias("tcp_flags"), F.lit(8).alias("udp_len"))
    got = FL.assign_flows(FL.prepare_packets(packets), 15, 120).groupBy("flow_id").agg(F.count("*").alias("n")).collect()
    want, begin = Counter(), None
    for i in range(n):
        begin = i if begin is None else begin
        want[begin] += 1
        if (i - begin) * 37_003 >= 120_000_000:
            begin = None
    assert {r["flow_id"]: r["n"] for r in got} == dict(want) and len(want) > 60


def test_contract(spark):
    flows = FF.flow_features(FL.assign_flows(FL.prepare_packets(frame(spark, trace_rows()))))
    ok = FF.check_contract(flows).collect()
    assert len(ok) == 40 and all(r["status"] == "present" and r["in_order"] for r in ok)
    bad = FF.check_contract(flows.drop("Active Max").withColumn("Extra", F.lit(1.0))
                            .withColumn("Active Min", F.lit(float("nan")))).collect()
    state = {r["feature"]: r for r in bad}
    assert state["Active Max"]["status"] == "missing" and state["Extra"]["status"] == "extra"
    assert state["Active Min"]["non_finite"] == 3


def test_flow_summary_adds_up(spark):
    rows = random_rows(9, n=150)
    s = FL.flow_summary(FL.assign_flows(FL.prepare_packets(frame(spark, rows))))
    assert s.agg(F.sum("packets")).first()[0] == 150
    assert s.where(name("duration_s") < 0).count() == 0
