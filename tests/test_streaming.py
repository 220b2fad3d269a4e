import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake import schema as S
from flowlake.functions.scalars import name
from flowlake.operators import flow_features as FF
from flowlake.operators import flows as FL
from flowlake.operators import modeling as MD
from flowlake.queries import streams
from flowlake.session import new_folder
from flowlake.sources.packets import stream_packets
from flowlake.streaming import alerts as A
from flowlake.streaming import sums
from flowlake.streaming.flows import add_settled
from tests.packets import flows_by_walk, frame, packet, random_rows

IDLE, ACTIVE = 15_000_000, 120_000_000


def run_of(us, rst=None, seed=0):
    r, n = random.Random(seed), len(us)
    out = {"us": np.array(us, np.int64), "pkt_ord": np.arange(n), "rst": np.array(rst or [False] * n),
           "len": np.array([r.randrange(300) for _ in us], np.int64), "from_a": np.array([r.random() < 0.5 for _ in us]),
           "header": np.full(n, 40), "tcp_header": np.full(n, 20), "tcp_window": np.array([r.choice([-1, 5, 9]) for _ in us], np.int64)}
    return out | {f: np.array([r.random() < 0.3 for _ in us]) for f in ("fin", "syn", "psh", "ack")}


def test_closing_rules():
    def run(us, rst=None, mark=10**12):
        closed, opened = add_settled(None, run_of(us, rst), mark, 6, IDLE, ACTIVE, 5_000_000)
        return [(s["flow_id"], s["n"]) for s in closed], opened and opened["n"]

    assert run([0, 1, 2]) == ([(0, 3)], None)
    assert run([0, 1, 2], mark=5) == ([], 3)
    assert run([0, 1, 2], [False, True, False], mark=5) == ([(0, 2)], 1)
    assert run([0, 15_000_000], mark=15_000_000) == ([(0, 1)], 1)
    assert run([0, 14_999_999], mark=15_000_000) == ([], 2)
    ten = [i * 10_000_000 for i in range(13)]
    assert run(ten, mark=ten[-1]) == ([(0, 13)], None)


def test_sums_merge_in_any_order():
    """Any division of a flow into runs, merged in any association, gives the sums of the whole flow."""
    r = random.Random(1)
    for seed in range(200):
        us = sorted(r.randrange(60) * 1_000_000 for _ in range(r.randrange(1, 30)))
        p, n = run_of(us, seed=seed), len(us)
        start = (us[0], 0, bool(p["from_a"][0]))
        whole = sums.statistics(sums.of_run(p, 0, n, start, 6, 5_000_000))
        cuts = sorted({0, n, *[r.randrange(n + 1) for _ in range(4)]})
        parts = [sums.of_run(p, a, b, start, 6, 5_000_000) for a, b in zip(cuts, cuts[1:])]
        while len(parts) > 1:
            i = r.randrange(len(parts) - 1)
            parts[i:i + 2] = [sums.merge(parts[i], parts[i + 1], 5_000_000)]
        assert sums.statistics(parts[0]) == {k: v if v is None else pytest.approx(v, rel=1e-9, abs=1e-6) for k, v in whole.items()}


def test_state_does_not_grow_with_the_flow():
    """A million packets of one flow, a batch at a time: the state stays as small as after the first thousand."""
    opened, sizes = None, []
    for batch in range(100):
        us = [(batch * 10_000 + i) * 100 for i in range(10_000)]
        closed, opened = add_settled(opened, run_of(us), us[-1], 6, IDLE, 10**12, 5_000_000)
        assert not closed
        sizes.append(len(json.dumps(opened)))
    assert opened["n"] == 1_000_000 and max(sizes) < sizes[0] + 200


def play(spark, batches, sink, **options):
    """Each batch arrives as a file of its own, then the closing packet."""
    source, checkpoint = new_folder(spark, "packets"), new_folder(spark, "stream")
    whole = frame(spark, [r for b in batches for r in b])
    parts = [frame(spark, b) for b in batches] + [A.closing_packet(spark, whole, 15)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        A.run_to_end(lambda: A.start_flow_stream(stream_packets(spark, source), sink, checkpoint,
                                                 available_now=True, **options))


@pytest.fixture(scope="module")
def rows():
    return random_rows(11, n=200, span_s=400)


def test_stream_equals_batch(spark, rows):
    """Three arrivals, the second one out of order inside the watermark."""
    out = new_folder(spark, "flows")
    batches = [rows[:80], rows[100:150] + rows[80:100], rows[150:]]
    play(spark, batches, A.feature_sink(out), idle_s=15, active_s=40, watermark="60 seconds")
    layout = "flow_id long, " + ", ".join(f"`{f}` double" for f in S.FLOW_FEATURES)
    stream = {r["flow_id"]: r for r in spark.read.schema(layout).json(out).collect()}
    batch = FF.flow_features(FL.assign_flows(FL.prepare_packets(frame(spark, rows)), 15, 40))
    want = {r["flow_id"]: r for r in batch.collect()}
    assert set(stream) == set(want) == set(flows_by_walk(rows, 15, 40).values())
    for flow, r in want.items():
        for f in S.FLOW_FEATURES:
            assert stream[flow][f] == pytest.approx(r[f], rel=1e-9, abs=1e-6), (flow, f)


def test_alert_stream(spark, rows):
    flows = FF.flow_features(FL.assign_flows(FL.prepare_packets(frame(spark, rows)), 15, 40))
    flows = flows.withColumn("Attack Type", F.when(
        name("Total Fwd Packets") > 2, "DoS").otherwise(S.BENIGN_GROUP))
    clf = MD.fit_classifier(flows, S.FLOW_FEATURES, "Attack Type", "forest",
                            {"max_depth": 3, "n_estimators": 3}, weighted=False)
    out = new_folder(spark, "alerts")
    sink = A.alert_sink(clf, out, only_non_benign=True, min_confidence=0.5)
    play(spark, [rows], sink, idle_s=15, active_s=40, watermark="60 seconds")
    lines = [json.loads(r[0]) for r in spark.read.text(out).collect()]
    assert lines
    for a in lines:
        assert list(a) == ["ts", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "duration_s",
                           "packets", "prediction", "confidence", "probabilities"]
        assert a["prediction"] == "DoS" and a["confidence"] >= 0.5
        assert sum(a["probabilities"].values()) == pytest.approx(1, abs=1e-5)
        assert a["ts"].endswith("Z")
    want = clf.score(flows, digits=6).where("prediction = 'DoS' and confidence >= 0.5").count()
    assert len(lines) == want


def test_packets_set_aside(spark, rows):
    """A packet behind the watermark and one without an address arrive in the quarantine, flows are as without them."""
    late = packet(9001, 1_000, ("h0", 1000), ("h1", 1001))
    lost = packet(9002, rows[-1][2], (None, 1), ("h1", 1001))
    out, aside = new_folder(spark, "flows"), new_folder(spark, "aside")
    play(spark, [rows[:150], rows[150:160], [late, lost] + rows[160:]], A.feature_sink(out), idle_s=15, active_s=40, watermark="60 seconds",
         quarantine=aside)
    found = {(r["pkt_ord"], r["reason"], r["us"]) for r in spark.read.schema("reason string, pkt_ord long, us long").json(aside).collect()}
    assert (9001, "late", 1_000) in found and (9002, "no address", rows[-1][2]) in found
    assert {o for o, _, _ in found} <= {9001, 9002, -1}
    got = {r["flow_id"]: r["n"] for r in spark.read.schema("flow_id long, `Total Fwd Packets` double, packets long").json(out)
           .selectExpr("flow_id", "packets as n").collect()}
    want = Counter(flows_by_walk(rows, 15, 40).values())
    assert {k: v for k, v in got.items() if k != -1} == dict(want)


def test_a_hot_pair(spark):
    """A pair with a third of all packets, in several arrivals, is cut as by the walk."""
    rows = random_rows(21, n=1500, hot=0.4, span_s=600)
    out = new_folder(spark, "flows")
    play(spark, [rows[:700], rows[700:1200], rows[1200:]], A.feature_sink(out), idle_s=15, active_s=40, watermark="30 seconds")
    got = {r["flow_id"]: r["packets"] for r in spark.read.schema("flow_id long, packets long").json(out).collect()}
    assert {k: v for k, v in got.items() if k != -1} == dict(Counter(flows_by_walk(rows, 15, 40).values()))


def test_the_check_scores_both_sides_with_one_model(spark, sf_dir, monkeypatch):
    """A second fit may draw other rows, and then alerts differ though stream and batch agree."""
    fitted, fit = [], streams.flow_model

    def other_each_time(spark, d):
        fitted.append(fit(spark, d))
        return fitted[-1] if len(fitted) == 1 else MD.Classifier(fitted[0].model, fitted[0].features, fitted[0].labels[::-1])

    monkeypatch.setattr(streams, "flow_model", other_each_time)
    assert tuple(streams.stream_alerts_check(spark, sf_dir).first()) == (0, 0, True)
