"""Hand-made and random packet traces, and the flow rules written out row by row."""

import random
from datetime import datetime, timezone

from flowlake.schema import PACKETS

FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16

# (seconds, from the client, flags, payload, window); client A:1000, server B:80.
TRACE = [
    (0.000, True, SYN, 0, 8192), (0.010, False, SYN | ACK, 0, 65535), (0.020, True, ACK, 0, 8192),
    (0.030, True, PSH | ACK, 100, 8192), (6.030, False, PSH | ACK, 500, 65535),
    (6.040, True, FIN | ACK, 0, 8192), (21.040, True, ACK, 0, 8192), (21.050, False, RST, 0, 0),
    (21.060, True, SYN, 0, 8192),
]


def packet(ordinal, us, src, dst, proto=6, payload=0, flags=0, window=0, version=4):
    """A decoded packet; ``src`` and ``dst`` are (ip, port)."""
    tcp = proto == 6
    return (ordinal, datetime.fromtimestamp(us / 1e6, timezone.utc), us, version, src[0], dst[0],
            src[1], dst[1], proto, (40 if tcp else 28) + payload, 5, 5 if tcp else None,
            window if tcp else None, flags if tcp else None, None if tcp else 8 + payload)


def trace_rows():
    a, b = ("A", 1000), ("B", 80)
    return [packet(i, round(t * 1e6), *((a, b) if client else (b, a)), 6, size, flags, window)
            for i, (t, client, flags, size, window) in enumerate(TRACE)]


def frame(spark, rows):
    return spark.createDataFrame(rows, PACKETS)


def random_rows(seed, n=400, hot=0.5, span_s=900):
    """Packets of a few pairs, one of which has about ``hot`` of them; ties in time occur."""
    rng = random.Random(seed)
    ends = [("h%d" % i, 1000 + i) for i in range(5)]
    times = sorted(rng.randrange(span_s * 10) * 100_000 for _ in range(n))
    rows = []
    for i, us in enumerate(times):
        s, d = (ends[0], ends[1]) if rng.random() < hot else rng.sample(ends, 2)
        if rng.random() < 0.4:
            s, d = d, s
        flags = rng.choice([0, ACK, PSH | ACK, SYN, FIN] + ([RST] if rng.random() < 0.15 else []))
        rows.append(packet(i, us, s, d, rng.choice([6, 6, 17]) if s != ends[0] else 6,
                           rng.randrange(0, 300), flags, rng.randrange(1, 5000)))
    return rows


def flows_by_walk(rows, idle_s, active_s):
    """Flow id per packet ordinal, pair by pair in time order."""
    pairs = {}
    for r in rows:
        ends = tuple(sorted([(r[4], r[6]), (r[5], r[7])]))
        pairs.setdefault((ends, r[8]), []).append(r)
    out = {}
    for packets in pairs.values():
        last, first, closed = None, None, True
        for r in sorted(packets, key=lambda r: (r[2], r[0])):
            us = r[2]
            if closed or us - last >= idle_s * 1e6:
                first = (us, r[0])
            out[r[0]] = first[1]
            last = us
            closed = bool((r[13] or 0) & RST) or (
                active_s is not None and us - first[0] >= active_s * 1e6)
    return out
