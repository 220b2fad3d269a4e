"""Running sums of open flows: what one run of packets adds up to, and how two runs become one.

A sum has the same size whatever number of packets it stands for.  Runs are in time order; the
times between the last packets of one run and the first ones of the next are added when they
are merged, so any division of a flow into runs gives the sums of the whole flow.
"""

from __future__ import annotations

import math

import numpy as np

SIDES = ("fwd", "bwd")
#: Numbers whose count, mean, spread, least and largest value are kept.
SPREADS = ("len", "iat", "fwd_iat", "bwd_iat")
_FLAGS = ("fin", "psh", "ack")

COUNTS = ["n", "bytes", *_FLAGS, "fwd_data", "periods", "active_sum",
          *[f"{s}_{x}" for s in SIDES for x in ("n", "bytes", "header")], *[f"{k}_n" for k in SPREADS]]
LEAST = ["active_min", "min_seg", "fwd_min", "bwd_min", *[f"{k}_min" for k in SPREADS]]
MOST = ["active_max", "fwd_max", "bwd_max", *[f"{k}_max" for k in SPREADS]]
#: First and last times, of all packets and of each side; the first and current active period; first windows of SYN packets.
TIMES = ["lo", "hi", "fwd_lo", "fwd_hi", "bwd_lo", "bwd_hi", "first_end", "island_us", "fwd_win", "bwd_win"]
START = ["start_us", "flow_id"]
MOMENTS = [f"{k}_{x}" for k in SPREADS for x in ("mean", "m2")]
#: All numbers of a sum; whole ones may be absent (None), means and moments are 0 without values.
WHOLE = [*START, *COUNTS, *LEAST, *MOST, *TIMES]
TCP = 6


def _times(us: np.ndarray) -> tuple:
    return (int(us[0]), int(us[-1])) if len(us) else (None, None)


def _spread(out: dict, key: str, x: np.ndarray) -> None:
    n = len(x)
    mean = float(x.mean()) if n else 0.0
    out.update({f"{key}_n": n, f"{key}_mean": mean, f"{key}_m2": float(((x - mean) ** 2).sum()) if n else 0.0,
                f"{key}_min": int(x.min()) if n else None, f"{key}_max": int(x.max()) if n else None})


def of_run(p: dict[str, np.ndarray], lo: int, hi: int, start: tuple[int, int, bool], proto: int, gap_us: int) -> dict:
    """The sums of packets ``lo`` to ``hi`` of ``p`` (in time order), of a flow that began with ``start``."""
    us, size = p["us"][lo:hi], p["len"][lo:hi]
    fwd = p["from_a"][lo:hi] == start[2]
    out = {"start_us": start[0], "flow_id": start[1], "start_from_a": bool(start[2]), "n": len(us), "bytes": int(size.sum())}
    out.update({f: int(p[f][lo:hi].sum()) for f in _FLAGS})
    out["fwd_data"] = int((fwd & (size > 0)).sum()) if proto == TCP else 0
    heads = p["tcp_header"][lo:hi][fwd] if proto == TCP else np.empty(0, np.int64)
    heads = heads[heads > 0]
    out["min_seg"] = int(heads.min()) if len(heads) else None
    iat = np.diff(us)
    resume = np.flatnonzero(iat > gap_us) + 1
    begins, ends = np.concatenate([[0], resume]), np.concatenate([resume - 1, [len(us) - 1]])
    lengths = us[ends] - us[begins]
    # The first and the last period may go on in another run: only those between are finished.
    inner = lengths[1:-1]
    out.update({"lo": int(us[0]), "hi": int(us[-1]), "first_end": int(us[ends[0]]), "island_us": int(us[begins[-1]]), "periods": len(begins),
                "active_sum": int(inner.sum()), "active_min": int(inner.min()) if len(inner) else None, "active_max": int(inner.max()) if len(inner) else None})
    _spread(out, "len", size)
    _spread(out, "iat", iat)
    for side, own in (("fwd", fwd), ("bwd", ~fwd)):
        sizes = size[own]
        out.update({f"{side}_n": len(sizes), f"{side}_bytes": int(sizes.sum()), f"{side}_header": int(p["header"][lo:hi][own].sum()),
                    f"{side}_min": int(sizes.min()) if len(sizes) else None, f"{side}_max": int(sizes.max()) if len(sizes) else None})
        out[f"{side}_lo"], out[f"{side}_hi"] = _times(us[own])
        _spread(out, f"{side}_iat", np.diff(us[own]))
        window = p["tcp_window"][lo:hi]
        seen = np.flatnonzero(own & p["syn"][lo:hi] & (window >= 0))
        out[f"{side}_win"] = int(window[seen[0]]) if len(seen) else None
    return out


def _join_spread(out: dict, key: str, a: dict, b: dict) -> None:
    n = a[f"{key}_n"] + b[f"{key}_n"]
    gap = b[f"{key}_mean"] - a[f"{key}_mean"]
    share = b[f"{key}_n"] / n if n else 0.0
    out[f"{key}_mean"] = a[f"{key}_mean"] + gap * share
    out[f"{key}_m2"] = a[f"{key}_m2"] + b[f"{key}_m2"] + gap * gap * a[f"{key}_n"] * share
    out[f"{key}_n"] = n


def _one(value: int) -> dict:
    out: dict = {}
    _spread(out, "x", np.array([value], np.int64))
    return out


def _low(*values):
    return min((v for v in values if v is not None), default=None)


def _high(*values):
    return max((v for v in values if v is not None), default=None)


def merge(a: dict, b: dict, gap_us: int) -> dict:
    """The sums of run ``a`` followed by run ``b`` of the same flow."""
    out = {k: a[k] for k in ("start_us", "flow_id", "start_from_a")}
    out.update({k: a[k] + b[k] for k in COUNTS})
    out.update({k: _low(a[k], b[k]) for k in LEAST})
    out.update({k: _high(a[k], b[k]) for k in MOST})
    between = {"iat": b["lo"] - a["hi"]}
    for side in SIDES:
        if a[f"{side}_hi"] is not None and b[f"{side}_lo"] is not None:
            between[f"{side}_iat"] = b[f"{side}_lo"] - a[f"{side}_hi"]
        out[f"{side}_lo"], out[f"{side}_hi"] = _low(a[f"{side}_lo"], b[f"{side}_lo"]), _high(a[f"{side}_hi"], b[f"{side}_hi"])
        out[f"{side}_win"] = a[f"{side}_win"] if a[f"{side}_win"] is not None else b[f"{side}_win"]
    for key in SPREADS:
        left = a
        if key in between:
            extra, left = _one(between[key]), {}
            _join_spread(left, key, a, {k.replace("x_", f"{key}_"): v for k, v in extra.items()})
            out[f"{key}_min"], out[f"{key}_max"] = _low(out[f"{key}_min"], between[key]), _high(out[f"{key}_max"], between[key])
        _join_spread(out, key, left, b)
    out["lo"], out["hi"] = a["lo"], b["hi"]
    pause = between["iat"] > gap_us
    # Periods that end here: a's last and b's first one, or the two as one.
    done = [a["hi"] - a["island_us"], b["first_end"] - b["lo"]] if pause else [b["first_end"] - a["island_us"]]
    a_open, b_open = a["periods"] == 1, b["periods"] == 1
    if pause:
        out["first_end"], out["island_us"] = a["first_end"], b["island_us"]
        finished = [x for x, is_edge in zip(done, (a_open, b_open)) if not is_edge]
    else:
        out["periods"] -= 1
        out["first_end"] = b["first_end"] if a_open else a["first_end"]
        out["island_us"] = a["island_us"] if b_open else b["island_us"]
        finished = [] if a_open or b_open else done
    out["active_sum"] += sum(finished)
    out["active_min"], out["active_max"] = _low(out["active_min"], *finished), _high(out["active_max"], *finished)
    return out


def statistics(s: dict) -> dict:
    """A whole flow's sums as the columns that the batch aggregate gives."""
    edges = [s["hi"] - s["lo"]] if s["periods"] == 1 else [s["first_end"] - s["lo"], s["hi"] - s["island_us"]]
    out = {k: s[k] for k in ("flow_id", "start_us", "start_from_a", "n", "lo", "hi", "bytes", "len_min", "len_max", *_FLAGS,
                             "fwd_win", "bwd_win", "fwd_data", "min_seg", "bwd_lo", "bwd_hi", "periods")}
    out["active_sum"] = s["active_sum"] + sum(edges)
    out["active_min"], out["active_max"] = _low(s["active_min"], *edges), _high(s["active_max"], *edges)
    out["len_mean"], out["len_var"] = s["len_mean"], s["len_m2"] / s["n"]
    for side in SIDES:
        n = s[f"{side}_n"]
        out.update({f"{side}_{x}": s[f"{side}_{x}"] if n or x == "n" else None for x in ("n", "bytes", "max", "min", "header")})
        out[f"{side}_mean"] = s[f"{side}_bytes"] / n if n else None
    for key in ("iat", "fwd_iat", "bwd_iat"):
        n = s[f"{key}_n"]
        out[f"{key}_mean"] = s[f"{key}_mean"] if n else None
        out[f"{key}_std"] = math.sqrt(s[f"{key}_m2"] / n) if n else None
        out[f"{key}_min"], out[f"{key}_max"] = s[f"{key}_min"], s[f"{key}_max"]
    return out
