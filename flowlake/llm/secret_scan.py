"""Secrets: pattern spans, and a character convolutional network over every candidate and its context.

A candidate is a run of key characters, at least eight with a digit among them or twelve without.
Candidates that a pattern span covers are the labelled findings; the network learns to tell their kinds from the other
candidates by the characters of the candidate and around it.  Candidates are divided by their
own text: three quarters train, the rest calibrates scores and thresholds, from counts over the
whole corpus.  What the patterns found always stays; the network adds spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import slices, stored, texts, utf8

#: The kinds in order and their patterns.  Class 0 of a candidate is "none".
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run is taken whole, so the shorter ones need not be matched
#: Texts without it have no pattern span.
_ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"
LEAST_VALUE, LEAST_ACCESS = 12, 18

#: Length of a candidate at least, with a digit and without; characters of context before and after it; filters.
LEAST, LEAST_PLAIN, BEFORE, AFTER, WIDTH, FILTERS = 8, 12, 32, 16, 5, 16
#: Labelled findings of a kind, and other candidates, that the network is fitted on; steps, batch and rate of the fit.
MAX_FINDINGS, MAX_OTHERS, STEPS, BATCH, RATE, DECAY = 1500, 4500, 200, 512, 0.02, 1e-4
#: Share of the held-back findings of a kind that its threshold keeps, findings needed for one, least probability.
RECALL, ENOUGH, PROBABLE = 0.95, 20, 0.5
#: Score bins of the calibration.
BIN, BINS = 0.25, 161
#: Texts searched at a time, and characters convolved at a time.
SLICE_BYTES, POSITIONS = 8 << 20, 1 << 18

_KEY = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", np.uint8))
_CODE = np.minimum(np.arange(256), 128)
_CODES, _PAD = 130, 129
_LENGTHS = np.array([16, 20, 32, 40, 64])
CLASSES = len(KINDS) + 1


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in code points, sorted; leftmost matches per kind, failing ones dropped."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


@dataclass
class Candidates:
    """The candidates of a column of texts: text number, place in its code points and in all bytes, class by the patterns."""

    raw: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray
    label: np.ndarray

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes at which the contexts begin and end, inside the text."""
        return np.maximum(self.low - BEFORE, self.first), np.minimum(self.high + AFTER, self.last)

    def texts(self, low: np.ndarray, high: np.ndarray) -> list[bytes]:
        whole = self.raw.tobytes()
        return [whole[a:b] for a, b in zip(low.tolist(), high.tolist())]


def find(column: pa.StringArray) -> tuple[Candidates, list[list[tuple[int, int, int]]]]:
    """The candidates of a column, and every text's pattern spans."""
    raw, offsets = utf8(column)
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    hits = np.flatnonzero(pc.match_substring_regex(column, _ANY).to_numpy(zero_copy_only=False))
    for i, text in zip(hits.tolist(), column.take(pa.array(hits)).to_pylist()):
        spans[i] = pattern_spans(text)
    inside = np.concatenate([[False], _KEY[raw], [False]])
    begins = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    cut = offsets[1:-1]  # a run may not pass from one text to the next
    crossed = cut[(cut > 0) & (cut < len(raw))]
    crossed = np.unique(crossed[_KEY[raw[crossed]] & _KEY[raw[crossed - 1]]]) if len(crossed) else crossed
    begins, ends = np.sort(np.concatenate([begins, crossed])), np.sort(np.concatenate([ends, crossed]))
    long = ends - begins >= LEAST
    low, high = begins[long].astype(np.int64), ends[long].astype(np.int64)
    digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
    some = (digits[high] > digits[low]) | (high - low >= LEAST_PLAIN)
    low, high = low[some], high[some]
    doc = np.searchsorted(offsets, low, side="right") - 1
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    base = points[offsets[doc]]
    start, end = points[low] - base, points[high] - base
    label = np.zeros(len(low), np.int64)
    for i in np.flatnonzero([bool(spans[d]) for d in doc.tolist()]):
        label[i] = next((k + 1 for s, k, e in spans[doc[i]] if s < end[i] and e > start[i]), 0)
    return Candidates(raw, doc, start, end, low, high, offsets[doc].astype(np.int64), offsets[doc + 1].astype(np.int64), label), spans


@dataclass
class Windows:
    """Character codes of candidates in context, one after another, with where each begins and its candidate lies."""

    codes: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    lengths: np.ndarray = field(init=False)

    def __post_init__(self):
        self.lengths = np.searchsorted(_LENGTHS, self.high - self.low, side="right")

    @staticmethod
    def of(parts: list[bytes], low: np.ndarray, high: np.ndarray) -> Windows:
        """``low`` and ``high`` bound the candidate inside its window."""
        sizes = np.array([len(p) for p in parts], np.int64)
        # Every region of a window has a position, be it padding; a filter sees two of them on both sides.
        padded = sizes + WIDTH + 1
        at = np.cumsum(padded) - padded
        codes = np.full(int(padded.sum()), _PAD, np.int64)
        place = np.repeat(at + WIDTH // 2 + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        codes[place] = _CODE[np.frombuffer(b"".join(parts), np.uint8)]
        return Windows(codes, at, low + at + WIDTH // 2 + 1, high + at + WIDTH // 2 + 1)

    def regions(self, total: int) -> np.ndarray:
        """First positions of what lies before, in and after each candidate; a filter's centres stay inside the window."""
        return np.stack([self.at + WIDTH // 2, self.low, self.high], axis=1).ravel()


class Network:
    """Filters over characters, the largest answer of each before, in and after the candidate, and a softmax."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.2, (WIDTH, _CODES, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.dense = rng.normal(0, 0.1, (3 * FILTERS, CLASSES))
        self.by_length = np.zeros((len(_LENGTHS) + 1, CLASSES))

    def parameters(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.dense, self.by_length]

    def pooled(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Pooled answers ``(candidates, 3 * FILTERS)``, and every filter's answer at every position."""
        n = len(w.codes)
        z = np.broadcast_to(self.bias, (n, FILTERS)).copy()
        for k in range(WIDTH):
            shift = k - WIDTH // 2
            low, high = max(0, -shift), min(n, n - shift)
            z[low:high] += self.filters[k][w.codes[low + shift:high + shift]]
        best = np.maximum.reduceat(z, w.regions(n), axis=0)
        return np.maximum(best, 0).reshape(len(w.at), 3 * FILTERS), z

    def logits(self, w: Windows) -> np.ndarray:
        return self.pooled(w)[0] @ self.dense + self.by_length[w.lengths]

    def scores(self, parts: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """``(candidates, kinds)``: log odds of each kind; a few candidates at a time, long ones whole."""
        out = np.zeros((len(parts), len(KINDS)))
        sizes = np.cumsum([len(p) for p in parts])
        i = 0
        while i < len(parts):
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + POSITIONS)))
            z = self.logits(Windows.of(parts[i:j], low[i:j], high[i:j]))
            for k in range(len(KINDS)):
                rest = np.delete(z, k + 1, axis=1)
                top = rest.max(1)
                out[i:j, k] = z[:, k + 1] - top - np.log(np.exp(rest - top[:, None]).sum(1))
            i = j
        return out


def _gradients(net: Network, w: Windows, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    pooled, z = net.pooled(w)
    out = pooled @ net.dense + net.by_length[w.lengths]
    p = np.exp(out - out.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    g_out = (p - target) * weight[:, None]
    g_pooled = ((g_out @ net.dense.T) * (pooled > 0)).reshape(-1, FILTERS)
    first = w.regions(len(w.codes))
    region = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w.codes))))
    answers, best = np.ascontiguousarray(z[first[0]:].T), np.maximum.reduceat(z, first, axis=0)
    g_filters = np.zeros_like(net.filters)
    for f in range(FILTERS):
        hit = np.flatnonzero(answers[f] == best[region, f])
        owner = region[hit]
        lead = np.concatenate([[True], owner[1:] != owner[:-1]])  # of equal answers the first one
        hit, g = hit[lead] + first[0], g_pooled[owner[lead], f]
        for k in range(WIDTH):
            at = np.clip(hit + k - WIDTH // 2, 0, len(w.codes) - 1)
            g_filters[k, :, f] = np.bincount(w.codes[at], weights=g, minlength=_CODES)
    g_length = np.zeros_like(net.by_length)
    np.add.at(g_length, w.lengths, g_out)
    return [g_filters + DECAY * net.filters, g_pooled.sum(0), pooled.T @ g_out + DECAY * net.dense, g_length + DECAY * net.by_length]


def fit(parts: list[bytes], low: np.ndarray, high: np.ndarray, label: np.ndarray) -> Network:
    """Adam over small batches, each class weighing the same; start and order are fixed, so one sample gives one network."""
    net, rng = Network(), np.random.default_rng(11)
    n = np.bincount(label, minlength=CLASSES)
    weight = len(label) * (1.0 / np.maximum(n, 1))[label] / max(1, int((n > 0).sum()))
    target = np.eye(CLASSES)[label]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, STEPS + 1):
        some = np.sort(rng.choice(len(label), min(BATCH, len(label)), replace=False))
        w = Windows.of([parts[i] for i in some], low[some], high[some])
        gradients = _gradients(net, w, target[some], weight[some] / len(some))
        for value, g, (m, v) in zip(net.parameters(), gradients, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value -= RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


@dataclass
class Scanner:
    """The network, and for each kind its calibration ``(slope, offset)`` and threshold of the score (infinite: adds nothing)."""

    network: Network | None
    calibration: list[tuple[float, float]]
    thresholds: list[float]
    recall: list[float]

    def probability(self, scores: np.ndarray, kind: int) -> np.ndarray:
        slope, offset = self.calibration[kind]
        return 1 / (1 + np.exp(-np.clip(slope * scores + offset, -40, 40)))

    def added(self, c: Candidates, spans: list) -> list[tuple[int, int, int, int]]:
        """``(text, start, kind, end)`` of unlabelled candidates whose most probable kind passes its threshold."""
        free = np.flatnonzero(c.label == 0)
        if self.network is None or not len(free) or not np.isfinite(self.thresholds).any():
            return []
        low, high = (x[free] for x in c.windows())
        scores = self.network.scores(c.texts(low, high), c.low[free] - low, c.high[free] - low)
        chance = np.stack([self.probability(scores[:, k], k) for k in range(len(KINDS))], axis=1)
        kind = chance.argmax(1)
        ok = (scores[np.arange(len(free)), kind] >= np.array(self.thresholds)[kind]) & (chance.max(1) >= PROBABLE)
        return [(int(c.doc[i]), int(c.start[i]), int(k), int(c.end[i])) for i, k in zip(free[ok], kind[ok])]


def _held_back(values: list[bytes]) -> np.ndarray:
    """A quarter of the candidates by their own text, so that copies stay together."""
    import zlib

    return np.array([zlib.crc32(v) % 4 == 0 for v in values], bool)


def _sample(rows: DataFrame) -> DataFrame:
    """``(label, window, low, high)`` of training candidates, each different window once, the first by their hash.

    Every task keeps what can still be among the first; the choice between tasks is Spark's.
    """
    def run(batches):
        import xxhash

        for b in batches:
            for _, part in slices(b.column(0), SLICE_BYTES):
                c, _ = find(part)
                low, high = c.windows()
                parts = c.texts(low, high)
                seen = {}
                for i in np.flatnonzero(~_held_back(c.texts(c.low, c.high))).tolist():
                    seen.setdefault((int(c.label[i]), xxhash.xxh64_intdigest(parts[i]) >> 1), i)
                for label in range(CLASSES):
                    own = sorted(k for k in seen if k[0] == label)[:MAX_FINDINGS if label else MAX_OTHERS]
                    at = [seen[k] for k in own]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label] * len(at), pa.int32()), pa.array([k[1] for k in own], pa.int64()), pa.array([parts[i] for i in at], pa.binary()),
                         pa.array((c.low - low)[at], pa.int32()), pa.array((c.high - low)[at], pa.int32())], ["label", "h", "window", "low", "high"])

    found = stored(rows.mapInArrow(run, "label int, h long, window binary, low int, high int"), "candidates")
    kept = [found.where(F.col("label") == k).groupBy("h").agg(*[F.min(F.struct("window", "low", "high")).alias("x")]).orderBy("h")
            .limit(MAX_FINDINGS if k else MAX_OTHERS).select(F.lit(k).alias("label"), "h", "x.*") for k in range(CLASSES)]
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def _score_counts(rows: DataFrame, net: Network) -> np.ndarray:
    """Counts ``(kind, finding or not, score bin)`` of all held-back candidates of the corpus."""
    def run(batches):
        total = np.zeros((len(KINDS), 2, BINS), np.int64)
        for b in batches:
            for _, part in slices(b.column(0), SLICE_BYTES):
                c, _ = find(part)
                some = np.flatnonzero(_held_back(c.texts(c.low, c.high)))
                if not len(some):
                    continue
                low, high = (x[some] for x in c.windows())
                scores = net.scores(c.texts(low, high), c.low[some] - low, c.high[some] - low)
                bins = np.clip(np.floor(scores / BIN) + BINS // 2, 0, BINS - 1).astype(np.int64)
                for k in range(len(KINDS)):
                    for side, own in enumerate((c.label[some] != k + 1, c.label[some] == k + 1)):
                        total[k, side] += np.bincount(bins[own, k], minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    found = rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(KINDS) * 2 * BINS, np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(len(KINDS), 2, BINS)


def calibrate(counts: np.ndarray) -> tuple[tuple[float, float], float, float]:
    """``((slope, offset), threshold, recall)`` of one kind from its counts ``(finding or not, bin)``.

    The slope and offset are those of the logistic curve of least loss over the bins.  The
    threshold is the highest lower edge of a bin that keeps ``RECALL`` of the findings; with
    fewer than ``ENOUGH`` findings there is none.
    """
    no, yes = counts.astype(float)
    x = (np.arange(BINS) - BINS // 2 + 0.5) * BIN
    slope, offset = 1.0, 0.0
    # Platt's targets keep the curve finite where the classes do not overlap.
    up, down = (yes.sum() + 1) / (yes.sum() + 2), 1 / (no.sum() + 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -40, 40)))
        g = yes * (p - up) + no * (p - down)
        h = (yes + no) * p * (1 - p) + 1e-9
        a = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(a, [(g * x).sum() + 1e-3 * (slope - 1), g.sum()])
        size = np.abs(move).max()
        slope, offset = (slope, offset) - move * min(1.0, 1.0 / max(size, 1e-12))
        if size < 1e-9:
            break
    if yes.sum() < ENOUGH:
        return (float(slope), float(offset)), np.inf, 0.0
    kept = yes[::-1].cumsum()[::-1] / yes.sum()
    cut = int(np.flatnonzero(kept >= RECALL)[-1])
    return (float(slope), float(offset)), (cut - BINS // 2) * BIN if cut else -np.inf, float(kept[cut])


def learn(docs: DataFrame, text_col: str = "text") -> Scanner:
    """Fit on a bounded sample of labelled candidates, calibrate on all held-back ones of the corpus."""
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = _sample(rows).orderBy("label", "h").toArrow()
    label = sample["label"].to_numpy().astype(np.int64)
    if not (label > 0).any():
        return Scanner(None, [(1.0, 0.0)] * len(KINDS), [np.inf] * len(KINDS), [0.0] * len(KINDS))
    net = fit(sample["window"].to_pylist(), sample["low"].to_numpy().astype(np.int64), sample["high"].to_numpy().astype(np.int64), label)
    found = [calibrate(c) for c in _score_counts(rows, net)]
    return Scanner(net, *[list(x) for x in zip(*found)])


def find_secrets(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, added)``: arrays of ``(start, kind, end)`` of every whole text, each sorted.

    Null texts count as empty and have no spans; repeated rows are scanned each; an empty table
    gives no rows.  Without a ``scanner`` one is learned from the texts.
    """
    scanner = scanner or learn(docs, text_col)
    rows = texts(docs, id_col, text_col)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()),
                                     T.StructField("end", T.IntegerType())]))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("base", span), T.StructField("added", span)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in slices(b.column(1), SLICE_BYTES):
                c, spans = find(part)
                more: list[list[dict]] = [[] for _ in spans]
                for d, start, k, end in scanner.added(c, spans):
                    more[d].append({"start": start, "kind": KINDS[k], "end": end})
                base = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in x] for x in spans]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(part)), pa.array(base, kind), pa.array(more, kind)], schema.names)

    return rows.mapInArrow(run, schema)


def digest(spans: DataFrame) -> DataFrame:
    """Counts of the pattern spans, the hash of their list, and the list of all spans."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])

    def listed(column):
        ordered = F.array_sort(F.transform(column, lambda x: F.struct(
            x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return spans.select(
        "doc_id", *[F.size(F.filter("base", lambda x: x["kind"] == F.lit(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"))
