"""Best-fit packing of token pieces into sequences of a fixed length.

The packing problem is a covering programme over *configurations* (how many pieces of each
length share a sequence), and its data is only the histogram of lengths.  Multiplicative weights
price the lengths, a knapsack dynamic programme finds the most valuable configuration at these
prices, and lengths that lag behind become dearer.  The fractional solution is rounded down, the programme
is solved again for the remainder, and the last of it is packed by best fit.  All of this is work
on the histogram, whatever the size of the input.  Pieces then get their places from their rank among pieces of their length; no group of pieces is ever gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import slices, stored, texts
from flowlake.llm.tokens import default_path, encoder

#: Pricing rounds of the multiplicative weights in the first programme.
ROUNDS = 16
#: Share of all tokens that is left to best fit alone.
LAST = 0.01
#: How strongly a lag in coverage raises a price.
RATE = 4.0
#: Texts encoded in one pass, in bytes.
SLICE_BYTES = 2 << 20


def cut_pieces(docs: DataFrame, size: int, tokenizer: str | None = None, end_id: int = 0,
               id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` and, if asked for, ``ids``.

    A document is its ids and ``end_id``.  One longer than ``size`` is cut into pieces of
    ``size``; what is left over is the first piece.  Null text counts as empty.
    """
    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(*_cutting(rows, size, tokenizer or default_path(), end_id, with_ids))


def _cutting(rows: DataFrame, size: int, tokenizer: str, end_id: int, with_ids: bool) -> tuple[Callable, T.StructType]:
    """The map of :func:`cut_pieces` and its schema."""
    fields = [T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * with_ids

    def run(batches):
        for b in batches:
            for first, column in slices(b.column(1), SLICE_BYTES):
                ids, n = encoder(tokenizer).encode(column)
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4", copy=False)
                n = n + 1
                count = -(-n // size)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                head = n - (count - 1) * size
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * size)
                length = np.where(piece == 0, head[doc], size)
                at = (np.cumsum(n) - n)[doc] + start
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(at, at + length)]
                out = [b.column(0).slice(first, len(column)).take(pa.array(doc)), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()),
                                                        pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    return run, T.StructType(fields)


def _values(lengths: np.ndarray, price: np.ndarray, size: int) -> np.ndarray:
    """Knapsack by dynamic programming: worth of the dearest pieces that fill each room, -inf where none do."""
    value = np.full(size + 1, -np.inf)
    value[0] = 0.0
    upto = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for c in range(1, size + 1):
        k = upto[c]
        if k:
            value[c] = (value[c - lengths[:k]] + price[:k]).max()
    return value


def _configuration(own: int, room: int, value: np.ndarray, lengths: np.ndarray, price: np.ndarray,
                   left: np.ndarray, least: float) -> dict[int, int] | None:
    """The dearest way through the table for a piece of length ``own`` and pieces that fill ``room``.

    Only lengths of which ``least`` more are left are taken; None where that leads nowhere.
    """
    config = {own: 1}
    while room:
        k = int(np.searchsorted(lengths, room, side="right"))
        worth = value[room - lengths[:k]] + np.where(left[:k] >= least, price[:k], -np.inf)
        for i, n in config.items():
            if i < k and left[i] < least * (n + 1):
                worth[i] = -np.inf
        if not k or worth[best := int(worth.argmax())] == -np.inf:
            return None
        config[best] = config.get(best, 0) + 1
        room -= int(lengths[best])
    return config


def solve_programme(lengths: np.ndarray, demand: np.ndarray, size: int, rounds: int = ROUNDS,
                    rate: float = RATE, whole: bool = False) -> list[tuple[dict[int, int], float]]:
    """Covering of ``demand``: pairs of a configuration, ``{index of a length: pieces}``, and how often it is used.

    Round ``k`` of ``rounds`` brings every length to the share ``k / rounds`` of its demand, the
    dearest first, each by the dearest configuration that holds it.  The knapsack is solved at the
    prices a round begins with; a price falls as soon as a configuration serves its length.
    Sequences are filled to the end as long as any configuration does that, then as far as possible.
    ``whole`` uses configurations whole times.
    """
    demand = demand.astype(float)
    left, out, least = demand.copy(), {}, 1.0 if whole else 1e-6
    for k in range(1, rounds + 1):
        behind = 1 - k / rounds
        price = lengths / size * np.exp(rate * (left / demand - behind))
        value = _values(lengths, np.where(left >= least, price, -np.inf), size)
        room = size - lengths
        if not (value[room] > -np.inf)[left >= least].any():
            room = np.maximum.accumulate(np.where(value > -np.inf, np.arange(size + 1), 0))[room]
        for own in np.argsort(-price, kind="stable").tolist():
            while left[own] - behind * demand[own] >= least and value[room[own]] > -np.inf:
                config = _configuration(own, int(room[own]), value, lengths, price, left, least)
                if config is None:
                    break
                wanted = (left[own] - behind * demand[own]) / config[own]
                often = min(wanted, *(left[i] / n for i, n in config.items()))
                often = max(np.floor(often), 1.0) if whole else often
                for i, n in config.items():
                    left[i] = max(left[i] - n * often, 0.0)
                    price[i] = lengths[i] / size * np.exp(rate * (left[i] / demand[i] - behind))
                key = tuple(sorted(config.items()))
                out[key] = out.get(key, 0.0) + often
    return [(dict(key), often) for key, often in out.items()]


def best_fit(lengths: np.ndarray, left: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    """Best fit of what is left, longest first, on counts: ``(pieces of each length, how often)``."""
    open_bins: dict[int, list[tuple[dict[int, int], int]]] = {}
    for i in np.argsort(-lengths):
        length, n = int(lengths[i]), int(left[i])
        for free in sorted(f for f in open_bins if f >= length):
            if not n:
                break
            bins, k = open_bins.pop(free), free // length
            rest = []
            while bins and n:
                config, often = bins.pop()
                whole = min(often, n // k)
                if whole:
                    open_bins.setdefault(free - k * length, []).append(({**config, length: k}, whole))
                    n, often = n - whole * k, often - whole
                if often and 0 < n < k:
                    open_bins.setdefault(free - n * length, []).append(({**config, length: n}, 1))
                    n, often = 0, often - 1
                if often:
                    rest.append((config, often))
            if bins or rest:
                open_bins.setdefault(free, []).extend(bins + rest)
        k = size // length
        if n // k:
            open_bins.setdefault(size - k * length, []).append(({length: k}, n // k))
        if n % k:
            open_bins.setdefault(size - n % k * length, []).append(({length: n % k}, 1))
    return [x for bins in open_bins.values() for x in bins]


@dataclass
class Layout:
    """Where the piece of a given length and rank lies; at most some thousand entries for any input."""

    length: np.ndarray
    rank: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int
    programme_pieces: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.empty(len(length), np.int64)
        for x in np.unique(length):
            here = length == x
            low, high = np.searchsorted(self.length, [x, x + 1])
            found[here] = low + np.searchsorted(self.rank[low:high], rank[here], side="right") - 1
        within = rank - self.rank[found]
        return (self.sequence[found] + within // self.copies[found],
                self.offset[found] + within % self.copies[found] * length)


def plan_layout(lengths: np.ndarray, demand: np.ndarray, size: int, rounds: int = ROUNDS) -> Layout:
    """Configurations for the whole histogram, rounded down, then for what is left, and so on.

    Each programme on what is left has half the rounds of the one before, so its shares are larger
    and less is lost by rounding down; the last ones have a single round.  Best fit packs what no
    configuration takes, at the latest what is less than ``LAST`` of all.  Of these layouts, that
    of the fewest sequences is kept, the one with the most pieces from programmes among equals.
    """
    order = np.argsort(lengths)
    lengths, demand = np.asarray(lengths, np.int64)[order], np.asarray(demand, np.int64)[order]
    left, taken = demand.copy(), []
    total = int((lengths * demand).sum())
    chosen = best_fit(lengths, left, size)
    fewest, by_programme = sum(n for _, n in chosen), 0
    while (lengths * left).sum() > LAST * total:
        before, alive = len(taken), np.flatnonzero(left)
        for config, often in solve_programme(lengths[alive], left[alive], size, rounds, whole=rounds == 1):
            config = {int(alive[i]): k for i, k in config.items()}
            n = min(int(often + 1e-6), *(int(left[i]) // k for i, k in config.items()))
            if n > 0:
                for i, k in config.items():
                    left[i] -= k * n
                taken.append(({int(lengths[i]): k for i, k in config.items()}, n))
        if len(taken) == before and rounds == 1:
            break
        if len(taken) > before:
            rest = best_fit(lengths, left, size)
            n = sum(n for _, n in taken) + sum(n for _, n in rest)
            if n <= fewest:
                fewest, chosen, by_programme = n, taken + rest, int((demand - left).sum())
        rounds = max(rounds // 2, 1)
    entries, next_rank, sequence = [], dict.fromkeys(lengths.tolist(), 0), 0
    for config, often in chosen:
        offset = 0
        for x, k in sorted(config.items(), reverse=True):
            entries.append((x, next_rank[x], k, sequence, offset))
            next_rank[x] += k * often
            offset += k * x
        sequence += often
    table = np.array(sorted(entries), np.int64).reshape(-1, 5)
    return Layout(*table.T.copy(), sequence, by_programme)


def _numbering(pieces: T.StructType) -> tuple[Callable, T.StructType]:
    """A map that adds ``_part`` (the task) and ``_nth`` (the row's number in it among rows of its length), and its schema."""
    at = pieces.names.index("length")
    schema = T.StructType([*pieces.fields, T.StructField("_part", T.LongType()), T.StructField("_nth", T.LongType())])

    def run(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            length = b.column(at).to_numpy()
            nth = np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, first, n = np.unique(length[order], return_index=True, return_counts=True)
            nth[order] = np.arange(len(length)) - np.repeat(first, n)
            nth += np.repeat([seen.get(x, 0) for x in values.tolist()], n)[np.argsort(order)] if len(length) else 0
            for x, k in zip(values.tolist(), n.tolist()):
                seen[x] = seen.get(x, 0) + k
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(length), part), pa.int64()), pa.array(nth)], schema.names)

    return run, schema


def pack_documents(docs: DataFrame, size: int, tokenizer: str | None = None, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """:func:`pack` of :func:`cut_pieces`, cut and numbered in one Python worker for each task instead of two."""
    rows = texts(docs, id_col, text_col)
    cut, schema = _cutting(rows, size, tokenizer or default_path(), end_id, with_ids)
    number, numbered = _numbering(schema)
    return _packed(rows.mapInArrow(lambda batches: number(cut(batches)), numbered), size, rounds)


def pack(pieces: DataFrame, size: int, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every piece in one sequence, without gaps or overlaps.

    ``length`` must be 1 to ``size``.  The pieces are stored once, so the programme and the
    places see the same rows.  An empty table gives an empty result; equal rows get places of their own.
    """
    return _packed(pieces.mapInArrow(*_numbering(pieces.schema)), size, rounds)


def _packed(numbered: DataFrame, size: int, rounds: int) -> DataFrame:
    pieces = T.StructType(numbered.schema.fields[:-2])
    rows = stored(numbered, "pieces")
    counts = rows.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    hist = rows.groupBy("length").agg(F.count("*").alias("n")).toArrow()  # at most one row per length
    lengths, demand = hist["length"].to_numpy(), hist["n"].to_numpy()
    if len(lengths) and not 1 <= lengths.min() <= lengths.max() <= size:
        raise ValueError(f"lengths {lengths.min()} to {lengths.max()} do not fit 1 to {size}")
    layout = plan_layout(lengths, demand, size, rounds)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = rows.join(firsts, ["_part", "length"]).select(
        *pieces.names, (F.col("_first") + F.col("_nth")).alias("_rank"))
    schema = T.StructType([*pieces.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = pieces.names.index("length")

    def run(batches):
        for b in batches:
            if b.num_rows:
                where, offset = layout.place(b.column(at).to_numpy(), b.column(b.num_columns - 1).to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(where, pa.int64()), pa.array(offset, pa.int64())], schema.names)

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of packed pieces that carry ``ids``; a sequence holds at most its fixed length."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
