"""Active-timeout cuts as a scan over time slices.

A slice no longer than the timeout is a function of the flow that is open when it begins: the
flow ends at the first packet at or behind its deadline, and the packet after that starts the
next one, whose deadline lies behind the slice.  Such a function is a step function of the
deadline, so functions of neighbouring slices compose into one of the same form.  Blocks of
``FAN`` slices are composed, then blocks of blocks, until one block holds a pair; the open flow
is then handed down again.  Rounds grow with the logarithm of the number of slices, and no task
holds more than the packets of ``FAN`` slices, whatever the size of a segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.plans.bounded import localized
from flowlake.session import cut_lineage

#: Neighbouring functions that one task composes.
FAN_BITS = 4
#: Kinds of rows: a step (deadlines up to ``key`` lead to the mark), the one result of a slice in which
#: a segment starts, what an awaited start becomes (``key``: first time), and the state a block begins with.
STEP, ALWAYS, AWAITED, ENTERS = range(4)
_MARK = ["us", "ord", "from_a"]
_ROW = "blk long, kind int, key long, us long, ord long, from_a boolean"


@dataclass
class Marks:
    """Open flows: time, arrival and side of their first packet; where not ``known`` the next packet starts one."""

    us: np.ndarray
    ord: np.ndarray
    from_a: np.ndarray
    known: np.ndarray

    def take(self, at) -> Marks:
        return Marks(self.us[at], self.ord[at], self.from_a[at], self.known[at])

    def join(self, other: Marks) -> Marks:
        return Marks(*(np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("us", "ord", "from_a", "known")))

    @staticmethod
    def of(table: pa.Table) -> Marks:
        columns = [table[c].combine_chunks() for c in _MARK]
        known = columns[0].is_valid().to_numpy(zero_copy_only=False)
        return Marks(*(c.fill_null(False if pa.types.is_boolean(c.type) else 0).to_numpy(zero_copy_only=False) for c in columns), known)

    @staticmethod
    def awaited() -> Marks:
        return Marks(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, bool), np.zeros(1, bool))

    def arrays(self) -> list[pa.Array]:
        return [pa.array(getattr(self, c), mask=~self.known) for c in _MARK]


@dataclass
class Steps:
    """The function of a slice or a block: open flow in, open flow out."""

    keys: np.ndarray
    outs: Marks
    always: Marks | None
    awaited: Marks | None
    first_us: int

    def cut(self, state: Marks, active_us: int) -> tuple[np.ndarray, Marks]:
        """Which states are cut here, and the starts that follow their cuts."""
        at = np.searchsorted(self.keys, state.us + active_us)
        hit = state.known & (at < len(self.keys))
        return hit, self.outs.take(at[hit])

    def __call__(self, state: Marks, active_us: int) -> Marks:
        if self.always is not None:
            return self.always.take(np.zeros(len(state.us), np.int64))
        hit, outs = self.cut(state, active_us)
        out = state.take(np.arange(len(state.us)))
        for c in ("us", "ord", "from_a", "known"):
            value = getattr(out, c)
            value[~state.known] = getattr(self.awaited, c)[0]
            value[hit] = getattr(outs, c)
        return out

    def then(self, later: Steps, active_us: int) -> Steps:
        """This function, then that of the slices behind it."""
        if later.always is not None:
            return Steps(self.keys[:0], self.outs.take(slice(0, 0)), later.always, None, self.first_us)
        if self.always is not None:
            return Steps(self.keys, self.outs, later(self.always, active_us), None, self.first_us)
        keys, outs = self.keys, later(self.outs, active_us)
        # A flow open at the beginning has its deadline within the timeout, so later steps are out of its reach.
        if not len(keys) or keys[-1] < self.first_us + active_us:
            keys, outs = np.concatenate([keys, later.keys]), outs.join(later.outs)
        return Steps(keys, outs, None, later(self.awaited, active_us), self.first_us)


@dataclass
class _Group:
    """The rows of some neighbouring blocks, in order: of block ``blk[i]`` the steps are ``low[i]:high[i]``, then one more row."""

    blk: list[int]
    low: list[int]
    high: list[int]
    always: list[bool]
    key: np.ndarray
    marks: Marks

    @staticmethod
    def of(table: pa.Table) -> _Group:
        kind, blk, key = (table[c].combine_chunks().fill_null(0).to_numpy() for c in ("kind", "blk", "key"))
        order = np.lexsort((key, kind, blk))
        order = order[kind[order] != ENTERS]
        kind, blk, key, marks = kind[order], blk[order], key[order], Marks.of(table).take(order)
        last = np.flatnonzero(kind != STEP)
        return _Group(blk[last].tolist(), [0, *(last[:-1] + 1).tolist()], last.tolist(), (kind[last] == ALWAYS).tolist(), key, marks)

    def steps(self, i: int) -> Steps:
        low, n = self.low[i], self.high[i]
        rest = self.marks.take(slice(n, n + 1))
        return Steps(self.key[low:n], self.marks.take(slice(low, n)), rest if self.always[i] else None,
                     None if self.always[i] else rest, int(self.key[n]))


def _rows(head: list, blk: int, kind: int, keys: np.ndarray | None, marks: Marks) -> pa.Table:
    n = len(marks.us)
    columns = [pa.array([v] * n, t) for v, t in head] + [
        pa.array(np.full(n, blk), pa.int64()), pa.array(np.full(n, kind), pa.int32()),
        pa.array(keys, pa.int64()) if keys is not None else pa.nulls(n, pa.int64()), *marks.arrays()]
    return columns


def _table(parts: list[list[pa.Array]], names: list[str]) -> pa.Table:
    return pa.table([pa.chunked_array([p[i] for p in parts]) for i in range(len(names))], names)


def _composed(rows: DataFrame, pair: list[str], active_us: int) -> DataFrame:
    """The functions of blocks of ``2 ** FAN_BITS`` neighbours."""
    names = [*pair, "blk", "kind", "key", *_MARK]

    def run(table: pa.Table) -> pa.Table:
        head = [(table[c][0].as_py(), table.schema.field(c).type) for c in pair]
        group = _Group.of(table)
        # What lies before the last block with one result does not matter.
        first = max((i for i, only in enumerate(group.always) if only), default=0)
        whole = group.steps(first)
        whole.first_us = int(group.key[group.high[0]])
        for i in range(first + 1, len(group.blk)):
            whole = whole.then(group.steps(i), active_us)
        blk = group.blk[0] >> FAN_BITS
        if whole.always is not None:
            return _table([_rows(head, blk, ALWAYS, np.array([whole.first_us]), whole.always)], names)
        return _table([_rows(head, blk, STEP, whole.keys, whole.outs), _rows(head, blk, AWAITED, np.array([whole.first_us]), whole.awaited)], names)

    grouped = _dealt(rows.withColumn("sup", F.shiftright("blk", FAN_BITS)), pair).groupBy(*pair, "sup")
    return grouped.applyInArrow(run, _schema(rows, pair, _ROW))


def _handed_down(rows: DataFrame, entering: DataFrame, pair: list[str], active_us: int) -> DataFrame:
    """The state that each block of ``rows`` begins with, and, as a step row, the start after a cut inside it."""
    names = [*pair, "blk", "kind", "key", *_MARK]

    def run(table: pa.Table) -> pa.Table:
        head = [(table[c][0].as_py(), table.schema.field(c).type) for c in pair]
        group, begins = _Group.of(table), table.filter(pc.equal(table["kind"], ENTERS))
        us, order, side, known = (x.tolist() for x in (group.marks.us, group.marks.ord, group.marks.from_a, group.marks.known))

        def mark(i):
            return (us[i], order[i], side[i]) if known[i] else None

        state = tuple(begins[c][0].as_py() for c in _MARK)
        state = None if state[0] is None else state
        out = []
        for blk, low, high, only in zip(group.blk, group.low, group.high, group.always):
            out.append((blk, ENTERS, state))
            at = low + int(np.searchsorted(group.key[low:high], state[0] + active_us)) if state else high
            if at < high:
                out.append((blk, STEP, mark(at)))
            if only or not state or at < high:
                state = mark(high) if only or not state else mark(at)
        n = len(out)
        marks = [[None if m is None else m[k] for _, _, m in out] for k in range(3)]
        return pa.table([*[pa.array([v] * n, t) for v, t in head], pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()),
                         pa.nulls(n, pa.int64()), pa.array(marks[0], pa.int64()), pa.array(marks[1], pa.int64()), pa.array(marks[2], pa.bool_())], names)

    both = rows.withColumn("sup", F.shiftright("blk", FAN_BITS)).unionByName(entering.withColumn("sup", F.col("blk")))
    return _dealt(both, pair).groupBy(*pair, "sup").applyInArrow(run, _schema(rows, pair, _ROW))


def _dealt(rows: DataFrame, pair: list[str]) -> DataFrame:
    """Dealt out by group into as many tasks as a shuffle has: small rows here stand for much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *pair, "sup")


def _schema(rows: DataFrame, pair: list[str], rest: str) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join([*[f"{c} {kinds[c]}" for c in pair], rest])


def active_starts(packets: DataFrame, slices: DataFrame, pair: list[str], active_us: int) -> DataFrame | None:
    """``(pair, slice, c_active, c_cut)``: the flow open at the beginning of a slice, the first one of the slice where
    it starts with it, and the start that follows an active cut inside it; None where no flow lasts that long.

    ``packets`` has ``(pair, slice, us, _m, _prev, _next, _cut_in)``, ``slices`` ``(pair, slice, first,
    c_first, c_seg, c_out)`` with the first packet, the segment that starts with it, the segment open before,
    and the last segment that starts inside.  A slice may not be longer than ``active_us``.
    """
    key = [*pair, "slice"]
    # Only packets an active timeout behind their segment's first one can end a flow; of one time the first does.
    due = cut_lineage(packets.join(slices.select(*key, "c_first", "c_seg"), key).where(
        F.col("_cut_in").isNull() & F.col("c_first").isNull() & (F.col("us") - F.col("c_seg.us") >= active_us)
        & F.coalesce(F.col("_prev.us") != F.col("us"), F.lit(True)))
        .select(*key, F.col("us").alias("key"), *[F.col(f"_next.{c}").alias(c) for c in _MARK]))
    pairs = localized(due.select(*pair).distinct())
    if not pairs.take(1):
        return None
    own = slices.join(pairs, pair, "left_semi").withColumn(
        "blk", (F.row_number().over(Window.partitionBy(*pair).orderBy("slice")) - 1).cast("long"))
    own = cut_lineage(own.select(*key, "blk", "first", "c_first", "c_out"))

    def marked(rows: DataFrame, kind: int, at, mark: str) -> DataFrame:
        return rows.select(*pair, "blk", F.lit(kind).alias("kind"), at.alias("key"), *[F.col(f"{mark}.{c}").alias(c) for c in _MARK])

    steps = due.join(own.select(*key, "blk"), key).select(*pair, "blk", F.lit(STEP).alias("kind"), "key", *_MARK)
    level = cut_lineage(steps.unionByName(marked(own.where("c_out is not null"), ALWAYS, F.col("first.us"), "c_out"))
                        .unionByName(marked(own.where("c_out is null"), AWAITED, F.col("first.us"), "first")))
    levels, last = [level], own.agg(F.max("blk")).first()[0]
    while last >> FAN_BITS:
        levels.append(cut_lineage(_composed(levels[-1], pair, active_us)))
        last >>= FAN_BITS
    null = {"key": "long", "us": "long", "ord": "long", "from_a": "boolean"}
    state = pairs.select(*pair, F.lit(0).cast("long").alias("blk"), F.lit(ENTERS).alias("kind"),
                         *[F.lit(None).cast(t).alias(c) for c, t in null.items()])
    for rows in reversed(levels):
        state = cut_lineage(_handed_down(rows, state.where(F.col("kind") == ENTERS), pair, active_us))
    mark = F.when(F.col("us").isNotNull(), F.struct(*_MARK))
    found = state.groupBy(*pair, "blk").agg(F.max(F.when(F.col("kind") == ENTERS, mark)).alias("state"),
                                            F.max(F.when(F.col("kind") == STEP, mark)).alias("c_cut"))
    return own.join(found, [*pair, "blk"]).select(
        *key, F.when(F.col("c_first").isNull(), F.coalesce("state", "first")).alias("c_active"), "c_cut")
