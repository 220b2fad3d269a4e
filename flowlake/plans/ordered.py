"""Order statistics and running totals that never gather a group in one task.

A window over ``partitionBy(group)`` sorts a whole group in one task, which fails as soon
as one file, label or key holds a large share of the rows.  The two shapes here need only
small aggregates per group:

* :func:`rank_cuts` finds the order value of the row at a given rank.  "The first k rows of
  each group" is then a comparison with a broadcast value, and no row is shuffled.
* :func:`running_before` splits each group into ordered buckets, totals the buckets, and
  adds the total of the earlier buckets to a running sum inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.plans.bounded import localized, localized_table

#: ``row_ord`` is dense inside a file split, so ``row_ord >> 20`` holds at most 2**20 rows.
ROW_SHIFT = 20
#: 64-bit hashes: 4096 chunks per group, refined further only where a chunk is large.
HASH_SHIFT = 52
MAX_CHUNK_ROWS = 1 << 20
_REFINE_BITS = 12
_BEFORE_ALL = -(1 << 63)


def order_value(order: Sequence[str]) -> Column:
    """The order columns as one comparable value."""
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])


def chunk_counts(df: DataFrame, group: Sequence[str], order: Sequence[str], shift: int) -> DataFrame:
    """Rows per (group, order chunk); one partially aggregated pass, no row moves."""
    return localized(
        df.groupBy(*group, F.shiftright(F.col(order[0]), shift).alias("_chunk"))
          .agg(F.count("*").alias("_n")))


def rank_cuts(df: DataFrame, group: Sequence[str], order: Sequence[str], targets: DataFrame,
              shift: int, counts: DataFrame | None = None,
              max_chunk_rows: int = MAX_CHUNK_ROWS) -> DataFrame:
    """Order value of the row at each wanted rank: ``(group..., cut_id, cut)``.

    ``targets`` is ``(group..., cut_id, rank)`` with 1-based ranks; a rank below 1 gives a
    cut before every row.  ``order[0]`` must be a LONG and the order columns unique per group.
    """
    group, order = list(group), list(order)
    if counts is None:
        counts = chunk_counts(df, group, order, shift)
    w = Window.partitionBy(*group).orderBy("_chunk")
    hit, found_rows = localized_table(
        counts.withColumn("_end", F.sum("_n").over(w))
        .join(targets, group)
        .where("rank >= 1 and rank > _end - _n and rank <= _end")
        .select(*group, "_chunk", "cut_id", F.expr("rank - (_end - _n)").alias("_within"), "_n"))
    chunk = F.shiftright(F.col(order[0]), shift)
    if found_rows is None:
        largest = hit.agg(F.max("_n")).first()[0]
    else:
        largest = max(found_rows["_n"].to_pylist(), default=None)
    rows = (df.select(*group, *order, chunk.alias("_chunk"))
              .join(hit.select(*group, "_chunk").distinct(), group + ["_chunk"], "left_semi"))
    if largest is not None and largest > max_chunk_rows and shift > 0:
        parent = f"_chunk{shift}"
        found = rank_cuts(
            rows.withColumnRenamed("_chunk", parent), group + [parent], order,
            hit.select(*group, F.col("_chunk").alias(parent), "cut_id",
                       F.col("_within").alias("rank")),
            max(shift - _REFINE_BITS, 0), max_chunk_rows=max_chunk_rows).drop(parent)
    else:
        inside = Window.partitionBy(*group, "_chunk").orderBy(*order)
        found = (rows.withColumn("_within", F.row_number().over(inside).cast("long"))
                 .join(hit.drop("_n"), group + ["_chunk", "_within"])
                 .select(*group, "cut_id", order_value(order).alias("cut")))
    kinds = dict(df.select(*order).dtypes)
    before = F.struct(*[
        (F.lit(_BEFORE_ALL) if i == 0 else F.lit(None)).cast(kinds[c]).alias(f"o{i}")
        for i, c in enumerate(order)])
    return found.unionByName(
        targets.where("rank < 1").select(*group, "cut_id", before.alias("cut")))


def cut_index(df: DataFrame, group: Sequence[str], order: Sequence[str], cuts: DataFrame,
              cut_ids: Sequence[int], out: str) -> DataFrame:
    """Add ``out`` = number of cuts of its group that lie before the row (null: no cuts)."""
    group = list(group)
    wide = localized(cuts.groupBy(*group).agg(*[
        F.max(F.when(F.col("cut_id") == i, F.col("cut"))).alias(f"_cut{i}") for i in cut_ids]))
    here = order_value(order)
    total = sum((F.when(here > F.col(f"_cut{i}"), 1).otherwise(0) for i in cut_ids), F.lit(0))
    return (df.join(wide, group, "left")
              .withColumn(out, F.when(F.col(f"_cut{cut_ids[0]}").isNotNull(), total))
              .drop(*[f"_cut{i}" for i in cut_ids]))


def running_before(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[str],
                   values: Sequence[str]) -> DataFrame:
    """Add ``before_<v>``: sum of ``v`` over the rows of the group that come earlier.

    ``bucket`` must not decrease along ``order``; it bounds how many rows one task sorts.
    """
    group = list(group)
    tagged = df.withColumn("_bucket", bucket)
    key = group + ["_bucket"]
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy(*key).agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
               .select(*key, *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0))
                               .alias(f"_off_{v}") for v in values]))
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = tagged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{v}")
                               for v in values])
    return (out.join(offsets, key)
            .select(*df.columns, *[(F.col(f"_in_{v}") + F.col(f"_off_{v}")).alias(f"before_{v}")
                                   for v in values]))
