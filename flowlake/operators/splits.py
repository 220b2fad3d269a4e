"""Train/test assignment and cross-validation folds as added columns.

No strategy moves the rows: file-based ones compare with short lists of files, position- and
hash-based ones compare each row with a cut value found by :mod:`flowlake.plans.ordered`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake import schema as S
from flowlake.functions.scalars import name
from flowlake.plans.bounded import in_lists, localized
from flowlake.plans.ordered import HASH_SHIFT, ROW_SHIFT, chunk_counts, cut_index, rank_cuts

# Seed and shares of the strategies.
SEED = 42
PER_FILE_TRAIN = 0.7
TEMPORAL_TRAIN = 0.8
HOLDOUT_FILES = 0.25
LAST_FILES = 0.2
RANDOM_TEST = 0.2

STRATEGIES = (
    "file_holdout", "per_file", "temporal", "file", "random", "mixed_holdout",
    "cross_dataset_2017to2018", "cross_dataset_2018to2017",
    "fused_2018holdout", "fused_2017holdout",
)


def _files(df: DataFrame, file: str, *more: str) -> list:
    cols = [*more, file]
    return sorted(tuple(r) for r in
                  df.select(*cols).distinct().where(name(file).isNotNull()).collect())


def holdout_files(df: DataFrame, file: str = "Source_File", seed: int = SEED) -> list[str]:
    """A quarter of the files, at least two, by seeded draw from the sorted names."""
    names = [f for (f,) in _files(df, file)]
    n = max(2, int(HOLDOUT_FILES * len(names)))
    picked = np.random.RandomState(seed).choice(len(names), size=n, replace=False)
    return sorted(names[i] for i in picked)


def mixed_holdout_files(df: DataFrame, file: str = "Source_File", dataset: str = "Dataset",
                        seed: int = SEED) -> list[str]:
    """A quarter of each data set's files, at least one each; one generator across data sets."""
    by_tag: dict[str, list[str]] = {}
    for tag, f in _files(df, file, dataset):
        if tag is not None:
            by_tag.setdefault(tag, []).append(f)
    draw = np.random.RandomState(seed)
    out: set[str] = set()
    for tag in sorted(by_tag):
        names = by_tag[tag]
        picked = draw.choice(len(names), size=max(1, int(HOLDOUT_FILES * len(names))),
                             replace=False)
        out.update(names[i] for i in picked)
    return sorted(out)


def last_files(df: DataFrame, file: str = "Source_File") -> list[str]:
    names = [f for (f,) in _files(df, file)]
    return names[-max(1, int(LAST_FILES * len(names))):]


def _by_files(df: DataFrame, test: Sequence[str], file: str) -> DataFrame:
    tagged = in_lists(df, file, {"test": test}, "_part", "string")
    return tagged.select(*[name(c) for c in df.columns], F.coalesce("_part", F.lit("train")).alias("split"))


def _by_position(df: DataFrame, file: str, order: Sequence[str], ranks: DataFrame,
                 counts: DataFrame) -> DataFrame:
    cuts = rank_cuts(df, [file], order, ranks, ROW_SHIFT, counts)
    out = cut_index(df, [file], order, cuts, [0], "_after")
    return (out.where("_after is not null")
            .select(*[name(c) for c in df.columns],
                    F.when(F.col("_after") == 0, "train").otherwise("test").alias("split")))


def split_per_file(df: DataFrame, file: str = "Source_File",
                   order: Sequence[str] = (S.ROW_ORD,)) -> DataFrame:
    """The first 70 % of each file trains."""
    counts = chunk_counts(df, [file], order, ROW_SHIFT)
    ranks = (counts.groupBy(file).agg(F.sum("_n").alias("_total"))
             .select(file, F.lit(0).alias("cut_id"),
                     F.floor(F.lit(PER_FILE_TRAIN) * F.col("_total")).alias("rank")))
    return _by_position(df, file, order, ranks, counts)


def split_temporal(df: DataFrame, file: str = "Source_File",
                   order: Sequence[str] = (S.ROW_ORD,), dataset: str = "Dataset") -> DataFrame:
    """The first 80 % of all rows trains; data sets follow each other, and in each its files by name.

    The global rank becomes a rank inside each file: 0 for files behind the cut, the whole
    file before it.  The window runs over one row per file.
    """
    # Rows without a file come first and belong to the order like any other.
    parts = [name(dataset)] if dataset in df.columns else []
    in_order = F.concat_ws("\x01", *[F.coalesce(c, F.lit("")) for c in [*parts, name(file)]])
    df, file = df.withColumn("_file", in_order), "_file"
    counts = chunk_counts(df, [file], order, ROW_SHIFT)
    per_file = counts.groupBy(file).agg(F.sum("_n").alias("_total"))
    total = per_file.agg(F.sum("_total")).first()[0] or 0
    earlier = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_total").over(earlier), F.lit(0))
    ranks = localized(per_file.select(
        file, F.lit(0).alias("cut_id"),
        F.least(F.greatest(F.lit(int(TEMPORAL_TRAIN * total)) - start, F.lit(0)),
                F.col("_total")).alias("rank")))
    return _by_position(df, file, order, ranks, counts).drop("_file")


def row_hash(key: Sequence[str], seed: int = SEED) -> Column:
    return F.xxhash64(F.lit(seed), *[name(k) for k in key])


def _hash_cuts(df: DataFrame, label: str, key: Sequence[str], seed: int, ranks) -> DataFrame:
    """Add ``_part``: number of hash-order cuts before the row, cuts from ``ranks(total)``."""
    order = ["_h", *key]
    hashed = df.withColumn("_h", row_hash(key, seed))
    counts = chunk_counts(hashed, [label], order, HASH_SHIFT)
    totals = counts.groupBy(label).agg(F.sum("_n").alias("_total"))
    wanted = ranks(F.col("_total"))
    targets = localized(totals.select(label, F.posexplode(F.array(*wanted)).alias("cut_id", "rank")))
    cuts = rank_cuts(hashed, [label], order, targets, HASH_SHIFT, counts)
    return cut_index(hashed, [label], order, cuts, range(len(wanted)), "_part").drop("_h")


def _test_rank(total: Column) -> Column:
    return F.when(total < 2, F.lit(0)).otherwise(
        F.floor(F.lit(RANDOM_TEST) * total + 0.5)).cast("long")


def split_random(df: DataFrame, label: str, key: Sequence[str] = ("Source_File", S.ROW_ORD),
                 seed: int = SEED) -> DataFrame:
    """Stratified 80/20: of each class the fifth with the smallest row hashes is the test."""
    out = _hash_cuts(df, label, key, seed, lambda total: [_test_rank(total)])
    return out.select(*[name(c) for c in df.columns],
                      F.when(F.col("_part") == 0, "test").otherwise("train").alias("split"))


def _need_both(df: DataFrame, dataset: str) -> None:
    n = df.agg(F.count_if(name(dataset) == "2017").alias("a"),
               F.count_if(name(dataset) == "2018").alias("b")).first()
    if not n["a"] or not n["b"]:
        raise ValueError(f"both data sets are needed; rows: 2017={n['a']}, 2018={n['b']}")


def split_cross(df: DataFrame, train: str, test: str, dataset: str = "Dataset") -> DataFrame:
    """One data set trains, the other tests; rows of neither are left out."""
    _need_both(df, dataset)
    return (df.where(name(dataset).isin(train, test))
            .withColumn("split", F.when(name(dataset) == train, "train").otherwise("test")))


def split_fused(df: DataFrame, holdout: str, label: str,
                key: Sequence[str] = ("Source_File", S.ROW_ORD), dataset: str = "Dataset",
                seed: int = SEED) -> DataFrame:
    """All of the other data set plus a stratified 80 % of ``holdout`` train.

    Classes with a single row in ``holdout`` train, too.
    """
    _need_both(df, dataset)
    df = df.where(name(dataset).isin("2017", "2018"))
    held = split_random(df.where(name(dataset) == holdout), label, key, seed)
    return held.unionByName(
        df.where(name(dataset) != holdout).withColumn("split", F.lit("train")))


def assign_split(df: DataFrame, strategy: str = "file_holdout", label: str = "Attack Type",
                 key: Sequence[str] = ("Source_File", S.ROW_ORD), seed: int = SEED,
                 file: str = "Source_File", dataset: str = "Dataset",
                 order: Sequence[str] = (S.ROW_ORD,), fallback: bool = False) -> DataFrame:
    """``df`` plus ``split`` in {train, test}.

    A strategy whose column is absent is an error, or with ``fallback`` the 80/20 split by
    position without groups.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    by_set = strategy.startswith(("cross_dataset", "fused"))
    if by_set and dataset not in df.columns:
        raise ValueError(f"{strategy} needs the column {dataset!r}")
    if file not in df.columns and strategy not in ("random", "temporal") and not by_set:
        if not fallback:
            raise ValueError(f"{strategy} needs the column {file!r}")
        strategy = "temporal"
    if strategy == "temporal" and file not in df.columns:
        return split_temporal(df.withColumn("_all", F.lit("")), "_all", order).drop("_all")
    if strategy == "per_file":
        return split_per_file(df, file, order)
    if strategy == "temporal":
        return split_temporal(df, file, order)
    if strategy == "random":
        return split_random(df, label, key, seed)
    if strategy == "cross_dataset_2017to2018":
        return split_cross(df, "2017", "2018", dataset)
    if strategy == "cross_dataset_2018to2017":
        return split_cross(df, "2018", "2017", dataset)
    if strategy == "fused_2018holdout":
        return split_fused(df, "2018", label, key, dataset, seed)
    if strategy == "fused_2017holdout":
        return split_fused(df, "2017", label, key, dataset, seed)
    if strategy == "file":
        return _by_files(df, last_files(df, file), file)
    if strategy == "mixed_holdout" and dataset in df.columns:
        return _by_files(df, mixed_holdout_files(df, file, dataset, seed), file)
    return _by_files(df, holdout_files(df, file, seed), file)


def split_report(df: DataFrame, file: str = "Source_File") -> DataFrame:
    return df.groupBy("split", file).agg(F.count("*").alias("n"))


def balanced_groups(sizes: Sequence[tuple[str, int]], k: int) -> list[tuple[str, int]]:
    """Largest group first, each to the fold with the fewest rows so far."""
    load = [0] * k
    out = []
    for group, n in sorted(sizes, key=lambda s: (s[1], s[0] or ""), reverse=True):
        fold = load.index(min(load))
        load[fold] += n
        out.append((group, fold))
    return out


def group_folds(df: DataFrame, group: str = "Source_File", k: int = 5) -> DataFrame:
    """Add ``fold``; a group (one per input file) is never divided."""
    sizes = [(r[0], r[1]) for r in df.groupBy(name(group)).agg(F.count("*")).collect()]
    k = min(k, len(sizes))
    lists: dict[int, list] = {}
    for value, fold in balanced_groups(sizes, k):
        lists.setdefault(fold, []).append(value)
    return in_lists(df, group, lists, "fold", "int")


def stratified_folds(df: DataFrame, label: str, key: Sequence[str] = ("Source_File", S.ROW_ORD),
                     k: int = 5, seed: int = SEED) -> DataFrame:
    """Add ``fold``: each class is cut into ``k`` hash ranges whose sizes differ by at most one."""
    def ranks(total: Column) -> list[Column]:
        base, rest = F.floor(total / k), total % k
        return [(base * i + F.least(rest, F.lit(i))).cast("long") for i in range(1, k)]

    out = _hash_cuts(df, label, key, seed, ranks)
    return out.select(*[name(c) for c in df.columns], F.col("_part").cast("int").alias("fold"))
