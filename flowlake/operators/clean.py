"""Cleaning: numbers from text, null handling, label groups, rare classes, reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake import schema as S
from flowlake.functions.scalars import finite_or_null, is_infinite, name, number
from flowlake.operators.canonical import stripped
from flowlake.plans.bounded import localized

#: Columns that say where a row came from; they are no part of its content.
POSITION = (S.ROW_ORD, "source_path")


def feature_columns(df: DataFrame) -> list[str]:
    skip = {*S.METADATA, *POSITION}
    return [c for c in df.columns if c not in skip]


def _as_feature(column: str, kind: T.DataType) -> Column:
    c = name(column)
    if isinstance(kind, T.StringType):
        d = number(c)
        if isinstance(S.feature_type(column), T.LongType):
            # Wide enough for whole counters, and a fractional one keeps its value and its row.
            return d.alias(column)
        return d.cast("float").alias(column)
    if isinstance(kind, (T.DoubleType, T.DecimalType)):
        return c.cast("float").alias(column)
    return c


def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text features to numbers (unreadable text to null), doubles to 32-bit floats."""
    wanted = set(feature_columns(df) if columns is None else columns)
    return df.select(*[_as_feature(f.name, f.dataType) if f.name in wanted else name(f.name)
                       for f in df.schema.fields])


def _fractional(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def nullify_infinite(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    wanted = set(_fractional(df) if columns is None else columns)
    return df.select(*[finite_or_null(name(c)).alias(c) if c in wanted else name(c)
                       for c in df.columns])


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows with a null or NaN in any column, metadata included, are removed.

    One condition per column: a single condition over all of them makes the optimizer's
    constraint inference exponential in the number of computed columns.
    """
    fractional = set(_fractional(df))
    for c in df.columns:
        if c not in POSITION:
            df = df.where(name(c).isNotNull())
            if c in fractional:
                df = df.where(~F.isnan(name(c)))
    return df


def drop_identifiers(df: DataFrame) -> DataFrame:
    return df.drop(*S.IDENTIFIERS)


def content_columns(df: DataFrame) -> list[str]:
    """The columns by which rows are compared."""
    return [c for c in df.columns if c not in POSITION]


def dedup_rows(df: DataFrame, order_col: str = S.ROW_ORD) -> DataFrame:
    """One row per distinct content, keeping the first position.

    Copies collapse in the map-side aggregate, so a large group of copies sends one row per
    task.  The folder of a row is dropped: rows are compared without it.
    """
    data = content_columns(df)
    if order_col not in df.columns:
        return df.select(*[name(c) for c in data]).dropDuplicates()
    return (df.groupBy(*[name(c) for c in data]).agg(F.min(order_col).alias(order_col))
            .select(*[name(c) for c in data], order_col))


def duplicate_columns(df: DataFrame, columns: Sequence[str] | None = None,
                      key: Sequence[str] = ("Source_File", S.ROW_ORD)) -> list[str]:
    """Columns whose values equal those of an earlier column of the same type in every row.

    Pass one takes an order-independent fingerprint per column; pass two compares the
    columns with equal fingerprints value by value, so the answer is exact.
    """
    columns = list(feature_columns(df) if columns is None else columns)
    kinds = dict(df.dtypes)
    keys = [name(k) for k in key if k in df.columns]
    prints = df.agg(*[F.bit_xor(F.xxhash64(*keys, name(c))).alias(f"h{i}")
                      for i, c in enumerate(columns)]).first()
    pairs = [(i, j) for j in range(len(columns)) for i in range(j)
             if prints[i] == prints[j] and kinds[columns[i]] == kinds[columns[j]]]
    if not pairs:
        return []
    unequal = df.agg(*[F.count_if(~name(columns[i]).eqNullSafe(name(columns[j])))
                       .alias(f"p{i}_{j}") for i, j in pairs]).first()
    later = {j for (i, j), n in zip(pairs, unequal) if n == 0}
    return [columns[j] for j in sorted(later)]


def group_labels(df: DataFrame, label_map: DataFrame, default: str = S.UNKNOWN_GROUP,
                 label: str = "Label", out: str = "Attack Type") -> DataFrame:
    """Trim the label and look up its attack group; labels without a group get ``default``."""
    keep = [c for c in df.columns if c != out]
    return (df.withColumn(label, stripped(name(label)))
            .join(label_map, name(label) == F.col("raw_label"), "left")
            .select(*[name(c) for c in keep],
                    F.coalesce("attack_type", F.lit(default)).alias(out)))


def unmapped_labels(df: DataFrame, label_map: DataFrame, label: str = "Label") -> DataFrame:
    """Distinct trimmed labels without a group."""
    seen = df.select(stripped(name(label)).alias(label)).distinct()
    return seen.join(label_map, name(label) == F.col("raw_label"), "left_anti")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(name(label)).agg(F.count("*").alias("n"))


def drop_rare_classes(df: DataFrame, label: str = "Attack Type", min_count: int = 100,
                      always: Iterable[str] = S.ALWAYS_RARE) -> DataFrame:
    """Remove classes with fewer than ``min_count`` rows and those listed in ``always``."""
    rare = localized(class_counts(df, label)
                     .where((F.col("n") < min_count) | name(label).isin(list(always)))
                     .select(name(label)))
    return df.join(rare, [label], "left_anti").select(*[name(c) for c in df.columns])


def label_distribution(df: DataFrame, label: str = "Label") -> DataFrame:
    return class_counts(df, label).orderBy(F.desc("n"), name(label))


def rows_per_file(df: DataFrame, file: str = "Source_File") -> DataFrame:
    """Rows per file and the running total in file-name order (one row per file)."""
    per_file = localized(class_counts(df, file))
    w = Window.orderBy(name(file)).rowsBetween(Window.unboundedPreceding, 0)
    return per_file.withColumn("cumulative", F.sum("n").over(w))


def quality_counts(df: DataFrame) -> list[Column]:
    """Aggregates: rows, infinite cells, incomplete rows (±inf counted as missing)."""
    numeric = _fractional(df)
    inf = sum((F.when(is_infinite(name(c)), 1).otherwise(0) for c in numeric), F.lit(0))
    gap = F.lit(False)
    for c in df.columns:
        if c in POSITION:
            continue
        gap = gap | ((finite_or_null(name(c)) if c in numeric else name(c)).isNull())
    return [F.count("*").alias("n_rows"), F.sum(inf.cast("long")).alias("inf_cells"), F.count_if(gap).alias("incomplete_rows")]


def quality_report(df: DataFrame) -> DataFrame:
    """Rows, infinite cells, incomplete rows and their share."""
    return df.agg(*quality_counts(df)).withColumn(
        "incomplete_pct", F.try_divide(F.col("incomplete_rows") * 100.0, F.col("n_rows")))


def dedup_report(df: DataFrame, order_col: str = S.ROW_ORD) -> DataFrame:
    """Rows read, kept and removed by :func:`dedup_rows`, from one aggregate per copy group."""
    data = [name(c) for c in df.columns if c not in POSITION]
    groups = df.groupBy(*data).agg(F.count("*").alias("_n"))
    out = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_read"),
                     F.count("*").alias("n_kept"))
    return (out.withColumn("n_removed", F.col("n_read") - F.col("n_kept"))
            .withColumn("removed_pct", F.try_divide(F.col("n_removed") * 100.0, F.col("n_read"))))


def files_without_rows(before: DataFrame, after: DataFrame, file: str = "Source_File") -> DataFrame:
    """Files that had rows and have none left, the sign of a column missing from a file."""
    left = localized(after.select(file).distinct())
    return localized(before.select(file).distinct()).join(left, [file], "left_anti")


def label_checks(df: DataFrame, label: str = "Label", features: Sequence[str] = ()) -> list[Column]:
    """The aggregates that :func:`judge_labelled` needs."""
    if label not in df.columns:
        raise ValueError(f"no column {label!r}")
    fractional = set(_fractional(df))
    missing = [F.count_if(name(c).isNull() | (F.isnan(name(c)) if c in fractional else F.lit(False))).alias(f"m{i}")
               for i, c in enumerate(features)]
    return [F.count("*").alias("n"), F.count_if(name(label).isNull()).alias("no_label"),
            F.min(name(label)).alias("lo"), F.max(name(label)).alias("hi"), *missing]


def judge_labelled(found: Mapping, features: Sequence[str] = ()) -> None:
    """Raise unless there are rows, a complete label of two or more classes, complete features."""
    if found["n"] == 0:
        raise ValueError("no rows")
    if found["no_label"]:
        raise ValueError(f"{found['no_label']} rows without a label")
    if found["lo"] == found["hi"]:
        raise ValueError(f"two classes are needed, found only {found['lo']!r}")
    bad = [c for i, c in enumerate(features) if found[f"m{i}"]]
    if bad:
        raise ValueError(f"features with missing values: {bad}")


def validate_labelled(df: DataFrame, label: str = "Label", features: Sequence[str] = ()) -> None:
    """:func:`judge_labelled` of a table that is read for it."""
    judge_labelled(df.agg(*label_checks(df, label, features)).first().asDict(), features)
