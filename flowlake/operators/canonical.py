"""Bring flow tables of either dialect to the canonical 80 columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake import schema as S
from flowlake.functions.scalars import name
from flowlake.plans.ordered import ROW_SHIFT, chunk_counts, cut_index, rank_cuts

#: What ``str.strip`` would remove, for text and header names alike (fixed value).
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*header_names(df.columns))


def header_names(raw: Iterable[str]) -> list[str]:
    """Trimmed header names; the n-th repeat of a name gets the suffix ``.n``."""
    seen: dict[str, int] = {}
    out = []
    for c in raw:
        c = c.strip(WHITESPACE + "\ufeff")
        n = seen.get(c, 0)
        seen[c] = n + 1
        out.append(f"{c}.{n}" if n else c)
    return out


def detect_dialect(columns: Iterable[str]) -> str:
    return "2018" if S.MARKER_2018 in {c.strip(WHITESPACE) for c in columns} else "2017"


def to_canonical_names(df: DataFrame, dialect: str) -> DataFrame:
    """Trim, drop what only this dialect has, rename to the canonical spelling."""
    df = strip_names(df)
    if dialect == "2018":
        return df.drop(*S.DROPPED_2018).withColumnsRenamed(S.RENAME_2018)
    return df.drop(*S.DROPPED_2017)


def name_differences(columns: Iterable[str], wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """Names missing from ``columns`` and names that are not wanted, in their own order."""
    have = list(columns)
    return [c for c in wanted if c not in have], [c for c in have if c not in wanted]


def drop_embedded_headers(df: DataFrame, label: str = "Label") -> DataFrame:
    """Remove header lines repeated inside a file; rows without a label stay."""
    return df.where(F.coalesce(stripped(name(label)) != "Label", F.lit(True)))


def canonicalize(df: DataFrame, dialect: str, extra: Sequence[str] = (S.ROW_ORD,)) -> DataFrame:
    """Canonical columns in order: missing ones null, unknown ones dropped.

    ``extra`` columns (row position, path) are kept behind the canonical ones if present.
    """
    df = to_canonical_names(df, dialect).withColumn("Dataset", F.lit(dialect))
    if "Label" in df.columns:
        df = drop_embedded_headers(df)
    have = set(df.columns)
    return df.select(
        *[name(c) if c in have else F.lit(None).cast("string").alias(c)
          for c in S.CANONICAL_COLUMNS],
        *[name(c) for c in extra if c in have])


def drift_rows(source_file: str, columns: Iterable[str]) -> list[tuple[str, str, str]]:
    """Missing and extra canonical names of one file, from its header alone."""
    names = header_names(columns)
    if detect_dialect(names) == "2018":
        names = [S.RENAME_2018.get(c, c) for c in names if c not in S.DROPPED_2018]
    else:
        names = [c for c in names if c not in S.DROPPED_2017]
    tags = ("Source_File", "Dataset")
    missing, extra = name_differences(names, [c for c in S.CANONICAL_COLUMNS if c not in tags])
    return ([(source_file, c, "missing") for c in missing]
            + [(source_file, c, "extra") for c in extra if c not in tags])


def drift_report(spark: SparkSession, headers: Iterable[tuple[str, Sequence[str]]]) -> DataFrame:
    rows = [r for f, cols in headers for r in drift_rows(f, cols)]
    return spark.createDataFrame(rows, "source_file string, column string, status string")


def cap_per_file(df: DataFrame, n: int, file: str = "Source_File",
                 order: Sequence[str] = (S.ROW_ORD,)) -> DataFrame:
    """The first ``n`` rows of each file by position.

    The position of the n-th row of each file is looked up; rows are compared with it where
    they are read, so a file that holds most of the data is not gathered anywhere.
    """
    counts = chunk_counts(df, [file], order, ROW_SHIFT)
    targets = (counts.groupBy(file).agg(F.sum("_n").alias("_total"))
               .select(file, F.lit(0).alias("cut_id"),
                       F.least(F.col("_total"), F.lit(n).cast("long")).alias("rank")))
    cuts = rank_cuts(df, [file], order, targets, ROW_SHIFT, counts)
    return (cut_index(df, [file], order, cuts, [0], "_after")
            .where("_after = 0").select(*[name(c) for c in df.columns]))
