"""Small sides of joins, behind a check of their size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.functions.scalars import name
from flowlake.session import new_folder

#: Largest side that is turned into a local relation.
MAX_LOCAL_ROWS = 100_000
#: Values that are compared as literals of the plan; longer lists are joined.
MAX_LITERALS = 2_000
#: Parts that the rows of one value are dealt into where the list is joined.
SALTS = 64


def localized_table(df: DataFrame, max_rows: int = MAX_LOCAL_ROWS) -> tuple[DataFrame, pa.Table | None]:
    """:func:`localized` with the rows themselves, where they are few."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, "side")
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    if kept.count() > max_rows:
        return kept, None
    rows = kept.toArrow()
    return spark.createDataFrame(rows, schema=df.schema), rows


def localized(df: DataFrame, max_rows: int = MAX_LOCAL_ROWS) -> DataFrame:
    """``df`` as a local relation of known size when it has at most ``max_rows`` rows.

    The side is stored once in the shared folder and what was stored is counted, so nothing
    behind it is computed a second time.  Spark knows the exact size of a local relation and
    broadcasts it under its own threshold; a larger side is read back and joined by shuffle.
    """
    return localized_table(df, max_rows)[0]


def in_lists(df: DataFrame, column: str, lists: Mapping[object, Sequence[str | None]], out: str, kind: str,
             max_literals: int = MAX_LITERALS) -> DataFrame:
    """Add ``out``: the key of the list that holds the row's value of ``column``, null where none does.

    Short lists are literals, so the rows stay in their scan.  Longer ones are joined on the value
    and a part of the rows with it, so that no value's rows meet in one task, however many they are.
    """
    if sum(len(v) for v in lists.values()) <= max_literals:
        found = F.lit(None).cast(kind)
        for key, values in lists.items():
            some = [v for v in values if v is not None]
            hit = name(column).isin(some) if some else F.lit(False)
            if len(some) < len(values):
                hit = F.coalesce(hit, F.lit(False)) | name(column).isNull()
            found = F.when(hit, F.lit(key).cast(kind)).otherwise(found)
        return df.withColumn(out, found)
    values, keys = zip(*[(v, k) for k, vs in lists.items() for v in vs])
    side = df.sparkSession.createDataFrame(pa.table({"_value": pa.array(values, pa.string()), "_key": pa.array(keys)}))
    side = side.select("_value", F.col("_key").cast(kind).alias(out), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    plain = [name(f.name) for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
    on = name(column).eqNullSafe(F.col("_value")) & (rows["_salt"] == side["_salt"])
    return rows.join(side, on, "left").select(*[name(c) for c in df.columns], name(out))
