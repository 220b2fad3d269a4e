"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.session import new_folder

#: The white space of every text rule here, as a character class.
SPACE = r"[\x20\x09-\x0D]"
#: Texts handed to one numpy pass, in bytes.
SLICE_BYTES = 6 << 20
#: Rows that travel to a Python worker at a time, in bytes; Spark's default is 64 MB or 10,000 rows.
BATCH_BYTES, _BATCHES = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark) -> None:
    """Smaller batches for Python workers from now on, in a session that does not say how large they are.

    A batch lies in the executor and, up to twice, in its worker, for every task at the same time.
    """
    if _BATCHES not in spark.conf.getAll:
        spark.conf.set(_BATCHES, BATCH_BYTES)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` alone, null text as empty; every other column is left behind."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def stored(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe from lost executors."""
    path = new_folder(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark, path: str) -> None:
    """Delete a folder of the shared store that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def rows_of(df: DataFrame, *keys: Column) -> DataFrame:
    """Whole rows as one struct ``_row``, so that no column name can clash with added keys."""
    return df.select(F.struct("*").alias("_row"), *keys)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """``(first row, part)`` of a string column, in parts of about ``most`` bytes."""
    column = column.cast(pa.string()).fill_null("")
    sizes = column.nbytes
    step = max(1, len(column) * most // max(1, sizes)) if sizes > most else max(1, len(column))
    for i in range(0, len(column), step):
        yield i, column.slice(i, step)


def utf8(column: pa.StringArray):
    """Bytes and offsets (from 0) of a string column without nulls, as numpy views."""
    import numpy as np

    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]
