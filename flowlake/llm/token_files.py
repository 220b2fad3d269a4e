"""Token-ID files: Parquet list columns with controlled encoding, row groups and page indexes.

A row is ``(doc_id, part, local_start, n_tokens, ids)``, rows lie in ascending ``doc_id`` order
inside and across files, ``part`` numbers the files.  Page indexes and row groups are small, so
a reader that asks for a range of documents touches only their pages, and one that asks for
lengths touches no token.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import slices, texts
from flowlake.llm.tokens import default_path, encoder

#: Ids that one row group holds at most, about; a longer document is a row group of its own.
ROW_GROUP_BYTES = 8 << 20
#: Texts encoded at a time, in bytes: each different word of them is encoded once.
SLICE_BYTES = 16 << 20
#: Rows of a page; the page index has one entry for each page.
PAGE_ROWS = 64


def writer_options(encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES,
                   page_rows: int = PAGE_ROWS) -> dict[str, str]:
    """Options of Spark's Parquet writer: ``dictionary`` or ``delta`` coding of the ids."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r}: dictionary or delta")
    return {"compression": "zstd", "parquet.block.size": str(row_group_bytes),
            "parquet.page.row.count.limit": str(page_rows), "parquet.page.size": str(256 << 10),
            "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
            "parquet.dictionary.page.size": str(1 << 20),
            "parquet.writer.version": "v1" if encoding == "dictionary" else "v2"}


def _schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("doc_id", id_type), T.StructField("part", T.LongType()),
                         T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()),
                         T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def _in_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out and sorted by ``doc_id``, one range of ids for each partition.

    The ranges are quantiles of the ids, which one pass over that column alone finds; texts are
    read once.  An id that fills several ranges is dealt over all of them.  Ids that are no whole
    numbers are dealt by Spark's own sampled ranges.
    """
    rows = rows.withColumn("_read", F.monotonically_increasing_id())
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not isinstance(rows.schema["doc_id"].dataType, T.IntegralType):
        dealt = rows.repartitionByRange("doc_id", "_read")
    else:
        ids = rows.select(F.col("doc_id").cast("long").alias("doc_id"))
        found = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else None
        bounds = np.array(sorted(found or ()), np.int64)

        @F.arrow_udf("int")
        def part(doc_id: pa.Array, read: pa.Array) -> pa.Array:
            at = doc_id.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, at, side="left"), np.searchsorted(bounds, at, side="right")
            return pa.array((low + read.to_numpy(zero_copy_only=False) % (high - low + 1)).astype(np.int32))

        dealt = rows.repartitionById(len(bounds) + 1, part(F.col("doc_id").cast("long"), "_read"))
    return dealt.sortWithinPartitions("doc_id", "_read").drop("_read")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 0,
                 encoding: str = "dictionary", id_col: str = "doc_id", text_col: str = "text",
                 **options: int) -> None:
    """Encode every whole text and write the files in ascending id order.

    Null text counts as empty, a null id comes first, rows with equal ids follow each other (in
    the order they are read, inside a file) and a file may end between them, an empty table gives
    files without rows.
    """
    tokenizer = tokenizer or default_path()
    rows = _in_ranges(texts(docs, id_col, text_col))
    end = np.array([] if end_id is None else [end_id], np.int32)

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            for first, column in slices(b.column(1), SLICE_BYTES):
                ids, n = encoder(tokenizer).encode(column)
                if len(end):
                    ids = np.insert(ids, np.cumsum(n), end[0])
                n = n + len(end)
                starts = np.cumsum(n) - n
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(column)), pa.array(np.full(len(n), part), pa.int64()),
                     pa.array(starts + before, pa.int64()), pa.array(n, pa.int64()), lists],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"])
                before += len(ids)

    schema = _schema(rows.schema["doc_id"].dataType)
    rows.mapInArrow(run, schema).write.options(**writer_options(encoding, **options)).parquet(path)


def read_tokens(spark: SparkSession, path: str, low=None, high=None) -> DataFrame:
    """The rows of the files, of ids ``low`` to ``high`` where given: a filter that row groups and pages are skipped by."""
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    return rows if high is None else rows.where(F.col("doc_id") <= high)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens)``; reads no token.  ``start`` counts the ids of all documents before."""
    return with_starts(spark.read.parquet(path).select("doc_id", "part", "local_start", "n_tokens"), spark, path)


def with_starts(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Replaces ``part`` and ``local_start`` by ``start``; one row per file is totalled, not one per document."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("_n"))
             .select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    start = (F.col("_before") + F.col("local_start")).alias("start")
    rest = [c for c in rows.columns if c not in ("doc_id", "part", "local_start")]
    return rows.join(parts, "part").select("doc_id", start, *rest)


def checksums(rows: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32``: of the ids as little-endian unsigned 32-bit integers."""
    names = [f.name for f in rows.schema if f.name != "ids"]
    at = rows.columns.index("ids")
    schema = T.StructType([f for f in rows.schema if f.name != "ids"] + [T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        for b in batches:
            lists = b.column(at)
            bounds = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(c)) for c in names] + [pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    return rows.mapInArrow(run, schema)
