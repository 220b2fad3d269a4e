"""Token counts: the exact length histogram and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.common import slices, texts
from flowlake.llm.tokens import default_path, encoder

#: Lengths per block of the two-step suffix sums.
BLOCK = 64


def document_lengths(docs: DataFrame, path: str | None = None, end_ids: int = 1,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, length)``: ids of the whole text plus ``end_ids``; null text counts as empty."""
    path = path or default_path()

    def run(batches):
        for b in batches:
            for first, part in slices(b.column(1)):
                _, n = encoder(path).encode(part)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(part)), pa.array(n + end_ids, pa.int64())], ["doc_id", "length"])

    kind = texts(docs, id_col, text_col).schema["doc_id"].dataType.simpleString()
    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, length long")


def length_counts(docs: DataFrame, path: str | None = None, end_ids: int = 1,
                  text_col: str = "text") -> DataFrame:
    """``(length, n)`` of all documents, counted in each batch before anything is shuffled."""
    path = path or default_path()

    def run(batches):
        for b in batches:
            for _, part in slices(b.column(0)):
                length, n = np.unique(encoder(path).encode(part)[1] + end_ids, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(n, pa.int64())], ["length", "n"])

    text = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return text.mapInArrow(run, "length long, n long").groupBy("length").agg(F.sum("n").alias("n"))


def histogram(counts: DataFrame) -> DataFrame:
    """One row per different length with everything a context limit of that length asks for.

    ``n_docs``, ``n_tokens`` of this length; ``docs_upto`` (documents that fit whole),
    ``docs_over`` and ``tokens_over`` (of longer documents), ``tokens_upto``,
    ``tokens_truncated`` (all tokens when each document is cut to this length), ``tokens_lost``,
    and ``quantile`` (share of documents at most this long).  An empty table gives no row.
    Suffix sums run inside blocks of lengths and over the block totals, so no task sorts them all.
    """
    rows = counts.select("length", F.col("n").alias("n_docs"), (F.col("n") * F.col("length")).alias("n_tokens"),
                         F.floor(F.col("length") / BLOCK).alias("_block"))
    after = (F.sum(c).over(Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1))
             for c in ("_docs", "_tokens"))
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum("n_tokens").alias("_tokens"))
    docs_after, tokens_after = after
    blocks = blocks.select("_block", F.coalesce(docs_after, F.lit(0)).alias("_docs_after"),
                           F.coalesce(tokens_after, F.lit(0)).alias("_tokens_after"),
                           F.sum("_docs").over(Window.partitionBy()).alias("_all_docs"),
                           F.sum("_tokens").over(Window.partitionBy()).alias("_all_tokens"))
    inside = Window.partitionBy("_block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_docs_in": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)),
                             "_tokens_in": F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))})
    over = {"docs_over": F.col("_docs_in") + F.col("_docs_after"),
            "tokens_over": F.col("_tokens_in") + F.col("_tokens_after")}
    return (rows.join(blocks, "_block").withColumns(over).select(
        "length", "n_docs", "n_tokens", "docs_over", "tokens_over",
        (F.col("_all_docs") - F.col("docs_over")).alias("docs_upto"),
        (F.col("_all_tokens") - F.col("tokens_over")).alias("tokens_upto"),
        (F.col("_all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("length")).alias("tokens_truncated"),
        (F.col("tokens_over") - F.col("docs_over") * F.col("length")).alias("tokens_lost"),
        ((F.col("_all_docs") - F.col("docs_over")) / F.col("_all_docs")).alias("quantile")))


def totals_at(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Whole and truncated totals for context limits that need not be lengths themselves."""
    wanted = hist.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    longer = F.col("length") > F.col("context_limit")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    return (wanted.join(F.broadcast(hist.select("length", "n_docs", "n_tokens")).hint("broadcast"), F.lit(True), "left")
            .groupBy("context_limit").agg(
                total("n_docs", ~longer).alias("docs_whole"), total("n_docs", longer).alias("docs_cut"),
                (total("n_tokens", ~longer) + total("n_docs", longer) * F.col("context_limit")).alias("tokens_truncated")))


def quantile_length(hist: DataFrame, share: float) -> Column:
    """Aggregate over :func:`histogram`: the smallest length that at least ``share`` of documents do not exceed."""
    return F.min(F.when(F.col("quantile") >= share, F.col("length")))
