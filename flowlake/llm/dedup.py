"""Exact duplicates: frequent digests are settled where they are read, the others by a shuffle.

A Misra-Gries pass over the digests (Spark's ``freqItems``) names every digest that can hold more than a given
share of the rows, at most ``1 / share`` of them.  Their groups are counted exactly, and the
verified ones are broadcast: copies of a frequent text are dropped map-side and never meet in
one task.  All other digests go through an ordinary shuffle, where no group exceeds that share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import rows_of, stored

#: A text with more than this share of the rows is settled map-side; at most ``1 / SHARE`` are.
SHARE = 1 / 512
#: Longest list of copies that is broadcast to where the texts are read; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1 << 19
#: Runs of white space that are not one space already; the lone spaces of a text are most of its runs.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def text_digest(text: str | Column) -> Column:
    """SHA-256 of the text with each run of white space as one space; null counts as empty."""
    text = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    return F.sha2(F.regexp_replace(text, _RUNS, " "), 256)


def _settled(pairs: DataFrame) -> DataFrame:
    """Per digest of ``(digest, doc_id, n)``: ``keep`` (the smallest id, null last), its rows ``ties``, all rows ``size``."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))
    return pairs.groupBy("digest").agg(F.min(order)["doc_id"].alias("keep"), F.min_by("n", order).alias("ties"),
                                       F.sum("n").alias("size"))


def frequent(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """``(digest, keep, ties, size)`` of every digest with more than ``share`` of the rows: ``1 / share`` rows at most."""
    coded = rows.withColumn("_code", F.xxhash64("digest"))
    named = coded.freqItems(["_code"], share).select(F.explode("_code_freqItems").alias("_code"))
    pairs = coded.join(F.broadcast(named), "_code", "left_semi").groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    least = rows.count() * share
    return stored(_settled(pairs).where(F.col("size") > least).coalesce(1), "frequent")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per document.

    Null and empty texts are equal texts.  Of equal texts the smallest id stays, a null id only
    if there is no other; of equal rows exactly one is kept.  An empty table gives no rows.
    """
    return _decided(*_groups(docs, id_col, text_col, share))


def _groups(docs: DataFrame, id_col: str, text_col: str, share: float) -> tuple[DataFrame, DataFrame]:
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.unhex(text_digest(text_col)).alias("digest")), "digests")
    return rows, frequent(rows, share)


def _decided(rows: DataFrame, often: DataFrame) -> DataFrame:
    marked = rows.join(F.broadcast(often), "digest", "left")
    copies = (marked.where(F.col("keep").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keep")))
              .select("doc_id", "digest", "keep", "size", F.lit(False).alias("kept")))
    rare = rows.join(F.broadcast(often.where(F.col("keep").isNotNull())), "digest", "left_anti").repartition("digest")
    pairs = rare.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    groups = pairs.join(_settled(pairs), "digest")
    first = F.col("doc_id").eqNullSafe(F.col("keep"))
    nth = F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_nth")
    rest = groups.select("doc_id", "digest", "keep", "size", first.alias("_first"), nth).select(
        "doc_id", "digest", "keep", "size", (F.col("_first") & (F.col("_nth") == 1)).alias("kept"))
    winners = (often.where(F.col("keep").isNotNull())
               .select(F.col("keep").alias("doc_id"), "digest", "keep", "size",
                       F.explode(F.sequence(F.lit(1), F.col("ties").cast("int"))).alias("_nth"))
               .select("doc_id", "digest", "keep", "size", (F.col("_nth") == 1).alias("kept")))
    return copies.unionByName(rest).unionByName(winners).select(
        "doc_id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept",
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """``docs`` without exact duplicates, all columns as they were; frequent copies go before any shuffle."""
    rows, often = _groups(docs, id_col, text_col, share)
    decided = stored(_decided(rows, often).where("group_size > 1")
                     .select("doc_id", "keep_id", "kept", F.unhex("text_sha256").alias("digest")), "copies")
    own = rows_of(docs, F.col(id_col).alias("doc_id"), F.unhex(text_digest(text_col)).alias("digest"))
    own = (own.join(F.broadcast(often.select("digest", "keep")), "digest", "left")
           .where(F.col("keep").isNull() | F.col("doc_id").eqNullSafe(F.col("keep"))).drop("keep"))
    gone = decided.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "digest").distinct()
    if decided.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    same = F.col("a.digest").eqNullSafe(F.col("b.digest")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    left = own.alias("a").join(gone.alias("b"), same, "left_anti")
    equal = decided.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("kept")).select("doc_id", "digest").distinct()
    if equal.isEmpty():
        return left.select("_row.*")
    alone = left.alias("a").join(equal.alias("b"), same, "left_anti").select("_row")
    one = left.alias("a").join(equal.alias("b"), same, "left_semi").groupBy("digest").agg(F.first("_row").alias("_row"))
    return alone.unionByName(one.select("_row")).select("_row.*")
