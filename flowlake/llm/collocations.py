"""Phrase collocations by dynamic itemset counting over cyclic shard scans.

The texts are stored once, divided into shards, and the shards are scanned in turn.  Words are
counted in the first cycle.  A longer phrase becomes active as soon as both its parts without
the last and without the first word have reached the threshold in the shards read so far, and
is counted from the next shard on until each shard has been read once.  One scan thus counts
phrases of all lengths, and the last cycles only those that became active late.

Shards are counted by hashes of the phrases: 64 bits and, from other functions of the words, 24
bits to check them.  What has reached the threshold is looked up in a bit table of fixed size,
sent to the tasks.  Bits are only added, so a phrase is counted in the scans between the first
table that has its parts and the one a cycle later: in each shard once.  A full table makes
phrases active too early, never too late, so no frequent phrase is missed.

A count also carries the part of a shard that had its phrase first.  A last scan takes the text of
each phrase that has reached the threshold from that part alone, told by a second bit table, so
it gives each text about once, however many tasks have read it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.common import remove, slices, stored, utf8
from flowlake.llm.words import mix, word_hashes
from flowlake.session import new_folder

#: Parts of the texts that are scanned in turn.
SHARDS = 3
#: Longest phrase, least count, rows for each language, share of a longer phrase that hides a shorter one (percent).
LONGEST, LEAST, ROWS, HIDES = 4, 30, 2000, 80
#: Texts counted in one numpy pass, in bytes; bits of the table of phrases that have reached the threshold.
SLICE_BYTES, BITS = 8 << 20, 1 << 26
#: Texts that a task collects before it hands them on.
KEPT = 1 << 20
#: Parts that the joins on a hot word are dealt into.
SALTS = 16
NO_LANG = "und"

_BREAK, _GAP = b".,;:!?" + bytes(range(0x0A, 0x0E)), b"\x20\x09"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: 0 for bytes of words, 1 between words, 2 between pieces.
_KIND = bytes(2 if c in _BREAK else int(c in _GAP) for c in range(256))
_POWERS = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(LONGEST)]
_CHECK_POWERS = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(LONGEST)]
#: Bits that check a hash; with the size in the bits below they are a tag.
_CHECK, _SIZE = 24, 3
#: Bits for the part of a shard, as seen by the hash, and a factor that spreads shard and part.
_PART, _SPREAD = 16, 0x9E3779B97F5


def split_words(column: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """``(words, index, piece)``: different lower-cased words, and for every occurrence its word and piece."""
    raw, offsets = utf8(column)
    data = raw.tobytes()
    kind = np.frombuffer(data.translate(_KIND), np.uint8)
    inside, apart = kind == 0, kind == 2
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    begins[edge] = inside[edge]
    # A text begins a piece whether or not its first byte is a break.
    apart[edge] = True
    ends[:-1] &= ~inside[1:] | begins[1:]
    at = np.flatnonzero(begins)
    piece = np.zeros(len(at) + 1, np.int32)
    piece[np.searchsorted(at, np.flatnonzero(apart))] = 1
    piece = np.cumsum(piece[:-1])
    bounds = np.concatenate([[0], np.cumsum(np.flatnonzero(ends) + 1 - at)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(data.translate(_LOWER, _BREAK + _GAP)))
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), piece


def _of_lang(lang: str, checks: bool = False) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=16).digest(), np.uint64)[int(checks)]


def word_checks(words: pa.StringArray, lang: str) -> np.ndarray:
    """Hashes of different words that share nothing with :func:`word_hashes`: of CRC and length."""
    crc = np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.uint64)
    return mix((crc | lengths << 32) + _of_lang(lang, True))


def _some_checks(words: pa.StringArray, wanted: np.ndarray, lang: str) -> np.ndarray:
    """The checks of the wanted words, 0 for the others."""
    out, some = np.zeros(len(words), np.uint64), np.flatnonzero(wanted)
    out[some] = word_checks(words.take(pa.array(some)), lang)
    return out


def _checks_at(place: np.ndarray, size: int, index: np.ndarray, word_check: np.ndarray) -> np.ndarray:
    """Checks of the phrases of ``size`` words that begin at ``place``."""
    sums = word_check[index[place]]
    for k in range(1, size):
        sums = sums + word_check[index[place + k]] * _CHECK_POWERS[k]
    return sums >> 64 - _CHECK


def _tags(checks: np.ndarray, size: int) -> np.ndarray:
    return (checks << _SIZE | size).astype(np.uint32).view(np.int32)


def _counted(hashes: np.ndarray, checks: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """``((hashes, checks), counts)`` of the different pairs of hash and check.

    Two plain sorts, as an indirect one takes ten times as long: of the hashes, and of their high
    bits with the checks below.  Where high bits are one hash's and one check's the two agree row
    by row; the few other rows are sorted as pairs.
    """
    alone, n = np.unique(hashes, return_counts=True)
    both = np.sort(hashes >> _CHECK << _CHECK | checks)
    both = both[np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))] if len(both) else both
    high, high_too = alone >> _CHECK, both >> _CHECK
    shared = np.concatenate([x[1:][x[1:] == x[:-1]] for x in (high, high_too)])
    if not len(shared):
        return (alone, both & ((1 << _CHECK) - 1)), n
    mine, mine_too = ~np.isin(high, shared), ~np.isin(high_too, shared)
    rest = np.isin(hashes >> _CHECK, shared)
    hashes, checks = hashes[rest], checks[rest]
    order, first = _different(hashes, checks)
    at = order[first]
    return ((np.concatenate([alone[mine], hashes[at]]), np.concatenate([both[mine_too] & ((1 << _CHECK) - 1), checks[at]])),
            np.concatenate([n[mine], np.diff(first, append=len(order))]))


def _different(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, first)``: the rows sorted by hash and check, and where in that order each different pair begins."""
    order = np.lexsort((checks, hashes))
    h, c = hashes[order], checks[order]
    new = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), new]))


def _has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have both their bits in the table."""
    held, mask = table.view(np.uint8), np.uint64(len(table) * 64 - 1)

    def bit(slot):
        return (held[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).view(bool)

    out = bit((hashes & mask).view(np.int64))
    some = np.flatnonzero(out)
    out[some] = bit((hashes[some] >> 32 & mask).view(np.int64))
    return out


def _done(old: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    """Which hashes were in the table of a cycle ago, if there is one."""
    return _has(old, hashes) if old is not None else np.zeros(len(hashes), bool)


def phrase_hashes(sums: np.ndarray, lang: str) -> np.ndarray:
    """Final hashes of phrases from the sums of their words' hashes times powers by place."""
    return mix(sums * np.uint64(0x9E3779B97F4A7C15) + _of_lang(lang))


def _owner(hashes: np.ndarray, shard: int, part: int | None) -> np.ndarray:
    """What stands in the table of owners for phrases that a part of a shard had first; without a part, for any phrase."""
    if part is None:
        return hashes
    seen = (hashes ^ (part & (1 << _PART) - 1)) & ((1 << _PART) - 1)
    return hashes ^ (seen | shard << _PART) * np.uint64(_SPREAD)


def count_slice(column: pa.StringArray, lang: str, words_too: bool, now: np.ndarray | None, old: np.ndarray | None) -> Iterator[tuple]:
    """``(size, (hashes, checks), counts)`` of one slice of texts of one language.

    They are those of words, where wanted, and of longer phrases whose parts are in the table of
    ``now`` and were not all in the table of a cycle ago.
    """
    words, index, piece = split_words(column)
    if not len(index):
        return
    word_hash = word_hashes(words)[0]
    hashes = phrase_hashes(word_hash, lang)
    if words_too:
        word_check = word_checks(words, lang)
        yield 1, (hashes, word_check >> 64 - _CHECK), np.bincount(index, minlength=len(words))
    if now is None:
        return
    reached = _has(now, hashes)
    if not words_too:
        word_check = _some_checks(words, reached, lang)
    # Occurrences of the phrases of the current size that have reached: where they are and their hash sums.
    # Only what is given back is sorted.
    place = np.flatnonzero(reached[index])
    code = index[place]
    sums, done = word_hash[code], _done(old, hashes)[code]
    for size in range(1, LONGEST):
        # A longer phrase starts where this one and the one a word later have reached, both in one piece.
        at = np.flatnonzero(place[1:] == place[:-1] + 1)
        at = at[piece[place[at]] == piece[place[at] + size]]
        if not len(at):
            return
        fresh, place = ~(done[at] & done[at + 1]), place[at]
        sums = sums[at] + word_hash[index[place + size]] * _POWERS[size]
        hashes = phrase_hashes(sums, lang)
        yield size + 1, *_counted(hashes[fresh], _checks_at(place[fresh], size + 1, index, word_check))
        if size + 1 == LONGEST:
            return
        kept = np.flatnonzero(_has(now, hashes))
        sums, place, done = sums[kept], place[kept], _done(old, hashes[kept])


def name_slice(column: pa.StringArray, lang: str, every: np.ndarray, owners: np.ndarray, shard: int, part: int | None) -> Iterator[tuple]:
    """``(hashes, tags, texts, count)`` of the phrases that this part of a shard is to name; tag 0 counts all words."""
    words, index, piece = split_words(column)
    if not len(index):
        return
    yield np.zeros(1, np.uint64), np.zeros(1, np.int32), pa.array([""]), len(index)
    word_hash = word_hashes(words)[0]
    hashes = phrase_hashes(word_hash, lang)
    reached = _has(every, hashes)
    word_check = _some_checks(words, reached, lang)
    own = np.flatnonzero(reached & _has(owners, _owner(hashes, shard, part)))
    yield hashes[own], _tags(word_check[own] >> 64 - _CHECK, 1), words.take(pa.array(own)), 0
    place = np.flatnonzero(reached[index])
    sums = word_hash[index[place]]
    for size in range(1, LONGEST):
        at = np.flatnonzero(place[1:] == place[:-1] + 1)
        at = at[piece[place[at]] == piece[place[at] + size]]
        if not len(at):
            return
        place = place[at]
        sums = sums[at] + word_hash[index[place + size]] * _POWERS[size]
        hashes = phrase_hashes(sums, lang)
        kept = np.flatnonzero(_has(every, hashes))
        sums, place, hashes = sums[kept], place[kept], hashes[kept]
        own = np.flatnonzero(_has(owners, _owner(hashes, shard, part)))
        checks = _checks_at(place[own], size + 1, index, word_check)
        order, first = _different(hashes[own], checks)
        own, checks = own[order[first]], checks[order[first]]
        text = pc.binary_join_element_wise(*(words.take(pa.array(index[place[own] + k])) for k in range(size + 1)), " ")
        yield hashes[own], _tags(checks, size + 1), text, 0


def _parts_of(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.StringArray]]:
    """``(lang, texts)`` of a batch in slices of one language each."""
    langs = batch.column(0).dictionary_encode()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        for _, part in slices(batch.column(1).filter(pc.equal(langs.indices, k)), SLICE_BYTES):
            yield lang, part


def _sent(*tables: np.ndarray | None) -> list[bytes | None]:
    """The tables travel compressed."""
    return [None if t is None else zlib.compress(t.tobytes(), 1) for t in tables]


def _received(sent: list[bytes | None]) -> list[np.ndarray | None]:
    return [None if t is None else np.frombuffer(zlib.decompress(t), np.uint64) for t in sent]


def _scan(rows: DataFrame, step: int, now: np.ndarray | None, old: np.ndarray | None) -> DataFrame:
    """``(h, tag, n, place)``: counts of some texts by hash, added up slice by slice, with the step and the part that has them."""
    sent = _sent(now, old)

    def run(batches):
        now, old = _received(sent)
        for b in batches:
            for lang, part in _parts_of(b):
                for size, (hashes, checks), n in count_slice(part, lang, step < SHARDS, now, old):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(_tags(checks, size)), pa.array(n, pa.int64())],
                                                     ["h", "tag", "n"])

    seen = F.spark_partition_id().cast("long").bitwiseXOR(F.col("h")).bitwiseAND(F.lit((1 << _PART) - 1))
    return rows.mapInArrow(run, "h long, tag int, n long").select("h", "tag", "n", (F.lit(step << _PART).cast("long") + seen).alias("place"))


def _named(texts: DataFrame, every: np.ndarray, owners: np.ndarray, placed: bool = True) -> DataFrame:
    """``(h, tag, lang, phrase, n)``: texts of phrases from their owners, or from all parts, and with tag 0 the words of a language."""
    sent = _sent(every, owners)
    names = ["h", "tag", "lang", "phrase", "n"]

    def scan(shard):
        def run(batches):
            every, owners = _received(sent)
            kept, n_kept = [], 0
            for b in batches:
                part = b.column(2)[0].as_py() if placed and b.num_rows else None
                for lang, own in _parts_of(b):
                    for hashes, tags, phrases, n in name_slice(own, lang, every, owners, shard, part):
                        kept.append(pa.RecordBatch.from_arrays([
                            pa.array(hashes.view(np.int64)), pa.array(tags), pa.array([lang], pa.string()).take(pa.array(np.zeros(len(tags), np.int32))),
                            phrases, pa.array(np.full(len(tags), n, np.int64))], names))
                        n_kept += len(tags)
                    if n_kept > KEPT:
                        whole = _added_up(kept)
                        kept, n_kept = whole.to_batches(), whole.num_rows
                        if n_kept > KEPT // 2:
                            yield from kept
                            kept, n_kept = [], 0
            if kept:
                yield from _added_up(kept).to_batches()

        rows = texts.where(F.col("shard") == shard).select("lang", "text", F.spark_partition_id().alias("part"))
        return rows.mapInArrow(run, "h long, tag int, lang string, phrase string, n long")

    out = scan(0)
    for shard in range(1, SHARDS):
        out = out.unionByName(scan(shard))
    return out


def _added_up(parts: list[pa.RecordBatch]) -> pa.Table:
    keys = ["h", "tag", "lang", "phrase"]
    whole = pa.Table.from_batches(parts).group_by(keys, use_threads=False).aggregate([("n", "sum")])
    return whole.select([*keys, "n_sum"]).rename_columns([*keys, "n"]).combine_chunks()


def _bits(reached: DataFrame) -> np.ndarray:
    """The bit table of the phrases ``(h)``; what comes to the driver is bounded by the table."""
    mask = F.lit(BITS - 1).cast("long")
    slots = F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))
    found = (reached.select(F.explode(slots).alias("slot")).groupBy(F.shiftright("slot", 6).alias("cell"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow())
    table = np.zeros(BITS // 64, np.uint64)
    table[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def _owners(reached: DataFrame) -> np.ndarray:
    """The bit table of which part of which shard is to name each of the phrases ``(h, place)``."""
    shard = F.shiftright("place", _PART) % SHARDS
    seen = F.col("place").bitwiseAND(F.lit((1 << _PART) - 1))
    return _bits(reached.select(F.col("h").bitwiseXOR((shard * (1 << _PART) + seen) * F.lit(_SPREAD)).alias("h")))


def phrase_counts(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang") -> DataFrame:
    """``(lang, size, phrase, n)``: every phrase of 1 to 4 words with ``n >= least``, and size 0 for all words of a language.

    Null texts count as empty, null languages as ``und``; repeated rows count each time; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    folder = new_folder(spark, "shards")
    (docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), text.alias("text"),
                 F.pmod(F.xxhash64(F.col(id_col), text), F.lit(SHARDS)).cast("int").alias("shard"))
     .where("text <> ''").write.option("compression", "zstd").partitionBy("shard").parquet(folder))
    texts = spark.read.schema("lang string, text string, shard int").parquet(folder)
    step, state, path, tables = 0, None, None, []
    while True:
        now = _bits(state.where(f"reached is not null and (tag & 7) < {LONGEST}")) if state is not None else None
        old = tables[step - SHARDS] if step >= SHARDS else None
        if step >= SHARDS and np.array_equal(now, old if old is not None else np.zeros_like(now)):
            break  # whatever could become active has been counted in every shard since
        tables.append(now)
        if step >= SHARDS:
            tables[step - SHARDS] = None
        counted = _scan(texts.where(F.col("shard") == step % SHARDS).select("lang", "text"), step, now, old)
        rows = counted.withColumn("reached", F.lit(None).cast("int"))
        if state is not None:
            rows = rows.unionByName(state)
        merged = rows.groupBy("h", "tag").agg(F.sum("n").alias("n"), F.min("place").alias("place"), F.min("reached").alias("reached"))
        merged = merged.withColumn("reached", F.coalesce("reached", F.when(F.col("n") >= least, F.lit(step))))
        # A phrase that was read in every shard and is rare stays so.
        merged = merged.where((F.col("reached").isNotNull()) | (F.shiftright("place", _PART) > step - SHARDS + 1))
        before, path = path, new_folder(spark, f"phrases-{step}")
        merged.write.parquet(path)
        state = spark.read.schema(merged.schema).parquet(path)
        if before:
            remove(spark, before)
        step += 1
    reached = state.where("reached is not null")
    every = _bits(reached)
    names = stored(_named(texts, every, _owners(reached)), "names")
    out = _with_names(reached, names)
    if out.where("size > 0").count() < reached.count():
        # Parts can be cut anew if the cluster changes meanwhile; what its owner did not name then, any part names.
        left = stored(reached.join(names, ["h", "tag"], "left_anti"), "unnamed")
        more = stored(_named(texts, every, _bits(left), False).where("tag <> 0"), "names")
        out = _with_names(reached, names.unionByName(more))
    for old in (folder, path):
        remove(spark, old)
    return out


def _with_names(reached: DataFrame, names: DataFrame) -> DataFrame:
    """``(lang, size, phrase, n)`` of the phrases that have a name, and the words of each language as size 0."""
    texts = names.where("tag <> 0").select("h", "tag", "lang", "phrase").dropDuplicates(["h", "tag"])
    words = names.where("tag = 0").groupBy("lang").agg(F.lit(0).alias("size"), F.lit("").alias("phrase"), F.sum("n").alias("n"))
    return stored(texts.join(reached.select("h", "tag", "n"), ["h", "tag"])
                  .select("lang", F.col("tag").bitwiseAND(F.lit(7)).alias("size"), "phrase", "n").unionByName(words), "phrases")


def collocations(counts: DataFrame, rows: int = ROWS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` from :func:`phrase_counts`, the best ``rows`` of each language.

    Scores are whole quotients of 38-digit decimals.  The parts of a phrase are joined by
    language and text; single words, of which one may be part of very many phrases, also by a
    salt.  A longer phrase hides its parts through an aggregate that combines before its shuffle.
    """
    words = F.split("phrase", " ")
    phrases = counts.where("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")

    def part(first, length):
        return F.array_join(F.slice(words, first, length), " ")

    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("_s", salt).withColumn("_left", part(F.lit(1), F.col("k"))).withColumn(
        "_right", part(F.col("k") + 1, F.col("size") - F.col("k")))
    known = counts.where(f"size between 1 and {LONGEST - 1}").select(
        F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("n").alias("_n"),
        F.explode(F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"))
    for side, is_word, out in (("_left", F.col("k") == 1, "l"), ("_right", F.col("size") - F.col("k") == 1, "r")):
        cuts = cuts.withColumn("_own", F.when(is_word, F.col("_s")).otherwise(F.lit(0)))
        cuts = (cuts.join(known, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_part")) & (F.col("_own") == F.col("_salt")))
                .withColumnRenamed("_n", out).drop("_lang", "_part", "_salt", "_own"))
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000bd) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = cuts.groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_best"))
    inner = phrases.where("size > 2").withColumn("_len", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_len") + 1)))
    hidden = (inner.select("lang", part(F.col("_at"), F.col("_len")).alias("phrase"), F.col("a").alias("_longer"))
              .groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer")))
    big = "decimal(38,0)"
    left = best.join(hidden, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull() | (F.col("_longer").cast(big) * 100 < F.col("a").cast(big) * HIDES))
    chosen = left.select("lang", "phrase", "a", F.col("_best.l").alias("l"), F.col("_best.r").alias("r"), F.col("_best.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part of a language first: the last window sorts at most SALTS * rows of it.
    some = (chosen.withColumn("_s", salt).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order)))
            .where(F.col("_r") <= rows).drop("_r", "_s"))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= rows)
    totals = counts.where("size = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
