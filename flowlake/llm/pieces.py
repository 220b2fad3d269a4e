"""SentencePiece encoding and decoding over a lattice of pieces.

The lattice of a word is a relation: its substrings of bounded length, equi-joined to the piece
table.  For a model of merges the path through the lattice is not the one with the largest sum of
scores but the one its merges lead to, so the fold over a word's edges applies, best score first
and leftmost first, each edge that spans exactly two neighbouring symbols.

Frequent words, a list of bounded size, go through Spark: explode, broadcast join, grouping by word
and a fold with the higher-order ``aggregate``.  The remaining words of a batch, each once, go through
the same lattice and fold in numpy where the texts are read, as sending every word of every
document to a group of its word and back would shuffle several times the input.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import slices, texts, utf8
from flowlake.llm.tokens import gather

#: The sign that stands for a space (a fixed value of the file format).
SPACE_SIGN = "▁"
#: Words encoded by the relational lattice beforehand, and the least count in a batch of a candidate.
FREQUENT, LEAST_COUNT = 1 << 15, 8
#: Characters whose lattice is in memory at a time, and the length from which a word is folded alone.
_CHARS, _LONG = 1 << 18, 128
#: Bytes of texts encoded at a time.
_SLICE = 3 << 20
_NONE = 1 << 20
_BASE = 0x9E3779B97F4A7C15


@dataclass
class Model:
    """Pieces that merges can make, by length and hash; ids of bytes; what each id stands for."""

    pieces: list
    longest: int
    hashes: dict
    ranks: dict
    ids: dict
    single: dict
    byte_ids: np.ndarray
    raw: np.ndarray
    raw_starts: np.ndarray
    raw_lengths: np.ndarray


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _hash(points: np.ndarray) -> int:
    h = 0
    for p in points.tolist():
        h = (h * _BASE + p + 1) % (1 << 64)
    return h


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in plain]
    if any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p, _, _ in pieces):
        raise ValueError("pieces that cross words are not supported")
    order = {s: k for k, s in enumerate(sorted({s for _, _, s in pieces}, reverse=True))}
    byte_ids = np.zeros(256, np.int32)
    raw = [b""] * size
    for i in range(size):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            raw[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
    for p, i, _ in pieces:
        raw[i] = p.replace(SPACE_SIGN, " ").encode()
    by_length: dict[int, list] = {}
    for p, i, s in pieces:
        by_length.setdefault(len(p), []).append((_hash(np.array([ord(c) for c in p])), order[s], i))
    hashes, ranks, ids = {}, {}, {}
    for n, rows in by_length.items():
        rows.sort()
        hashes[n] = np.array([r[0] for r in rows], np.uint64)
        ranks[n], ids[n] = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int32)
    lengths = np.array([len(x) for x in raw], np.int64)
    return Model([(p, i, order[s]) for p, i, s in pieces], max(by_length), hashes, ranks, ids,
                 {p: i for p, i, _ in pieces if len(p) == 1}, byte_ids, np.frombuffer(b"".join(raw), np.uint8),
                 np.cumsum(lengths) - lengths, lengths)


def fold_words(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words (spaces written as the sign) one after another, and how many each has."""
    sizes = np.array([len(w) for w in words], np.int64)
    if not len(words):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    order = np.argsort(sizes > _LONG, kind="stable")  # short words first, long ones by themselves
    ids, lengths, i, n_short = [], [], 0, int((sizes <= _LONG).sum())
    ends = np.cumsum(sizes[order])
    while i < len(words):
        j = i + 1 if i >= n_short else min(n_short, max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _CHARS))))
        got = _fold(model, [words[k] for k in order[i:j]])
        ids.append(got[0])
        lengths.append(got[1])
        i = j
    of_word = np.concatenate(lengths)
    starts, counts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    starts[order], counts[order] = np.cumsum(of_word) - of_word, of_word
    return gather(np.concatenate(ids), starts, counts), counts


def _lattice(model: Model, points: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and id by length and start of every substring that is a piece: an equi-join by hash."""
    rank = np.full((model.longest + 1, len(points)), _NONE, np.int32)
    ids = np.full((model.longest + 1, len(points)), -1, np.int32)
    h = np.zeros(len(points), np.uint64)
    here = np.arange(len(points))
    for n in range(1, model.longest + 1):
        here = here[room[here] >= n]
        if not len(here):
            break
        h[here] = h[here] * np.uint64(_BASE) + points[here + n - 1].astype(np.uint64) + np.uint64(1)
        if n in model.hashes:
            at = np.minimum(np.searchsorted(model.hashes[n], h[here]), len(model.hashes[n]) - 1)
            hit = model.hashes[n][at] == h[here]
            rank[n, here[hit]], ids[n, here[hit]] = model.ranks[n][at[hit]], model.ids[n][at[hit]]
    return rank, ids


def _merge_long(rank: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The fold of one long word with a heap of its edges."""
    n = rank.shape[1]
    after, before, length = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and length[i] + length[j] <= longest:
            r = int(rank[length[i] + length[j], i])
            if r < _NONE:
                heapq.heappush(heap, (r, i, length[i], length[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, x, y = heapq.heappop(heap)
        j = after[i]
        if length[i] != x or j >= n or length[j] != y:
            continue
        length[i], length[j] = x + y, 0
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    sizes = np.array(length, np.int64)
    return np.flatnonzero(sizes), sizes[sizes > 0]


def _merge(rank: np.ndarray, word: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The fold of many words at once: in each round every word takes its best edge over two neighbours."""
    start, length = np.arange(len(word)), np.ones(len(word), np.int64)
    done_start, done_length = [], []
    while len(start):
        own = word[start]
        both = length[:-1] + length[1:]
        value = np.full(len(start), _NONE, np.int64)
        fits = (own[:-1] == own[1:]) & (both <= longest)
        value[:-1][fits] = rank[both[fits], start[:-1][fits]]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        best = np.minimum.reduceat(value << 40 | np.arange(len(start)), first)
        alive = best < _NONE << 40
        left = best[alive] & ((1 << 40) - 1)
        length[left] += length[left + 1]
        stay = np.ones(len(start), bool)
        stay[left + 1] = False
        over = ~np.repeat(alive, np.diff(np.append(first, len(start))))
        done_start.append(start[over])
        done_length.append(length[over])
        start, length = start[stay & ~over], length[stay & ~over]
    start, length = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (done_start, done_length))
    order = np.argsort(start)
    return start[order], length[order]


def _fold(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w) for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    rank, ids = _lattice(model, points, np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points)))
    if len(words) == 1 and len(points) > _LONG:
        start, length = _merge_long(rank, model.longest)
    else:
        start, length = _merge(rank, word, model.longest)
    found = ids[length, start]
    count = np.ones(len(found), np.int64)
    unknown = np.flatnonzero(found < 0)
    spelled = [chr(p).encode() for p in points[start[unknown]].tolist()]
    count[unknown] = [len(b) for b in spelled]
    out = np.repeat(found, count)
    out[out < 0] = model.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
    total = np.concatenate([[0], np.cumsum(count)])
    of_word = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    return out, np.diff(total[of_word])


def _segments(column: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Words with the spaces before them, each text behind one space; and each text's first word."""
    column = pc.replace_substring(column, SPACE_SIGN, " ")  # the sign itself is read as a space
    filled = pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(" ", column, ""))
    raw, offsets = utf8(filled)
    starts = raw == 32
    starts[1:] &= raw[:-1] != 32
    starts[offsets[:-1][offsets[:-1] < len(raw)]] = True
    at = np.flatnonzero(starts).astype(np.int32)
    bounds = np.append(at, np.int32(len(raw)))
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw)))
    return words, np.searchsorted(at, offsets)


def encode_column(model: Model, column: pa.StringArray, known: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each has; ``known`` has ``(words, ids, lengths)``."""
    words, first = _segments(column)
    coded = words.dictionary_encode()
    index, own = coded.indices.to_numpy(), pc.replace_substring(coded.dictionary, " ", SPACE_SIGN)
    new = np.ones(len(own), bool)
    starts, lengths = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    pool = np.empty(0, np.int32)
    if known is not None and len(known[0]):
        found = pc.index_in(own, value_set=known[0])
        new = pc.is_null(found).to_numpy(zero_copy_only=False)
        at = found.fill_null(0).to_numpy()[~new]
        pool, sizes = known[1], known[2]
        starts[~new], lengths[~new] = (np.cumsum(sizes) - sizes)[at], sizes[at]
    ids, sizes = fold_words(model, own.filter(pa.array(new)).to_pylist())
    starts[new], lengths[new] = len(pool) + np.cumsum(sizes) - sizes, sizes
    of_word = lengths[index]
    total = np.concatenate([[0], np.cumsum(of_word)])
    return gather(np.concatenate([pool, ids]), starts[index], of_word), np.diff(total[first])


def decode_ids(model: Model, ids: np.ndarray, counts: np.ndarray) -> pa.BinaryArray:
    """The UTF-8 texts of the ids of several documents; the space put before each is taken off."""
    sizes = model.raw_lengths[ids]
    data = gather(model.raw, model.raw_starts[ids], sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    bounds = total[np.concatenate([[0], np.cumsum(counts)])]
    keep = np.ones(len(data), bool)
    heads = bounds[:-1][np.diff(bounds) > 0]
    keep[heads[data[heads] == 32]] = False
    bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data[keep])])


def encode_words(words: DataFrame, path: str | None = None) -> DataFrame:
    """``(word, ids)`` of different words, as relations: lattice by explode and join, grouping, fold."""
    spark, model = words.sparkSession, load(path or default_path())
    table = spark.createDataFrame(model.pieces, "piece string, id int, rank int")  # as large as the vocabulary
    begin = F.explode(F.expr("sequence(0, char_length(word) - 1)")).alias("s")
    ends = F.explode(F.expr(f"sequence(s + 1, least(s + {model.longest}, char_length(word)))")).alias("e")
    spans = words.select("word", begin).select("word", "s", ends).withColumn("piece", F.expr("substring(word, s + 1, e - s)"))
    edges = (spans.join(F.broadcast(table), "piece").groupBy("word")
             .agg(F.collect_list(F.struct("rank", "s", "e", "id")).alias("edges")))
    rows = words.join(edges, "word", "left").withColumn(
        "edges", F.coalesce("edges", F.expr("cast(array() as array<struct<rank:int,s:int,e:int,id:int>>)")))
    best = "array_min(filter(edges, x -> array_position(at, x.s) > 0 and get(at, cast(array_position(at, x.s) + 1 as int)) = x.e))"
    rows = rows.withColumn("path", F.expr(
        f"aggregate(sequence(1, char_length(word)), sequence(0, char_length(word)), (at, k) -> "
        f"transform(array({best}), b -> if(b is null, at, filter(at, p -> p <= b.s or p >= b.e)))[0])"))
    byte_ids = f"array({', '.join(map(str, model.byte_ids.tolist()))})"
    rows = rows.withColumn("byte_ids", F.expr(byte_ids))
    spelled = ("transform(sequence(0, octet_length(substring(word, path[k] + 1, 1)) - 1), j -> byte_ids[cast(conv("
               "substring(hex(encode(substring(word, path[k] + 1, 1), 'utf-8')), 2 * j + 1, 2), 16, 10) as int)])")
    return rows.select("word", F.expr(
        "flatten(transform(sequence(0, size(path) - 2), k -> coalesce(get(transform(filter(edges, "
        f"x -> x.s = path[k] and x.e = path[k + 1]), x -> array(x.id)), 0), {spelled})))").alias("ids"))


def frequent_words(rows: DataFrame, most: int = FREQUENT) -> DataFrame:
    """``(word)``: the most frequent words, counted over all texts among words that a batch has several times.

    The list decides only where a word is encoded, never what its ids are.
    """

    def run(batches):
        for b in batches:
            for _, part in slices(b.column(0)):
                counted = pc.value_counts(pc.replace_substring(_segments(part)[0], " ", SPACE_SIGN))
                often = counted.filter(pc.greater_equal(counted.field("counts"), LEAST_COUNT))
                yield pa.RecordBatch.from_arrays([often.field("values"), often.field("counts")], ["word", "n"])

    counted = rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where("char_length(word) <= 64").orderBy(F.desc("n"), "word").limit(most).select("word")


def _frequent(rows: DataFrame, path: str) -> tuple | None:
    """The frequent words with their ids from the relational lattice: at most ``FREQUENT`` of them."""
    found = encode_words(frequent_words(rows), path).toArrow()
    if not found.num_rows:
        return None
    lists = found["ids"].combine_chunks()
    return (found["word"].combine_chunks(), lists.flatten().to_numpy().astype(np.int32),
            np.diff(lists.offsets.to_numpy()).astype(np.int64))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, text)`` of every whole text; null and empty texts have no ids, as the library has it."""
    path = path or default_path()
    rows = texts(docs, id_col, text_col)
    known = _frequent(rows, path)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), rows.schema["text"]])
    names = schema.names

    def run(batches):
        for b in batches:
            for first, part in slices(b.column(1), _SLICE):
                ids, n = encode_column(load(path), part, known)
                bounds = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(part)), lists, part], names)

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``, added; other columns stay."""
    path = path or default_path()
    at, names = encoded.columns.index("ids"), [*encoded.columns, "decoded"]
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        for b in batches:
            lists = b.column(at)
            bounds = lists.offsets.to_numpy()
            text = decode_ids(load(path), lists.values.to_numpy()[bounds[0]:bounds[-1]], np.diff(bounds))
            yield pa.RecordBatch.from_arrays([*b.columns, text.cast(pa.string())], names)

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_pieces, ids_crc32, same)``: checksum of the ids, and whether decoding gives the text back.

    Encodes and decodes in one pass, so the ids of the corpus are never stored or sent.
    """
    path = path or default_path()
    rows = texts(docs, id_col, text_col)
    known = _frequent(rows, path)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_pieces", T.LongType()),
                           T.StructField("ids_crc32", T.LongType()), T.StructField("same", T.BooleanType())])
    names = schema.names

    def run(batches):
        for b in batches:
            for first, part in slices(b.column(1), _SLICE):
                ids, n = encode_column(load(path), part, known)
                bounds, flat = np.concatenate([[0], np.cumsum(n)]), ids.astype("<u4")
                crc = [zlib.crc32(flat[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
                same = pc.equal(part.cast(pa.binary()), decode_ids(load(path), ids, n))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(part)), pa.array(n, pa.int64()),
                                                  pa.array(crc, pa.int64()), same], names)

    return rows.mapInArrow(run, schema)
