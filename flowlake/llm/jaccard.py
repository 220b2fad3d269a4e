"""Documents whose sets of word runs have a Jaccard similarity of at least a threshold.

Equal texts are one *class* and go through once.  MinHash bands name candidates; inside a bucket
MinHash values are compared a few at a time, and a pair is dropped as soon as the posterior
probability of reaching the threshold falls below a tolerance.  Components of what survives hold
every link, and all pairs inside a component are verified exactly.  Buckets and components are
cut into blocks, and pairs of blocks are separate pieces of work, so no group meets in one task;
pairs are counted inside a task and never become rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import rows_of, slices, stored, texts
from flowlake.llm.graph import components
from flowlake.llm.words import shingle_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Bands of values; a pair at the threshold of 0.8 misses all of 24 bands of 4 once in 300,000.
BANDS, BAND = 24, 4
HASHES = BANDS * BAND
#: Values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 4e-7
#: Members of a block of a bucket, and of a component.
BUCKET_BLOCK, CLUSTER_BLOCK = 256, 128
#: Largest list of ids that is broadcast, in rows; a longer one is joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Texts hashed in one numpy pass, in bytes.
TEXT_BYTES = 2 << 20
_CHUNK = 1 << 16


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7919)
    return (r.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            r.integers(0, 1 << 63, HASHES, dtype=np.uint64))


def minhashes(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``(texts, HASHES)`` values; a text without shingles has the largest ones."""
    out = np.full((len(first) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first))
    a, b = _functions()
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(first[full], first[full[i]] + _CHUNK)))
        low = first[full[i]]
        part, at = shingles[low:first[full[j - 1] + 1]], first[full[i:j]] - low
        for k in range(HASHES):
            out[full[i:j], k] = np.minimum.reduceat((part * a[k] + b[k]) >> np.uint64(32), at)
        i = j
    return out


def _key(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def sketches(rows: DataFrame) -> DataFrame:
    """``(doc_id, key, n, sig)`` of ``(doc_id, text)``: key of the word sequence, shingles, MinHash values."""
    schema = T.StructType([rows.schema["doc_id"], T.StructField("key", T.BinaryType()),
                           T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType())])

    def run(batches):
        for b in batches:
            for at, part in slices(b.column(1), TEXT_BYTES):
                words, of = word_hashes(part)
                shingles, first = shingle_hashes(part, SHINGLE)
                sig = minhashes(shingles, first)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(part)),
                     pa.array([_key(words[x:y]) for x, y in zip(of[:-1], of[1:])], pa.binary()),
                     pa.array(np.diff(first), pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


@lru_cache(maxsize=8)
def fewest_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """After each step the fewest equal values a pair may have: below, its posterior is under the tolerance.

    With a uniform prior the similarity has a Beta(m + 1, n - m + 1) posterior after m of n equal
    values, and it reaches t with the probability that a binomial of n + 1 draws at t stays below m + 1.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def pruning_loss(similarity: float, least: tuple[int, ...]) -> float:
    """The probability that a pair of this similarity falls below ``least`` at some step."""
    alive, lost = {0: 1.0}, 0.0
    for fewest in least:
        new: dict[int, float] = {}
        for m, p in alive.items():
            for k in range(STEP + 1):
                new[m + k] = new.get(m + k, 0.0) + p * comb(STEP, k) * similarity ** k * (1 - similarity) ** (STEP - k)
        lost += sum(p for m, p in new.items() if m < fewest)
        alive = {m: p for m, p in new.items() if m >= fewest}
    return lost


def plausible(sig: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which of the pairs keep a posterior above the tolerance at every step."""
    alive, equal = np.arange(len(left)), np.zeros(len(left), np.int16)
    for step, least in enumerate(fewest_matches(threshold, tolerance)):
        part = slice(step * STEP, (step + 1) * STEP)
        equal = equal + (sig[left[alive], part] == sig[right[alive], part]).sum(1, dtype=np.int16)
        stay = equal >= least
        alive, equal = alive[stay], equal[stay]
    return alive


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index each of ``n`` members is linked to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _groups(batches: Iterator[pa.RecordBatch], keys: int, most: int = 8 << 20) -> Iterator[pa.Table]:
    """Rows that lie in order of their first ``keys`` columns, handed on in tables of whole groups."""
    held, size = [], 0

    def cut(table: pa.Table) -> tuple[pa.Table, pa.Table]:
        same = np.ones(table.num_rows, bool)
        for k in range(keys):
            v = table.column(k).to_numpy()
            same &= v == v[-1]
        n = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        return table.slice(0, n), table.slice(n)

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
            if size >= most:
                whole, rest = cut(pa.Table.from_batches(held))
                if whole.num_rows:
                    yield whole
                held, size = rest.combine_chunks().to_batches(), rest.nbytes // 2
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in range(keys):
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _cells(members: DataFrame, group: str, size: str, block: int, *values: str) -> DataFrame:
    """Members of a group dealt to blocks by hash; a row for each pair of blocks its block is part of."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int")
    rows = members.withColumn("_blocks", blocks).withColumn("own", own)
    rows = rows.withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
    return rows.select(group, F.least("own", "_other").alias("lo"), F.greatest("own", "_other").alias("hi"), "own", *values)


def _candidates(reps: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges ``(a, b)`` of keys: a star for each part of a bucket whose pairs survive the comparison."""
    bands = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sig, i * {4 * BAND} + 1, {4 * BAND})))")
    rows = reps.select("key", F.explode(bands).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = _cells(rows.join(shared, "bucket"), "bucket", "size", BUCKET_BLOCK, "key")
    cells = (members.join(reps.select("key", "sig"), "key").select("bucket", "lo", "hi", "own", "key", "sig")
             .repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi"))

    def run(batches):
        for table in _groups(batches, 3):
            table = table.combine_chunks()
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, HASHES)
            own, within = table["own"].to_numpy(), table["lo"].to_numpy() == table["hi"].to_numpy()
            starts = _starts(table, 3)
            ends = np.append(starts[1:], table.num_rows)
            last = np.repeat(ends, ends - starts)
            here = np.arange(table.num_rows)
            left, right = [], []
            for d in range(1, int((ends - starts).max())):
                here = here[here + d < last[here]]
                pick = here[within[here] | (own[here] != own[here + d])]
                found = plausible(sig, pick, pick + d, threshold, tolerance)
                left.append(pick[found])
                right.append(pick[found] + d)
            left, right = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
            root = _roots(table.num_rows, left, right)
            linked = np.flatnonzero(root != np.arange(table.num_rows))
            keys = table["key"].combine_chunks()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(linked)), keys.take(pa.array(root[linked]))], ["a", "b"])

    return cells.mapInArrow(run, "a binary, b binary")


def _shingle_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(key, set)``: the sorted different shingles of the wanted classes, from the text of one document each."""
    ids = wanted.select(F.col("rep_id").alias("_rep"))
    few = wanted.count() <= BROADCAST_ROWS
    chosen = rows.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi").select("text")

    def run(batches):
        for b in batches:
            for _, part in slices(b.column(0), TEXT_BYTES):
                words, of = word_hashes(part)
                shingles, first = shingle_hashes(part, SHINGLE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_key(words[x:y]) for x, y in zip(of[:-1], of[1:])], pa.binary()),
                     pa.array([np.unique(shingles[x:y]).tobytes() for x, y in zip(first[:-1], first[1:])], pa.binary())], ["key", "set"])

    return chosen.mapInArrow(run, "key binary, set binary").groupBy("key").agg(F.first("set").alias("set"))


def _verified(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``(key, root, links, texts)`` for each member and piece of work: what it is linked to exactly."""
    ratio = Fraction(threshold).limit_denominator(10_000)
    top, bottom = ratio.numerator, ratio.denominator
    cells = (_cells(members, "root", "members", CLUSTER_BLOCK, "key", "size").join(sets, "key")
             .select(F.xxhash64("root").alias("cell"), "lo", "hi", "own", "key", "size", "set")
             .repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "key"))

    def run(batches):
        for table in _groups(batches, 3):
            starts = _starts(table, 3)
            keys, sizes, own = table["key"].to_pylist(), table["size"].to_numpy(), table["own"].to_numpy()
            lo, hi, column = table["lo"].to_numpy(), table["hi"].to_numpy(), table["set"].combine_chunks()
            out = [[], [], [], []]
            for x, y in zip(starts, np.append(starts[1:], table.num_rows)):
                if y - x < 2:
                    continue
                one = np.arange(x, y)
                parts = [np.frombuffer(column[int(i)].as_buffer(), np.uint64) for i in one]
                n = np.array([len(p) for p in parts])
                _, code = np.unique(np.concatenate(parts), return_inverse=True)
                at = np.cumsum(n) - n
                mark = np.zeros(int(code.max()) + 1, np.int32)
                whole, mine, weight = lo[x] == hi[x], own[one], sizes[one]
                links, texts_, left, right = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), [], []
                for i in range(len(one)):
                    if not whole and mine[i] != lo[x]:
                        continue
                    mark[code[at[i]:at[i] + n[i]]] = 1
                    both = np.add.reduceat(mark[code], at)
                    mark[code[at[i]:at[i] + n[i]]] = 0
                    near = both * (top + bottom) >= top * (n + n[i])
                    near &= (np.arange(len(one)) > i) if whole else (mine == hi[x])
                    j = np.flatnonzero(near)
                    links[i] += weight[j].sum()
                    links[j] += weight[i]
                    texts_[i] += len(j)
                    texts_[j] += 1
                    left.append(np.full(len(j), i))
                    right.append(j)
                root = _roots(len(one), np.concatenate(left), np.concatenate(right))
                some = np.flatnonzero(texts_)
                for c, v in zip(out, ([keys[i] for i in one[some]], [keys[i] for i in one[root[some]]],
                                      links[some].tolist(), texts_[some].tolist())):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()),
                                              pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
                                             ["key", "root", "links", "texts"])

    return cells.mapInArrow(run, "key binary, root binary, links long, texts long")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                  tolerance: float = TOLERANCE) -> DataFrame:
    """``(doc_id, class_id, class_size, n_links, n_linked_texts)``, one row per document.

    ``n_links`` counts the other documents at least as similar as the threshold, equal texts
    included; ``n_linked_texts`` the different texts among them.  ``class_id`` is the smallest id
    that links lead to, ``class_size`` its documents.  Words are separated by white space; a text
    of one to four words is one run of words, so only equal ones are linked.  Null texts and
    texts without a word have no links.  An empty table gives no rows.
    """
    rows = texts(docs, id_col, text_col)
    every = stored(sketches(rows), "sketches")
    reps = stored(every.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("rep_id"), F.count("*").alias("size"), F.first("sig").alias("sig")), "classes")
    clusters = components(_candidates(reps, threshold, tolerance))
    sizes = clusters.groupBy("root").agg(F.count("*").alias("members"))
    members = stored(clusters.withColumnRenamed("node", "key").join(sizes, "root").join(reps.drop("sig"), "key"), "members")
    found = stored(_verified(members.drop("rep_id"), _shingle_sets(rows, members), threshold), "links")
    near = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    linked = near.withColumnRenamed("node", "key").join(links, "key", "left").join(members.select("key", "rep_id", "size"), "key")
    totals = linked.groupBy("root").agg(F.min("rep_id").alias("class_id"), F.sum("size").alias("class_size"))
    linked = linked.join(totals, "root").select("key", "class_id", "class_size", "links", "texts")
    info = (reps.select("key", "rep_id", "size").join(linked, "key", "left").select(
        "key", F.coalesce("class_id", "rep_id").alias("class_id"), F.coalesce("class_size", "size").alias("class_size"),
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_linked_texts")))
    return every.select("doc_id", "key", "n").join(info, "key", "left").select(
        "doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        *[F.when(F.col("n") > 0, F.col(c)).otherwise(v).cast("long").alias(c)
          for c, v in (("class_size", 1), ("n_links", 0), ("n_linked_texts", 0))])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the smallest id of each group of linked documents, all columns as they were.

    Rows that share an id stay or go together; a null id goes if its group has another.
    """
    links = stored(jaccard_links(docs, id_col, text_col, threshold), "verdicts")
    stay = links.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("_stays"))
    gone = stored(stay.where("not _stays").select("doc_id"), "copies")
    few = gone.count() <= BROADCAST_ROWS
    own = rows_of(docs, F.col(id_col).alias("_id"))
    return own.join(F.broadcast(gone) if few else gone, F.col("_id").eqNullSafe(F.col("doc_id")), "left_anti").select("_row.*")
