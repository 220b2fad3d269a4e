"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts and unlabelled texts are learned from.  The risk of a classifier is
estimated as ``prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])``; when the
second part falls below zero its gradient is reversed, so the classifier cannot win by calling
every unlabelled text clean.  Training is numpy on a bounded sample, scoring is a map over all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import slices, texts
from flowlake.llm.words import LETTERS, prefix_hashes, word_hashes

#: Labelled toxic documents learned from, and unlabelled documents that the gradient steps use, taken by
#: hash of their id; frequencies and the bound of the class prior come from all documents.
MAX_POSITIVE, MAX_UNLABELLED = 2500, 5000
#: Beginnings of words that are features beside whole words, in bytes; features the classifier weighs.
PREFIXES, FEATURES = range(4, 9), 1024
STEPS, LEARNING_RATE, DECAY = 400, 0.1, 1e-3


def _features(column: pa.StringArray):
    """Pairs ``(text numbers, 32-bit codes)``: of the whole words, then of each length of beginnings."""
    column = pc.utf8_lower(column)
    hashes, first = word_hashes(column, LETTERS)
    text = np.repeat(np.arange(len(first) - 1, dtype=np.uint32), np.diff(first))
    yield text, (hashes >> np.uint64(32)).astype(np.uint32)
    for words, codes in prefix_hashes(column, PREFIXES, LETTERS):
        if words is not None:
            yield text[words], (codes >> np.uint64(32)).astype(np.uint32)


def _pairs(parts: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, first)`` of the different pairs, text by text."""
    found = np.unique(np.concatenate([t.astype(np.uint64) << np.uint64(32) | c for t, c in parts]))
    return ((found & np.uint64(0xFFFFFFFF)).astype(np.uint32),
            np.searchsorted(found, np.arange(n + 1, dtype=np.uint64) << np.uint64(32)))


def present(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, first)``: the different features of each text, case and position left out."""
    return _pairs(list(_features(column)), len(column))


@dataclass
class Classifier:
    """Sorted feature codes, a weight for each, and the bias."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float

    def decisions(self, column: pa.StringArray) -> np.ndarray:
        total = np.zeros(len(column))
        if len(self.codes):
            likely = np.zeros(1 << 16, bool)
            likely[self.codes >> 16] = True
            parts = []
            for text, code in _features(column):
                some = np.flatnonzero(likely[code >> 16])
                text, code = text[some], code[some]
                known = self.codes[np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)] == code
                parts.append((text[known], code[known]))
            code, first = _pairs(parts, len(column))
            np.add.at(total, np.repeat(np.arange(len(column)), np.diff(first)), self.weights[np.searchsorted(self.codes, code)])
        return self.bias + total

    def scores(self, column: pa.StringArray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.decisions(column), -40, 40)))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 4 == 2, F.lit(False))


def frequent_codes(toxic: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of at least two toxic texts, and in how many each is."""
    codes, n = np.unique(toxic[0], return_counts=True)
    return codes[n > 1], n[n > 1]


def choose_features(codes: np.ndarray, in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int, n: int = FEATURES) -> np.ndarray:
    """The codes whose document frequency differs most for its sampling error, sorted."""
    n_p, n_u = max(1, n_p), max(1, n_u)
    share = (in_p + in_u + 1) / (n_p + n_u)
    score = (in_p / n_p - in_u / n_u) / np.sqrt(share * (1 / n_p + 1 / n_u))
    return np.sort(codes[np.argsort(-np.abs(score), kind="stable")[:n]])


def dense(sample: tuple, codes: np.ndarray) -> np.ndarray:
    """0/1 rows of the chosen features and a last column of ones, in an order of their own content."""
    code, first = sample
    out = np.zeros((len(first) - 1, len(codes) + 1), bool)
    out[:, -1] = True
    if len(codes):
        column = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        known = codes[column] == code
        out[np.repeat(np.arange(len(first) - 1), np.diff(first))[known], column[known]] = True
    packed = np.packbits(out, axis=1)
    return out[np.lexsort(packed.T[::-1])].astype(np.float32) if len(out) else out.astype(np.float32)


def levels(xp: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decision values of the toxic texts at some ranks, and the share of toxic texts at or above each."""
    z = xp @ w
    at = np.quantile(z, np.linspace(0.02, 0.7, 35))
    return at, (z[None, :] >= at[:, None]).mean(1)


def descend(xp: np.ndarray, xu: np.ndarray, prior: float) -> np.ndarray:
    """Weights, the bias last, of the least non-negative risk on the way of a decaying descent.

    The steps shrink to nothing, so the way ends, and the rows' own order fixes every sum: the same
    rows give the same weights however they were read.
    """
    w, m, v = (np.zeros(xp.shape[1]) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior)) if prior < 1 else 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    least, best = np.inf, w
    for step in range(1, STEPS + 1):
        zp, zu = xp @ w, xu @ w
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        risk = prior * np.logaddexp(0, -zp).mean() + max(0, negative) + DECAY / 2 * (w[:-1] ** 2).sum()
        if risk < least:
            least, best = risk, w
        as_toxic = prior * (xp.T @ (sp - 1)) / len(xp)
        as_clean = xu.T @ su / len(xu) - prior * (xp.T @ sp) / len(xp)
        gradient = as_toxic + as_clean if negative >= 0 else -as_clean
        gradient[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        w = w - LEARNING_RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return best


def _sample(docs: DataFrame, ids: DataFrame) -> tuple:
    """Features of the texts of a bounded list of ids."""
    rows = texts(docs).join(F.broadcast(ids), "doc_id", "left_semi").select("text")

    def run(batches):
        for b in batches:
            for _, part in slices(b.column(0), 4 << 20):
                codes, first = present(part)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(
                    pa.array(first, pa.int32()), pa.array(codes.view(np.int32)))], ["codes"])

    found = rows.mapInArrow(run, "codes array<int>").toArrow()["codes"].combine_chunks()
    if not len(found):
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    return found.values.to_numpy().view(np.uint32), found.offsets.to_numpy().astype(np.int64)


def _summed(rows: DataFrame, n: int, count) -> np.ndarray:
    """``count(column)``, ``n`` whole numbers for a column of texts, added up over all texts of ``(text)``."""
    def run(batches):
        total = np.zeros(n, np.int64)
        for b in batches:
            for _, part in slices(b.column(0), 4 << 20):
                total += count(part)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    found = rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n, np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learn from ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``, held-out rows left out of both.

    The class prior is the share of toxic rows among the labelled ones that may be learned from.
    The first classifier bounds it: no score is exceeded by fewer than ``prior`` times as many
    unlabelled as toxic texts; the second one learns with the smaller prior.  All documents count
    as unlabelled, as the risk estimator needs it: frequencies and the bound come from every one
    of them, the gradient from a sample.  Repeated ids count as often as they occur, but enter
    the list of ids once; null and empty texts are texts without features.  Without toxic labels
    the classifier calls everything clean.
    """
    usable = labels.where(~held_out() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    prior = float(usable.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0)
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = usable.where("toxic = 1").select("doc_id").distinct().orderBy(*by_hash).limit(MAX_POSITIVE)
    toxic = _sample(docs, some)
    if len(toxic[1]) < 2 or prior <= 0:
        return Classifier(np.empty(0, np.uint32), np.empty(0), -40.0)
    unlabelled = texts(docs.where(~held_out())).select("text")
    codes, in_p = frequent_codes(toxic)

    def documents_with(part: pa.StringArray) -> np.ndarray:
        code, first = present(part)
        if not len(codes):
            return np.array([len(first) - 1])
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        return np.append(np.bincount(at[codes[at] == code], minlength=len(codes)), len(first) - 1)

    in_u = _summed(unlabelled, len(codes) + 1, documents_with)
    chosen = choose_features(codes, in_p, len(toxic[1]) - 1, in_u[:-1], int(in_u[-1]))
    other = docs.where(~held_out()).select("doc_id").distinct().orderBy(*by_hash).limit(MAX_UNLABELLED)
    xp, xu = dense(toxic, chosen), dense(_sample(docs, other), chosen)
    if not len(xu):
        return Classifier(np.empty(0, np.uint32), np.empty(0), -40.0)
    w = descend(xp, xu, prior)
    at, shares = levels(xp, w)
    first = Classifier(chosen, w[:-1], float(w[-1]))
    above = _summed(unlabelled, len(at), lambda part: (first.decisions(part)[None, :] >= at[:, None] - 1e-9).sum(1))
    n = max(1, int(in_u[-1]))
    w = descend(xp, xu, min(prior, max(1 / n, float((above / n / shares).min()))))
    return Classifier(chosen, w[:-1], float(w[-1]))


def score(docs: DataFrame, classifier: Classifier, threshold: float = 0.3, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every whole text; null and empty texts get the bias alone."""
    rows = texts(docs, id_col, text_col).select("doc_id", held_out().alias("held_out"), "text")
    schema = T.StructType([rows.schema["doc_id"], rows.schema["held_out"], T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for b in batches:
            for first, part in slices(b.column(2), 4 << 20):
                s = classifier.scores(part)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(part)), b.column(1).slice(first, len(part)), pa.array(s),
                     pa.array((s >= threshold).astype(np.int32))], schema.names)

    return rows.mapInArrow(run, schema)
