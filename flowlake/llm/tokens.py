"""Token ids of whole Arrow columns, each different word encoded once per batch.

Byte-level BPE files cut a text into words before they merge, and a lone space or line feed
between two other characters always starts a new word.  Cutting there leaves the ids as they
are, so a column is cut with numpy, its different pieces are encoded by the tokenizers library,
and the ids are gathered back.  Texts with other Unicode spaces are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from flowlake.llm.common import utf8

#: Encoded words that a worker keeps between batches.
KEPT_WORDS = 1 << 18
#: Characters that the library may take for a space and the cut does not.
ODD_SPACE = "[\x1c-\x1f\u0085\u00a0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"
_JOINED = 2000
_encoders: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> "Encoder":
    """The worker's encoder of this file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``pool[s:s + n]``, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class Encoder:
    def __init__(self, path: str, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        cut = rules.get("pre_tokenizer") or {}
        self.cuts = (cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space")
                     and cut.get("use_regex", True) and not rules.get("normalizer"))
        marks = [t for t in rules.get("added_tokens", ()) if t.get("special") and not (
            t.get("lstrip") or t.get("rstrip") or t.get("single_word"))]
        self.mark = marks[0]["content"] if marks else None
        self.mark_id = marks[0]["id"] if marks else None
        self.kept = kept
        self.words = pa.array([], pa.string())
        self.ids, self.starts, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        ids, lengths = [], np.zeros(len(words), np.int64)
        joined = [i for i, w in enumerate(words) if self.mark and self.mark not in w]
        single = range(len(words)) if not self.mark else [i for i, w in enumerate(words) if self.mark in w]
        order = [*joined, *single]
        for i in range(0, len(joined), _JOINED):
            group = joined[i:i + _JOINED]
            line = self.mark.join([words[j] for j in group])
            got = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.int32)
            is_mark = got == self.mark_id
            lengths[group] = np.diff(np.concatenate([[-1], np.flatnonzero(is_mark), [len(got)]])) - 1
            ids.append(got[~is_mark])
        for j in single:
            got = np.array(self.tokenizer.encode(words[j], add_special_tokens=False).ids, np.int32)
            lengths[j] = len(got)
            ids.append(got)
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        return gather(flat, starts, lengths), lengths

    def _segments(self, column: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The pieces of all texts, and for each text the number of its first piece."""
        raw, offsets = utf8(column)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        starts[:-1] &= ~space[1:]
        if not self.cuts:
            starts[:] = False
        else:
            odd = pc.match_substring_regex(column, ODD_SPACE).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(odd):
                starts[offsets[i]:offsets[i + 1]] = False
        starts[offsets[:-1][offsets[:-1] < len(raw)]] = True
        at = np.flatnonzero(starts).astype(np.int32)
        bounds = np.append(at, np.int32(len(raw)))
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw)))
        return pieces, np.searchsorted(at, offsets)

    def encode(self, column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        if not len(column):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        pieces, first = self._segments(column)
        coded = pieces.dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary
        starts, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        new = np.ones(len(words), bool)
        if len(self.words) and len(words) * 8 >= len(self.words):
            found = pc.index_in(words, value_set=self.words)
            new = pc.is_null(found).to_numpy(zero_copy_only=False)
            at = found.fill_null(0).to_numpy()[~new]
            starts[~new], lengths[~new] = self.starts[at], self.lengths[at]
        fresh = words.filter(pa.array(new))
        ids, sizes = self._encode_words(fresh.to_pylist())
        begin = np.cumsum(sizes) - sizes
        starts[new], lengths[new] = begin + len(self.ids), sizes
        pool = np.concatenate([self.ids, ids])
        of_piece = lengths[index]
        out = gather(pool, starts[index], of_piece)
        total = np.concatenate([[0], np.cumsum(of_piece)])
        room = self.kept - len(self.words)
        if room > 0 and len(words) * 8 >= len(self.words):
            seen = np.bincount(index, minlength=len(words))[new]
            keep = np.argsort(-seen, kind="stable")[:min(room, int((seen > 1).sum()))]  # frequent ones, then no more
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes[keep]) - sizes[keep]])
            self.lengths = np.concatenate([self.lengths, sizes[keep]])
            self.ids = np.concatenate([self.ids, gather(ids, begin[keep], sizes[keep])])
            self.words = pa.concat_arrays([self.words, fresh.take(pa.array(keep))])
        return out, np.diff(total[first])
