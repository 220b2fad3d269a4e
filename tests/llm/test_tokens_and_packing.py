"""Token ids, length histogram, token files and packing against the library and plain Python."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from flowlake.llm import lengths, packing, pieces, token_files
from flowlake.llm.tokens import Encoder, default_path
from flowlake.session import new_folder

ODD = ["", " ", "  a  b ", "x\n\ny z", "a   b", "café naïve", "漢字 \U0001f600!", "<|endoftext|> a<|endoftext|>",
       "tab\tand\x0bmore\x0c", "don't we'll", "1234 5678", "  z　 q", "end ", "\x1c \x1cb", "a " * 3000, "z" * 5000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def docs(spark, rows, extra="length long, ids string"):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], f"doc_id long, text string, {extra}")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_is_the_library(library):
    e = Encoder(default_path())
    r = random.Random(1)
    words = [r.choice(ODD + ["the", "été", "foo.bar", "\n", "  "]) for _ in range(400)]
    texts = ODD + [" ".join(words[i:i + 20]) for i in range(0, 400, 20)]
    for _ in range(2):  # the second time from kept words
        ids, n = e.encode(pa.array(texts))
        got = np.split(ids, np.cumsum(n)[:-1])
        assert [g.tolist() for g in got] == [ids_of(library, t) for t in texts]


def test_encoder_with_nulls_and_no_rows():
    ids, n = Encoder(default_path()).encode(pa.array([], pa.string()))
    assert not len(ids) and not len(n)


def test_histogram(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD + [None, "the", "the"])]
    hist = lengths.histogram(lengths.length_counts(docs(spark, rows)))
    n = sorted(len(ids_of(library, t)) + 1 for _, t in rows)
    got = {r["length"]: r for r in hist.collect()}
    assert sorted(got) == sorted(set(n))
    for x, r in got.items():
        assert r["n_docs"] == n.count(x) and r["docs_over"] == sum(y > x for y in n)
        assert r["tokens_over"] == sum(y for y in n if y > x) and r["tokens_truncated"] == sum(min(x, y) for y in n)
        assert r["tokens_lost"] == sum(max(0, y - x) for y in n) and r["tokens_upto"] == sum(y for y in n if y <= x)
        assert r["quantile"] == pytest.approx(sum(y <= x for y in n) / len(n))
    for r in lengths.totals_at(hist, [0, 5, 10 ** 6]).collect():
        assert r["docs_whole"] == sum(y <= r["context_limit"] for y in n)
        assert r["tokens_truncated"] == sum(min(r["context_limit"], y) for y in n)
    assert hist.agg(lengths.quantile_length(hist, 0.5)).first()[0] == n[-(-len(n) // 2) - 1]
    by_id = {r["doc_id"]: r["length"] for r in lengths.document_lengths(docs(spark, rows)).collect()}
    assert by_id == {i: len(ids_of(library, t)) + 1 for i, t in rows}
    assert lengths.histogram(lengths.length_counts(docs(spark, []))).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, library, encoding):
    rows = [(5, "b"), (3, None), (3, "repeated"), (9, "a " * 3000), (None, "no id"), (1, ""), (4, "café")]
    path = new_folder(spark, "tokens")
    token_files.write_tokens(docs(spark, rows), path, encoding=encoding)
    read = token_files.read_tokens(spark, path)
    got = token_files.with_starts(token_files.checksums(read), spark, path).orderBy("start").collect()
    before = 0
    assert [r["doc_id"] for r in got] == sorted([i for i, _ in rows if i is not None]) or got[0]["doc_id"] is None
    want = {(i, crc([*ids_of(library, t), 0])) for i, t in rows}
    for r in got:
        assert r["start"] == before and (r["doc_id"], r["ids_crc32"]) in want
        before += r["n_tokens"]
    assert before == sum(len(ids_of(library, t)) + 1 for _, t in rows)
    few = token_files.read_tokens(spark, path, 4, 5)
    assert {r["doc_id"]: r["ids"] for r in few.collect()} == {5: [*ids_of(library, "b"), 0], 4: [*ids_of(library, "café"), 0]}
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,4)" in plan
    meta = token_files.read_metadata(spark, path)
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1][:200]
    assert meta.count() == len(rows)


def test_token_files_without_rows(spark):
    path = new_folder(spark, "tokens")
    token_files.write_tokens(docs(spark, []), path)
    assert token_files.read_metadata(spark, path).count() == 0
    with pytest.raises(ValueError):
        token_files.writer_options("other")


def check_layout(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(by)


def test_pack_documents(spark, library):
    size = 64
    rows = [(i % 90, "word " * (i * 7 % 150)) for i in range(200)] + [(None, None), (500, ""), (1, "word " * 700)]
    cut = packing.cut_pieces(docs(spark, rows), size, with_ids=True)
    packed = packing.pack(cut, size)
    got = packed.collect()
    n = [len(ids_of(library, t)) + 1 for _, t in rows]
    assert len(got) == sum(-(-x // size) for x in n) and sum(r["length"] for r in got) == sum(n)
    used = check_layout(got, size)
    assert used <= -(-sum(n) // size) * 1.03 + 1
    whole = [r for r in got if r["doc_id"] == 500]
    assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in whole] == [(0, 0, 1, crc([0]))]
    long_ids = [*ids_of(library, "word " * 700), 0]
    parts = sorted((r["start"], r["ids"]) for r in got if r["doc_id"] == 1 and len(long_ids) % size in (r["length"], r["length"] % size) or r["doc_id"] == 1 and r["length"] == size)
    assert any(long_ids[s:s + len(x)] == x for s, x in parts)
    joined = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in got:
        assert joined[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"]
        assert r["ids_crc32"] == crc(r["ids"])


def test_pack_nothing_and_wrong_lengths(spark):
    assert packing.pack(packing.cut_pieces(docs(spark, []), 64), 64).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(65,)], "length long"), 64)


def test_layout_is_near_the_bound():
    r = np.random.default_rng(3)
    for n in (1, 7, 500, 60_000):
        lens = np.minimum(r.geometric(1 / 700, n), 2048)
        values, counts = np.unique(lens, return_counts=True)
        layout = packing.plan_layout(values, counts, 2048)
        assert layout.n_sequences <= -(-int(lens.sum()) // 2048) * 1.01 + 1 or n < 500
        assert layout.n_sequences <= sum(k for _, k in packing.best_fit(values, counts, 2048))
        assert layout.programme_pieces > 0.9 * n or n < 60_000
        where, offset = layout.place(np.repeat(values, counts), np.concatenate([np.arange(c) for c in counts]))
        check_layout([{"sequence_id": s, "offset": o, "length": x} for s, o, x in zip(where, offset, np.repeat(values, counts))], 2048)


def test_programme_covers_demand():
    values, counts = np.array([3, 5, 7]), np.array([400, 300, 200])
    chosen = packing.solve_programme(values, counts, 16, 100)
    assert all(sum(values[i] * k for i, k in c.items()) <= 16 for c, _ in chosen)
    covered = sum(np.array([c.get(i, 0) for i in range(3)]) * often for c, often in chosen)
    assert (covered >= 0.9 * counts).all() and (covered <= counts + 1e-6).all()


def test_pieces_are_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    texts = ODD + ["ab" * 3000 + "hello" * 400, "x▁ y", "the  the", "<s> </s>", "\x00a", "   "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (5, "repeated"), (5, "repeated")]
    got = pieces.decode(pieces.encode(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == sp.encode(r["text"])
        assert r["decoded"] == r["text"].replace("▁", " ")
    short = {r["doc_id"]: r for r in pieces.round_trip(docs(spark, rows)).collect()}
    for r in got:
        if r["doc_id"] not in (5, None):
            x = short[r["doc_id"]]
            assert (x["n_pieces"], x["ids_crc32"], x["same"]) == (len(r["ids"]), crc(r["ids"]), r["decoded"] == r["text"])
    assert pieces.round_trip(docs(spark, [])).count() == 0 == pieces.decode(pieces.encode(docs(spark, []))).count()


def test_words_by_relations(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    words = ["▁the", "▁▁▁", "▁thhandin,", "漢字", "a\U0001f600b", "\n", "▁Erlywhanness"]
    got = {r["word"]: r["ids"] for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    model = pieces.load(pieces.default_path())
    ids, n = pieces.fold_words(model, words)
    assert got == dict(zip(words, [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]))
    assert got["▁thhandin,"] == sp.encode("thhandin,")
