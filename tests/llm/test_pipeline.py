"""The queries against their SQL, and the pipeline against the same steps in plain Python."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from flowlake.llm import packing, queries, words
from flowlake.llm.tokens import default_path
from tests.conftest import plan_of
from tests.llm.test_text_operators import PATTERNS, brute_spans, measure, shingles
from tests.llm.test_tokens_and_packing import check_layout, crc


def test_registered():
    names = set(entry_points.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES} and "pipeline" in names
    assert set(queries.SQL) <= names and len(corpus_pipeline.STAGES) == 5


def brute_mask(text):
    spans, out, at = brute_spans(text), [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{('EMAIL', 'IP', 'CARD', 'PHONE')[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def test_pipeline(spark, tmp_path):
    base = [f"doc{g} " + " ".join(f"g{g}w{k}" for k in range(40)) for g in range(25)]
    texts = [*base, *base[:5], *[t + " tail" for t in base[5:9]], "short", None, "", "again and again we say it " * 8,
             base[3].replace(" ", "\n"), "mail a.b@c.example and 1.2.3.4 " + base[24][::-1] + " +1 (325) 555-8094", "word " * 5 + " ".join(f"long{k}" for k in range(3000))]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = []
    for i, t in enumerate(texts):
        m = measure(t)
        if not (m[0] < 10 or 100 * m[4] > 20 * m[0]):
            left.append((i, t))
    seen, kept = set(), []
    for i, t in left:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        if key not in seen:
            seen.add(key)
            kept.append((i, t))
    sets = [shingles(t) for _, t in kept]
    group = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group[a] = min(group[a], group[b])
    final = [(i, brute_mask(t)) for k, (i, t) in enumerate(kept) if group[k] == k]
    library, size, want = Tokenizer.from_file(default_path()), queries.SEQUENCE, set()
    for i, t in final:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
        want |= {(i, k, x, y - x, crc(ids[x:y])) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    check_layout(got, size)


def test_stages_return_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name


def test_stages_on_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_large_texts_reach_workers_in_small_batches(spark):
    """Stages with Python workers bound a batch by its bytes, and hold little beside a slice of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 6, 1, 1).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 700000) as text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    try:
        for name, stage in corpus_pipeline.STAGES[2:]:
            spark.conf.unset(key)
            stage(spark, docs.limit(0), "")
            assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) < 8 << 20, name
        spark.conf.set(key, "1m")  # a session's own number stays
        corpus_pipeline.mask_pii(spark, docs, "")
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
    column = pa.array(["some words of a text " * 200] * 500)
    words.word_hashes(column.slice(0, 1))
    tracemalloc.start()
    words.word_hashes(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * column.nbytes + (20 << 20)


def test_a_task_that_packs_has_one_python_worker(spark, monkeypatch):
    """Texts are cut and numbered by one map: a second one in the same tasks doubles their workers."""
    maps, save = [], packing.stored
    monkeypatch.setattr(packing, "stored", lambda df, name: (maps.append(plan_of(df).count("MapInArrow")), save(df, name))[1])
    docs = spark.createDataFrame([(i, f"some text {i} " * 50) for i in range(20)], "doc_id long, text string")
    check_layout(corpus_pipeline.pack(spark, docs, "").collect(), queries.SEQUENCE)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert maps and max(maps) == 1
