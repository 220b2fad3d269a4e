import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowlake.llm import collocations
from tests.llm.test_text_operators import docs


def brute(rows, least, top):
    """The contract, phrase by phrase."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\\x0a-\\x0d]", lower):
            words = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i:i + k]))
                    f[key] = f.get(key, 0) + 1
    out = []
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    hidden = set()
    for (lang, p), longer in often.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                key = (lang, p[i:i + size])
                if 100 * longer >= 80 * f[key]:
                    hidden.add(key)
    for (lang, p), a in often.items():
        if (lang, p) in hidden:
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    ranked = []
    for lang in sorted(n):
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return ranked


@pytest.mark.parametrize("least, top", [(2, 2000), (5, 7)])
def test_collocations_equal_brute_force(spark, least, top):
    r = random.Random(least)
    common = ["the", "of", "The", "a", "Ärger", "é.x", "b"]
    rows = []
    for i in range(300):
        words = [r.choice(common + [f"w{r.randrange(40)}"]) for _ in range(r.randrange(0, 40))]
        text = "".join(w + r.choice([" ", " ", "  ", "\t", ", ", "! ", "\n", "\x0b", "; "]) for w in words)
        rows.append((r.choice(["en", "en", "en", "de", None]), text))
    rows += rows[:50] + [("en", "New York City " * 40)] * 3  # repeated rows, overlaps
    rows += [("de", " ".join(r.choice(common) for _ in range(30_000))), ("en", None), ("en", ""), (None, "...!?"), ("fr", "once only")]
    table = spark.createDataFrame([(i if i % 9 else None, t, lang, 1, "x") for i, (lang, t) in enumerate(rows)],
                                  "doc_id long, text string, lang string, size int, phrase string").repartition(5)
    counts = collocations.phrase_counts(table, least)
    got = sorted(tuple(x) for x in collocations.collocations(counts, top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == sorted(brute(rows, least, top)) and len(got) > 10


def test_a_full_table_of_bits_changes_nothing(spark, monkeypatch):
    """With a table of 64 bits nearly every phrase looks active, with more some do: more work, equal counts."""
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(60))) for i in range(120)]
    table = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    want = sorted(map(tuple, collocations.phrase_counts(table, 12).collect()))
    for bits in (64, 512, 4096):
        monkeypatch.setattr(collocations, "BITS", bits)
        assert sorted(map(tuple, collocations.phrase_counts(table, 12).collect())) == want


def test_counts_are_handed_on_early_where_they_are_many(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(80)), r.choice(["en", "de"])) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = sorted(map(tuple, collocations.phrase_counts(table, 5).collect()))
    monkeypatch.setattr(collocations, "KEPT", 8)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 500)
    assert sorted(map(tuple, collocations.phrase_counts(table, 5).collect())) == want


def test_no_documents(spark):
    empty = docs(spark, []).selectExpr("*", "cast(null as string) as lang") if "lang" not in docs(spark, []).columns else docs(spark, [])
    assert collocations.collocations(collocations.phrase_counts(empty)).count() == 0


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 3)],
                                   "lang string, size int, phrase string, n long")
    row = collocations.collocations(counts).first()
    assert row["score"] == 2000000 * (big - 3) // (big + big - 1)


def test_a_later_scan_sorts_only_what_is_new(monkeypatch):
    """Where all phrases were counted a cycle ago, none of their occurrences is sorted."""
    column, full, rows, unique = pa.array(["a b c d " * 50, "b c. d a"]), np.full(1, 2**64 - 1, np.uint64), [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, **more: (rows.append(len(x)), unique(x, **more))[1])
    assert [len(n) for _, _, n in collocations.count_slice(column, "en", False, full, full)] == [0, 0, 0]
    assert sum(rows) == 0
    first = [(size, int(n.sum())) for size, _, n in collocations.count_slice(column, "en", False, full, None)]
    assert first == [(2, 199 + 2), (3, 198), (4, 197)] and sum(rows) == 596


def test_the_last_scan_gives_each_text_about_once(spark, monkeypatch):
    """Twelve parts that all have the same phrases: a row for each phrase, not one for each phrase and part."""
    words = [f"w{k}" for k in range(40)]
    table = spark.createDataFrame([(i, " ".join(words), "en") for i in range(480)], "doc_id long, text string, lang string").repartition(12)
    made, was = [], collocations.stored
    monkeypatch.setattr(collocations, "stored", lambda df, purpose, **more: (made.append((purpose, df.count())), was(df, purpose, **more))[1])
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        counts = collocations.phrase_counts(table).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    phrases = 40 + 39 + 38 + 37
    assert len(counts) == phrases + 1 and {r["n"] for r in counts if r["size"]} == {480}
    assert dict(made)["names"] <= phrases + 3 * 12 + 20


def test_texts_that_no_owner_names_are_named_by_any_part(spark, monkeypatch):
    table = spark.createDataFrame([(i, "a b c. b c", "en") for i in range(40)], "doc_id long, text string, lang string").repartition(4)
    want = sorted(map(tuple, collocations.phrase_counts(table).collect()))
    monkeypatch.setattr(collocations, "_owners", lambda reached: np.zeros(collocations.BITS // 64, np.uint64))
    assert sorted(map(tuple, collocations.phrase_counts(table).collect())) == want and len(want) == 7


def test_pairs_of_hash_and_check_are_counted_apart():
    r = np.random.default_rng(1)
    for n, most in ((0, 1), (1, 1), (1000, 50), (50_000, 9000)):
        hashes = r.integers(0, most, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= np.where(r.random(n) < 0.1, 5, 0).astype(np.uint64)  # other hashes with the same high bits
        checks = r.integers(0, 3, n).astype(np.uint64)
        (h, c), counts = collocations._counted(hashes, checks)
        got = dict(zip(zip(h.tolist(), c.tolist(), strict=True), counts.tolist(), strict=True))
        assert len(got) == len(h) and got == Counter(zip(hashes.tolist(), checks.tolist(), strict=True))
