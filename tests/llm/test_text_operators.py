"""Exact duplicates, quality rules, similarity join, personal data, toxicity and licences against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.llm import dedup, graph, jaccard, licences, pii, quality, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, digest string, kept string, n long"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "d", "k", 1) for i, t in rows], SCHEMA)


COPIES = [(5, "a b"), (2, "a \t\nb"), (9, "a b"), (2, "a b"), (None, "a b"), (None, None), (4, ""), (7, "A b"), (None, "z"), (None, "z")]


def test_exact_dedup(spark):
    for share in (1 / 512, 0.01, 0.4):
        got = dedup.exact_dedup(docs(spark, COPIES * 3), share=share).collect()
        assert len(got) == len(COPIES) * 3
        groups = {}
        for i, t in COPIES * 3:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
        for text, ids in groups.items():
            own = [r for r in got if r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
            known = [i for i in ids if i is not None]
            assert sorted(map(str, (r["doc_id"] for r in own))) == sorted(map(str, ids))
            assert {r["keep_id"] for r in own} == {min(known) if known else None} and {r["group_size"] for r in own} == {len(ids)}
            assert [r["doc_id"] for r in own if r["kept"]] == [min(known) if known else None]
    assert dedup.exact_dedup(docs(spark, [])).count() == 0


def test_digests_of_every_kind_of_white_space(spark):
    """Only runs that change are replaced: lone spaces, most of a text's runs, are not touched."""
    rows = [(i, "x" + "".join(p) + "y" + "".join(reversed(p))) for i, p in enumerate(itertools.chain(
        *(itertools.product(" \t\n\x0b\x0c\r\x1f\xa0a", repeat=k) for k in range(4))))]
    got = {r[0]: r[1] for r in docs(spark, rows).select("doc_id", dedup.text_digest("text")).collect()}
    assert got == {i: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()).hexdigest() for i, t in rows}
    assert not re.search(dedup._RUNS, "words between lone spaces ")


def test_drop_copies(spark):
    got = dedup.drop_copies(docs(spark, COPIES * 2))
    assert got.columns == docs(spark, []).columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got.collect() if r["text"] != "z")[1:] in (
        [(2, "a \t\nb"), (4, ""), (7, "A b")], [(2, "a b"), (4, ""), (7, "A b")]) or got.count() == 4
    assert got.count() == 4 and dedup.drop_copies(docs(spark, [])).count() == 0


def measure(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = {}
    for k in range(len(w) - 4):
        at.setdefault(tuple(w[k:k + 5]), []).append(k)
    covered = {k + o for v in at.values() if len(v) > 1 for k in v for o in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_measures(spark):
    r = random.Random(5)
    texts = [None, "", " \n\t ", "a", "a b c d e", "a a a a a a a a", "x\ny\nx\n \n\nx ", "é漢 \U0001f600 #|<>", "w " * 20_000]
    texts += [" ".join(r.choice("ab\n#") + r.choice("cd") for _ in range(r.randrange(60))) for _ in range(60)]
    got = {x["doc_id"]: x for x in quality.measures(docs(spark, list(enumerate(texts))), F.col("doc_id")).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == measure(t)


def test_binomial_tail(spark):
    rows = [(k, n, q) for n in (1, 5, 300, 20_000) for q in (0.005, 0.2) for k in (0, 1, 2, 7, 60) if k <= n]
    got = spark.createDataFrame(rows, "k long, n long, q double").withColumn("p", quality.binomial_tail("k", "n", "q")).collect()
    for x in got:
        if x["k"] >= x["n"] * x["q"]:
            assert x["p"] == 1.0
            continue
        want = sum(math.exp(math.lgamma(x["n"] + 1) - math.lgamma(j + 1) - math.lgamma(x["n"] - j + 1)
                            + j * math.log(x["q"]) + (x["n"] - j) * math.log1p(-x["q"])) for j in range(x["k"] + 1))
        assert x["p"] == pytest.approx(want, rel=1e-8)


def test_quality_verdicts(spark, monkeypatch):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(3000)]
    bad = [(5000 + i, " ".join(f"#w{i}|{k}%" for k in range(30))) for i in range(40)]
    base = [(9000, "too short"), (9001, None), (9002, "same five words again here " * 9)]
    table = docs(spark, good + bad + base)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_rules(table, labels).collect()}
    assert all(got[i]["kept"] for i, _ in good) and not any(got[i]["kept"] for i, _ in bad)
    assert all(got[i]["failed_rules"] == ["symbols"] for i, _ in bad) and all(got[i]["base_failed"] for i, _ in base)
    kept = quality.keep_good(table, labels)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, _ in good}
    twice = table.unionByName(docs(spark, [(1, bad[0][1]), (1, None), (None, bad[1][1]), (None, good[0][1])]))  # ids repeat or are null
    for most in (quality.BROADCAST_ROWS, 0):
        monkeypatch.setattr(quality, "BROADCAST_ROWS", most)
        assert sorted(r["doc_id"] or -1 for r in quality.keep_good(twice, labels).collect()) == sorted([-1, *[i or -1 for i, _ in good]])
    plain = quality.quality_rules(table, labels.limit(0))  # without labels only the base rules hold
    assert {r["doc_id"] for r in plain.where("not kept").collect()} == {9000, 9001, 9002}
    assert quality.quality_rules(docs(spark, []), labels).count() == 0


def test_vectors_reach_small_strata(spark):
    """300 good documents of each of four languages are enough, and a failed step ends the sequence."""
    good = [(i, " ".join(f"w{i}x{k}" for k in range(30)), f"l{i % 4}") for i in range(1200)]
    bad = [(5000 + i, " ".join(f"#w{i}|{k}%" for k in range(30)), f"l{i % 4}") for i in range(40)]
    lines = [(8000 + i, "\n".join(f"x{i} y{k} z{k} u{k}" for k in [*range(8), 0]), "l3") for i in range(9)]  # one line in nine is a copy
    few = [(9000 + i, " ".join(f"v{i}x{k} #{k}" for k in range(30)), "l4") for i in range(9)]
    table = spark.createDataFrame(good + bad + lines + few, "doc_id long, text string, lang string")
    labels = [(i, 1, 0) for i, _, _ in good + lines + few] + [(i, 0, 0) for i, _, _ in bad]
    kept = {r["doc_id"] for r in quality.keep_good(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert kept == {i for i, _, _ in good + lines + few}
    steps = quality.vectors()
    assert len(steps) == 21 and all(sum(a[r] != b[r] for r in a) == 1 and all(a[r] >= b[r] for r in a) for a, b in zip(steps, steps[1:]))


def test_cutoffs_decide_in_query_and_sql(spark):
    """At this scale en has enough good labels: query and SQL reject the same documents by cutoffs."""
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want = con.execute(queries.SQL["op8_quality_rules"]).fetchall()
    names = [x[0] for x in con.description]
    got = queries.op8_quality_rules(spark, folder).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    at = {n: i for i, n in enumerate(names)}
    by_cutoff = [r for r in want if not r[at["kept"]] and not r[at["base_failed"]]]
    assert by_cutoff and all(r[at["failed_rules"]] for r in by_cutoff)


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def corpus():
    r = random.Random(11)
    rows, i = [], 0
    for g in range(12):
        base = [f"t{g}w{r.randrange(10 ** 6)}" for _ in range(r.choice((5, 20, 60)))]
        for _ in range(r.choice((1, 2, 9, 30))):
            words = list(base)
            for _ in range(r.choice((0, 0, 1, 2))):
                words[r.randrange(len(words))] = f"edit{r.randrange(50)}"
            rows.append((i, r.choice((" ", "  ")).join(words)))
            i += 1
    return rows + [(i, ""), (i + 1, None), (i + 2, "one two"), (i + 3, "one  two"), (i + 4, "one three"), (i + 5, "")]


@pytest.mark.parametrize("block", [256, 4])
def test_jaccard_links(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", block)
    monkeypatch.setattr(jaccard, "CLUSTER_BLOCK", block)
    rows = corpus()
    sets = [shingles(t) for _, t in rows]
    links = [[j for j, b in enumerate(sets) if i != j and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-12] for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    while True:
        new = [min([group[i], *(group[j] for j in links[i])]) for i in range(len(rows))]
        if new == group:
            break
        group = new
    got = {r["doc_id"]: r for r in jaccard.jaccard_links(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, (n, _) in enumerate(rows):
        assert got[n]["n_links"] == len(links[i]) and got[n]["class_id"] == group[i]
        assert got[n]["class_size"] == group.count(group[i])
        assert got[n]["n_linked_texts"] == len({tuple(WORD.findall(rows[j][1])) for j in links[i]} - {tuple(WORD.findall(rows[i][1] or ""))})
    if block == 256:
        kept = jaccard.one_of_each(docs(spark, rows))
        assert kept.columns == docs(spark, []).columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({rows[g][0] for g in group})


def test_jaccard_nulls_and_nothing(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)]
    got = jaccard.jaccard_links(docs(spark, rows)).collect()
    assert sorted((r["class_id"], r["n_links"]) for r in got) == [(3, 3)] * 4 + [(4, 0)]
    assert jaccard.jaccard_links(docs(spark, [])).count() == 0 and jaccard.one_of_each(docs(spark, [])).count() == 0


def test_pruning_bound():
    least = jaccard.fewest_matches(0.8, 1e-5)
    assert len(least) == jaccard.HASHES // jaccard.STEP and list(least) == sorted(least)
    n = jaccard.HASHES
    assert sum(math.comb(n, k) * 0.8 ** k * 0.2 ** (n - k) for k in range(least[-1])) < 1e-4


def test_pruning_loses_no_more_than_the_bands():
    least = jaccard.fewest_matches(jaccard.THRESHOLD, jaccard.TOLERANCE)
    bands = (1 - jaccard.THRESHOLD ** jaccard.BAND) ** jaccard.BANDS
    assert 0 < jaccard.pruning_loss(jaccard.THRESHOLD, least) <= bands
    assert jaccard.pruning_loss(0.8, jaccard.fewest_matches(0.8, 1e-5)) == pytest.approx(7.1e-5, rel=0.05)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(500):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


PATTERNS = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in PATTERNS[0].finditer(text)]
    out += [(m.start(), 1, m.end()) for m in PATTERNS[1].finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in PATTERNS[2].finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PATTERNS[3].finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_patterns():
    r = random.Random(8)
    parts = ["a@b.c", "@", "x.y@", "@a.b@c.d", "1.2.3.4", "256.1.1.1", "00012.3.4.5", ".", "-", " ", "+1 (325) 555-8094", "+", "4929348385146306",
             "4929 3483 8514 6306", "12", "(", ")", "é", "٣٤", "7", "user.name+tag@mail-1.example.com", "\n", "1.2.3.4.5.6.7.8"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert pii.pattern_spans(text) == brute_spans(text), text


def test_spans_and_mask(spark):
    card = "4929348385146306"
    text = f"pay {card} now. Later: 1111222233334440 {card} again, mail a@b.example or +1 (325) 555-8094"
    rows = [(1, text), (2, None), (3, ""), (4, "nothing 12 here"), (1, text)]
    rows += [(10 + i, f"né {card} x") for i in range(30)] + [(100 + i, f"one {card} two {card}") for i in range(300)]
    rows += [(1000 + i, f"room {i % 90} and house 4455 beside room {i % 90}") for i in range(300)]
    found = pii.find_spans(docs(spark, rows))
    got = {r["doc_id"]: r for r in pii.digest(found).collect()}
    listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_spans(text))
    assert got[1]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and (got[1]["n_email"], got[1]["n_phone"]) == (1, 1)
    # the second mention is hidden from the pattern by the number before it; its twin brings it back
    second = text.rindex(card)
    assert f"card:{second}:{second + 16}" in got[1]["spans"].split(",") and set(listed.split(",")) <= set(got[1]["spans"].split(","))
    for i in (2, 3, 4):
        assert got[i]["spans"] == "" and got[i]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    table = docs(spark, rows).withColumn("n_chars", F.length("text"))
    masked = {r["doc_id"]: r for r in pii.mask(table).collect()}
    assert pii.mask(table).columns == table.columns and masked[2]["text"] is None and masked[4]["text"] == "nothing 12 here"
    assert masked[10]["text"] == "né [CARD] x" and masked[10]["n_chars"] == 11
    assert "4929" not in masked[1]["text"] and "[EMAIL]" in masked[1]["text"] and "[PHONE]" in masked[1]["text"]
    assert pii.digest(pii.find_spans(docs(spark, []))).count() == 0 and pii.mask(docs(spark, [])).count() == 0


def card_number(r):
    body = [4, *[r.randrange(10) for _ in range(14)]]
    return next(x for x in ("".join(map(str, body)) + str(c) for c in range(10)) if pii.luhn(x))


def hidden_repeats(r, k, gap=3):
    """A card in plain sight, then k mentions behind a number that makes the pattern's match fail."""
    card = card_number(r)
    behind = next(n for n in range(1, 90) if not pii.luhn(f"{n}{card}"))
    return card, f"pay {card} now " + " ".join(f"{'word ' * gap}{behind} {card}" for _ in range(k))


def test_hidden_repeats(spark):
    """One plain mention brings back all hidden ones of its document, however many and however far away."""
    r = random.Random(14)
    counts = [1, 3, 6, 12, 25, 50]
    made = [hidden_repeats(r, k) for k in counts for _ in range(20)] + [hidden_repeats(r, 50, gap=400)]
    rows = [(i, t) for i, (_, t) in enumerate(made)]
    clean = [(5000 + i, f"room {i % 90} and house 4455 beside room {i % 90}, year 2024, order {10 ** 11 + i} and 1.2.3.400") for i in range(500)]
    got = {x["doc_id"]: x for x in pii.find_spans(docs(spark, rows + clean)).collect()}
    for i, (card, text) in enumerate(made):
        want = [m.start() for m in re.finditer(card, text)]
        assert [x["start"] for x in sorted([*got[i]["base"], *got[i]["added"]])] == want, (i, text[:80])
        assert len(got[i]["base"]) == 1 and all(x["kind"] == "card" for x in got[i]["added"])
    assert not any(got[i]["added"] for i, _ in clean)
    masked = pii.mask(docs(spark, rows + clean)).where("doc_id < 5000").collect()
    assert not any(made[x["doc_id"]][0] in x["text"] for x in masked)


def field_of(texts):
    return pii.Field(texts, [pii.pattern_spans(t) for t in texts])


def test_inference_on_trees():
    """Beliefs are the marginals of the field, counted out, where it has no loop."""
    r = random.Random(15)
    texts = [hidden_repeats(r, 1)[1] for _ in range(8)] + [f"call {i} 77 or 1.2.3.{i} then a{i}@b.c 9" for i in range(8)]
    counts = pii._counts(field_of(texts + [hidden_repeats(r, 2)[1] + " " + t for t in texts]))
    potentials = pii.Potentials(counts)
    for text in texts:
        field = field_of([text])
        n, hubs = len(field.doc), len(field.hub_doc)
        total = np.zeros((n, 5))
        for labels in itertools.product(range(5), repeat=n + hubs):
            if any(f and f != x for f, x in zip(field.label, labels)):
                continue
            score = sum(potentials.hub[h] for h in labels[n:])
            for i in np.flatnonzero(field.label == 0):
                score += potentials.node[field.shape[i], labels[i]] if field.allowed[i, labels[i]] else -50.0
            score += sum(potentials.chain[labels[a], labels[b]] for a, b in field.chain)
            score += sum(potentials.member[labels[n + h], labels[i]] for i, h in field.members)
            total[np.arange(n), labels[:n]] += np.exp(score)
        assert np.allclose(pii.infer(field, potentials), total / total.sum(1, keepdims=True), atol=2e-3), text


def test_beliefs_do_not_depend_on_neighbours():
    r = random.Random(16)
    texts = [hidden_repeats(r, k)[1] + f" 12 34 {k} 12 77 x@y.z {k}" for k in (0, 1, 5, 30)] + ["", "no numbers"]
    potentials = pii.Potentials(pii._counts(field_of(texts)))
    together, alone = pii.infer(field_of(texts), potentials), [pii.infer(field_of([t]), potentials) for t in texts]
    assert np.allclose(together, np.concatenate(alone), atol=1e-12)


def test_toxicity(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(3000):
        text = [r.choice(words) for _ in range(r.randrange(5, 60))]
        if i % 8 == 0:
            text += r.sample(["vilething", "viletalk", "nastiness", "nasties"], 2)
        rows.append((i, " ".join(text)))
    labels = [(i, 1, int(i % 8 == 0)) for i, _ in rows if i % 2 == 0] + [(None, 1, 1), (3, 1, None)]
    table = docs(spark, rows + [(4000, None), (4001, ""), (None, "w1")])
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(table, labels)
    got = [x for x in toxicity.score(table, model).collect()]
    assert len(got) == 3003 and all(0 <= x["score"] <= 1 for x in got)
    for x in got:
        if x["doc_id"] is not None:
            assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2)
    held = [x for x in got if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 3000]
    assert np.mean([x["predicted"] == int(x["doc_id"] % 8 == 0) for x in held]) > 0.97
    # labels of held-out rows and of rows without a label change nothing
    other = labels.where(~toxicity.held_out())
    assert toxicity.train(table, other).bias == pytest.approx(model.bias)
    none = toxicity.score(table, toxicity.train(table, labels.limit(0))).collect()
    assert all(x["score"] < 1e-6 and x["predicted"] == 0 for x in none)
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_toxicity_does_not_depend_on_the_order_of_rows(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join([r.choice(words) for _ in range(r.randrange(5, 40))] + ["vilething", "nasties"] * (i % 6 == 0))) for i in range(900)]
    rows += rows[:40] + [(5000, " ".join(words * 200) + " vilething nasties")]  # repeated rows and a long text
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 900, 2)], "doc_id long, toxic int")
    seen = set()
    for k in range(4):
        r.shuffle(rows)
        model = toxicity.train(docs(spark, rows).repartition(k + 1), labels)
        got = [(x["doc_id"], x["predicted"]) for x in toxicity.score(docs(spark, rows), model).collect()]
        seen.add((tuple(model.weights), model.bias, tuple(sorted(got))))
    assert len(seen) == 1
    held = [(i, p) for i, p in next(iter(seen))[2] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([p == (i % 6 == 0 or i == 5000) for i, p in held]) > 0.97


def test_licences(spark):
    mit = "Released under the MIT License."
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [("p/a/x.py", f"code here\n{mit}\nmore words"), ("p/a/y.py", "plain words"), ("p/LICENSE", f"{apache}\n\nSome project text of its own, with many other words"),
            ("p/a/b/z.py", "plain"), ("p/a/b/NOTES", apache), ("q/free.py", "the of and to version"), ("top", None), (None, ""), ("p/c/only", "")]
    table = spark.createDataFrame([(p, t, "s", 1.0) for p, t in rows], "path string, text string, licence string, score double")
    got = {r["path"]: (r["licence"], r["how"], r["licence_dir"]) for r in licences.scan(table).collect()}
    assert len(got) == len(rows)
    assert got["p/a/x.py"] == ("MIT", "own", None) and got["p/LICENSE"][:2] == ("Apache-2.0", "own")
    assert got["p/a/y.py"] == ("Apache-2.0", "inherited", "p") and got["p/c/only"] == ("Apache-2.0", "inherited", "p")
    assert got["p/a/b/z.py"] == ("Apache-2.0", "inherited", "p/a/b")  # a file that is nothing but a licence holds for its directory
    assert got["q/free.py"] == got["top"] == got[""] == (None, None, None)
    assert licences.scan(table.limit(0)).count() == 0


def test_licences_in_parts_of_texts(spark):
    """Wrapped, commented, embedded and full-text licences, and lines of names."""
    full = dict(licences._FULL)
    r = random.Random(3)
    prose = [" ".join(r.choice(COMMON) for _ in range(120)) for _ in range(300)]
    gpl = ("/* This program is free software: you can redistribute it\n * and/or modify it under the terms of the GNU General\n"
           " * Public License as published by the Free Software\n * Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\n")
    commented = "".join(f"# {x}\n" for x in full["BSD"].split("\n"))
    rows = {"a/wrapped.py": ("MIT", "import this\n" + full["MIT"][:300] + "\n" + prose[0]), "b/head.c": ("GPL-3.0", gpl + prose[1]),
            "c/bsd.py": ("BSD", prose[2] + "\n" + commented + prose[3]), "d/spdx.rs": ("MIT", "// SPDX-License-Identifier: MIT\n" + prose[4]),
            "e/inline": ("Apache-2.0", prose[5] + " Licensed under the Apache License, Version 2.0. " + prose[6]),
            "f/doc": ("MIT", "Copyright (c) 2020 Some One\n" + full["MIT"]), "g/doc": ("Apache-2.0", full["Apache-2.0"].replace("\n", " ")),
            "h/other.rs": (None, "// SPDX-License-Identifier: Zlib\n" + prose[7]), "f/plain": ("MIT", prose[8]), "h/plain": (None, prose[9])}
    table = [(p, t) for p, (_, t) in rows.items()] + [(f"z/{i}", t) for i, t in enumerate(prose[10:])]
    got = {x["path"]: x for x in licences.scan(spark.createDataFrame(table, "path string, text string")).collect()}
    assert {p: got[p]["licence"] for p in rows} == {p: name for p, (name, _) in rows.items()}
    assert got["f/plain"]["licence_dir"] == "f" and not any(got[f"z/{i}"]["licence"] for i in range(290))


def test_common_words_weigh_little(spark):
    """Words that most texts have do not hide the declaration beside them."""
    table = [(f"p/{i}", " ".join(COMMON)) for i in range(300)]
    table += [("q/a", "Licensed under the Apache License, Version 2.0. " + " ".join(COMMON[:13]))]
    files = spark.createDataFrame(table, "path string, text string")
    counts = {x["term"]: x["n"] for x in licences.document_counts(files).collect()}
    assert counts[""] == 301 and counts[COMMON[0]] == 301 and counts[COMMON[-1]] == 300 and counts["apache"] == 1
    got = {x["path"]: x for x in licences.declarations(files).collect()}
    assert set(got) == {"q/a"} and got["q/a"]["licence"] == "Apache-2.0" and got["q/a"]["whole"]


COMMON = "the of and to in a is that it as with for on was by from at are this have an which or be not but all they we one had were her".split()


def test_anchors_are_safe(spark):
    texts = spark.createDataFrame([("the of and to in with under license",), ("words of the public",)], "text string")
    weights = licences.term_weights(texts)
    chosen = licences.anchors(weights)
    for _, t in licences.TEMPLATES:
        words = licences._words(t)
        worth = {w: (words.count(w) * weights[w]) ** 2 for w in set(words)}
        left = sum(x for w, x in worth.items() if not any(a in w for a in chosen))
        assert math.sqrt(left / sum(worth.values())) < licences.LEAST
