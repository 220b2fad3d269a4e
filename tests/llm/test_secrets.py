import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from flowlake.llm import secret_scan as S
from tests.llm.test_text_operators import docs

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def key(r, n, letters="0123456789abcdef"):
    return "".join(r.choice(letters) for _ in range(n))


def corpus(r, n=400):
    """Prose with assigned keys, bare hex, access keys, phone numbers and dates."""
    words = ["plain", "wörter", "thing", "internationalisation", "value", "Grundstücksverkehr", "order"]
    rows = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randrange(0, 30))]
        extra = {0: f'token = "{key(r, 40)}"', 1: f"the digest {key(r, 32)} of it", 2: "AKIA" + key(r, 16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
                 3: f"call {r.randrange(10**9, 10**10)} or 555-{r.randrange(1000, 9999)}", 4: f"on 2024-{r.randrange(10, 12)}-{r.randrange(10, 28)}"}.get(i % 8)
        if extra:
            text.insert(r.randrange(len(text) + 1), extra)
        rows.append((i, " ".join(text)))
    return rows


def test_pattern_spans_equal_the_plain_patterns():
    r = random.Random(5)
    bits = ["token", "Api_Key", "apikey", "PASSWD", "passwo", '"', "'", " ", "  ", ":", "=", "AKIA", "\n", "é", "ſecret", "toKen", ".", "0123456789ab", "XY", "_-", "f" * 9]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(25)))
        assert S.pattern_spans(text) == plain_spans(text), text
        _, spans = S.find(pa.array([text, "", text]))
        assert spans == [plain_spans(text), [], plain_spans(text)]


def test_candidates_equal_a_plain_search():
    r = random.Random(6)
    texts = ["".join(r.choice("ab1-é. /Z") for _ in range(r.randrange(60))) for _ in range(300)] + ["", "a1" * 5000]
    c, _ = S.find(pa.array(texts))
    got = list(zip(c.doc.tolist(), c.start.tolist(), c.end.tolist()))
    want = [(d, m.start(), m.end()) for d, t in enumerate(texts) for m in re.finditer("[A-Za-z0-9+/_=-]{8,}", t)
            if re.search("[0-9]", m[0]) or len(m[0]) >= 12]
    assert got == want
    low, high = c.windows()
    for i, w in enumerate(c.texts(low, high)):
        whole = texts[c.doc[i]].encode()
        at = len(texts[c.doc[i]][:c.start[i]].encode())
        assert w[c.low[i] - low[i]:c.high[i] - low[i]] == whole[at:at + c.high[i] - c.low[i]] and w in whole


def test_gradients_are_those_of_the_loss():
    r = random.Random(2)
    parts = [("x " * r.randrange(9) + key(r, 20) + " y" * r.randrange(5)).encode() for _ in range(12)]
    low = np.array([p.rfind(b"x ") + 2 if b"x " in p else 0 for p in parts])
    high, label = low + 20, np.arange(12) % S.CLASSES
    net, weight, target = S.Network(), np.ones(12) / 12, np.eye(S.CLASSES)[label]
    w = S.Windows.of(parts, low, high)

    def loss():
        z = net.logits(w)
        z = z - z.max(1, keepdims=True)
        data = -(weight * (z[np.arange(12), label] - np.log(np.exp(z).sum(1)))).sum()
        return data + S.DECAY / 2 * sum((x ** 2).sum() for x in (net.filters, net.dense, net.by_length))

    for value, g in zip(net.parameters(), S._gradients(net, w, target, weight)):
        for at in np.argsort(-np.abs(g).ravel())[:6]:
            old, step = value.flat[at], 1e-6
            value.flat[at] = old + step
            up = loss()
            value.flat[at] = old - step
            assert (up - loss()) / (2 * step) == pytest.approx(g.flat[at], rel=1e-3, abs=1e-7)
            value.flat[at] = old


def test_secrets(spark):
    r = random.Random(1)
    rows = corpus(r) + [(1000, None), (1001, ""), (None, "token: abcdefghijkl"), (1002, "x " * 40_000 + 'secret="' + key(r, 30) + '"' + " y1" * 30_000)]
    rows += rows[:30]
    table = docs(spark, rows)
    got = S.digest(S.find_secrets(table)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), hashlib.sha256(",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(t or "")).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(x["doc_id"]), x["base_sha256"]) for x in got) == want
    for x in got:
        assert x["n_assign"] + x["n_access"] + x["n_hex"] + x["n_added"] == len([s for s in x["spans"].split(",") if s])
    assert S.find_secrets(docs(spark, [])).count() == 0


def test_held_out_findings_and_hidden_ones(spark):
    """Held-back findings pass the thresholds as promised, ordinary candidates do not, hidden secrets are added."""
    r = random.Random(3)
    rows = corpus(r, 1600)
    scanner = S.learn(docs(spark, rows))
    assert all(x >= S.RECALL for x in scanner.recall)
    fresh = corpus(random.Random(77), 600)
    c, spans = S.find(pa.array([t for _, t in fresh]))
    low, high = c.windows()
    scores = scanner.network.scores(c.texts(low, high), c.low - low, c.high - low)
    for k in range(len(S.KINDS)):
        assert np.mean(scores[c.label == k + 1, k] >= scanner.thresholds[k]) > 0.9
    assert len(scanner.added(c, spans)) <= 0.01 * (c.label == 0).sum()
    hidden = ["the digest " + key(r, 15) + "A" + key(r, 15) + " of it" for _ in range(50)]  # runs too short for the pattern
    c, spans = S.find(pa.array(hidden))
    assert not any(spans) and len({d for d, *_ in scanner.added(c, spans)}) > 35


def test_calibration():
    rng = np.random.default_rng(0)
    x = (np.arange(S.BINS) - S.BINS // 2 + 0.5) * S.BIN
    p = 1 / (1 + np.exp(-(0.7 * x - 1)))
    n = rng.poisson(3000 * np.exp(-np.abs(x) / 4))
    yes = rng.binomial(n, p)
    (slope, offset), threshold, recall = S.calibrate(np.stack([n - yes, yes]))
    assert slope == pytest.approx(0.7, abs=0.03) and offset == pytest.approx(-1, abs=0.1)
    kept = yes[x >= threshold].sum() / yes.sum()
    assert kept == pytest.approx(recall) and kept >= S.RECALL > yes[x >= threshold + S.BIN].sum() / yes.sum()
    assert S.calibrate(np.zeros((2, S.BINS), int))[1] == np.inf
