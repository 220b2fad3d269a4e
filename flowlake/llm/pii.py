"""Personal data: pattern spans, and a skip-chain conditional random field that keeps a document consistent.

Tokens with a digit or an ``@`` are the nodes of a document's field.  Neighbouring nodes share a
chain potential.  All nodes of a document with the same text, or with the same digits, hang on one
hub, the label of the thing they name, by a skip potential: two mentions are two steps apart
wherever they stand.  Repeats that no pattern found speak to their hub with one voice, however many
they are.  Potentials are counted over the whole corpus with the pattern spans as labels, once per
document and token; labels of pattern spans are fixed, the others are inferred by loopy message
passing, in each document until it settles.  What the patterns found always stays.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import slices, texts

#: The kinds in order.  Label 0 of a node is "none".
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_NODE = re.compile(r"[0-9@]")
_EDGES = re.compile(r"^[^A-Za-z0-9+(]+|[^A-Za-z0-9)]+$")
#: Buckets of token shapes; bounds the counted tables.
SHAPES = 4096
#: Share of true mentions that the patterns are taken to find, damping of the messages, least belief.
PATTERN_RECALL, DAMPING, BELIEF = 0.98, 0.3, 0.9
#: A document has settled when no message changes by more than this; one that swings is left after so many rounds.
SETTLED, ROUNDS = 1e-4, 500
#: Edges added to the counted ones: of independent labels in a chain; at a hub this share of them agrees.
SMOOTHING, AGREEING = 50, 0.9
#: Digits of the shortest phone number and of the shortest text that repeats by its digits alone.
PHONE_DIGITS, LEAST_DIGITS = 9, 4
_LABELS = len(KINDS) + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2)
    return total % 10 == 0


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 12 <= len(digits) <= 19 and luhn(digits)


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in code points, sorted; leftmost matches per kind, failing ones dropped."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _is_ip(m[0])]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if _is_card(m[0])]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def _shape(token: str) -> int:
    """Bucket of a token's form: runs of digits with their length, letters, other signs, and what it is by itself."""
    form = re.sub(r"[A-Za-z]+", "a", token)
    form = _DIGITS.sub(lambda m: f"d{min(len(m[0]), 20)}", form)
    whole = "i" if _IP.fullmatch(token) and _is_ip(token) else "c" if _CARD.fullmatch(token) and _is_card(token) else ""
    return zlib.crc32(f"{whole}|{form[:40]}".encode()) % SHAPES


def _allowed(token: str) -> list[bool]:
    """Kinds whose own check a lone token does not fail."""
    n = sum(len(d) for d in _DIGITS.findall(token))
    dots = token.count(".") == 3 and _IP.fullmatch(token) is not None
    long = n >= 12 and _CARD.fullmatch(token) is not None
    return [True, "@" in token, dots and _is_ip(token), long and _is_card(token), 0 < n <= 15 and not long and not dots and "@" not in token]


class Field:
    """The nodes, chain edges and hubs of some texts.

    A node inside a pattern span of several tokens is a part of a mention: it hangs on no hub by its
    own text unless it could be a number by itself, and the first part stands for the span's digits.
    """

    def __init__(self, documents: list[str], spans: list[list[tuple[int, int, int]]]):
        self.doc, self.start, self.end, self.label, self.shape, allowed = [], [], [], [], [], []
        chain, inside, members, self.hub_doc, things = [], [], [], [], []
        for d, (text, found) in enumerate(zip(documents, spans)):
            last_at, last_span, k, hubs, named = -2, None, 0, {}, {}
            for at, m in enumerate(_TOKEN.finditer(text)):
                token = m[0]
                if not _NODE.search(token):
                    continue
                core = _EDGES.sub("", token)
                if not core:
                    continue
                start = m.start() + token.find(core)
                end = start + len(core)
                while k < len(found) and found[k][2] <= start and found[k][0] < start:
                    k += 1
                span = next((x for x in found[k:k + 8] if x[0] < end and x[2] > start), None)
                label = span[1] + 1 if span else 0
                i = len(self.doc)
                self.doc.append(d)
                self.start.append(start)
                self.end.append(end)
                self.label.append(label)
                self.shape.append(_shape(core))
                allowed.append(_allowed(core))
                if last_at == at - 1:
                    chain.append((i - 1, i))
                    inside.append(span is not None and span == last_span)
                part = span is not None and not (m.start() <= span[0] and span[2] <= m.end())
                digits = "".join(_DIGITS.findall(core))
                keys = set()
                if not part or len(digits) >= PHONE_DIGITS:
                    number = len(digits) >= LEAST_DIGITS and "@" not in core and not _IP.fullmatch(core)
                    keys = {core.lower(), "#" + digits} if number and core != digits else {"#" + digits if number else core.lower()}
                if part and span != last_span:
                    keys.add("#" + "".join(_DIGITS.findall(text[span[0]:span[2]])))
                for key in keys:
                    hubs.setdefault(key, []).append(i)
                named.setdefault((core.lower(), part), (self.shape[-1], set()))[1].add(label)
                last_at, last_span = at, span
            for nodes in hubs.values():
                if len(nodes) > 1:
                    members += [(i, len(self.hub_doc)) for i in nodes]
                    self.hub_doc.append(d)
            things += [(shape, label) for shape, labels in named.values() for label in (labels - {0} or {0})]
        self.doc, self.hub_doc = np.array(self.doc, np.int64), np.array(self.hub_doc, np.int64)
        self.label, self.shape = np.array(self.label, np.int64), np.array(self.shape, np.int64)
        self.allowed = np.array(allowed, bool).reshape(-1, _LABELS)
        self.chain, self.inside = np.array(chain, np.int64).reshape(-1, 2), np.array(inside, bool)
        self.members = np.array(members, np.int64).reshape(-1, 2)
        self.things = np.array(things, np.int64).reshape(-1, 2)


def _counts(field: Field) -> np.ndarray:
    """Things by shape and label, chain edges by both labels, hubs by their label and their mentions', in one vector.

    A thing is a token text of a document, labelled if any mention of it is.  Edges inside one span
    say nothing.  A hub without a label counts as none; one with labels counts its mentions that have
    one: of the others it is not known whether they are of the kind.
    """
    out = [np.bincount(field.things[:, 0] * _LABELS + field.things[:, 1], minlength=SHAPES * _LABELS)]
    pair = field.label[field.chain[~field.inside]]
    out.append(np.bincount(pair[:, 0] * _LABELS + pair[:, 1], minlength=_LABELS ** 2))
    seen = np.zeros((len(field.hub_doc), _LABELS), np.int64)
    np.add.at(seen, (field.members[:, 1], field.label[field.members[:, 0]]), 1)
    some = seen[:, 1:].any(1)
    own = np.where(some, seen[:, 1:].argmax(1) + 1 if len(seen) else 0, 0)
    both = np.zeros((_LABELS, _LABELS), np.int64)
    both[0, 0] = np.count_nonzero(~some)
    several = seen[:, 1:].sum(1) > 1
    for h in range(1, _LABELS):
        both[h, 1:] = np.count_nonzero(seen[several & (own == h), 1:], axis=0)
    return np.concatenate([*out, both.ravel()])


class Potentials:
    """Log potentials from the counts; at most ``SHAPES`` times five numbers whatever the corpus."""

    def __init__(self, counts: np.ndarray):
        nodes = counts[:SHAPES * _LABELS].reshape(SHAPES, _LABELS).astype(float)
        missed = nodes * (1 - PATTERN_RECALL) / PATTERN_RECALL  # of each kind, beyond what the patterns found
        missed[:, 0] = nodes[:, 0] + 1
        self.node = np.log(missed + 1e-6)
        share = (nodes.sum(0) + 1) / (nodes.sum() + _LABELS)
        chain, hub = counts[SHAPES * _LABELS:].reshape(2, _LABELS, _LABELS).astype(float)
        joint = chain + chain.T + SMOOTHING * np.outer(share, share)
        joint /= joint.sum()
        self.chain = np.log(joint / np.outer(joint.sum(1), joint.sum(0)))
        agree = hub + SMOOTHING * (AGREEING * np.eye(_LABELS) + (1 - AGREEING) * share)
        self.hub = np.log(share)
        #: Log of P(label of a mention | label of its hub) over the mention's share; rows are the hub's labels.
        self.member = np.log(agree / agree.sum(1, keepdims=True) / share)


def _normal(x: np.ndarray) -> np.ndarray:
    top = x.max(1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(1, keepdims=True))


def infer(field: Field, potentials: Potentials) -> np.ndarray:
    """Beliefs ``(nodes, labels)`` by damped sum-product messages along all edges at once.

    A document takes part until its own messages have settled, so its beliefs do not depend on the
    documents it is read with.
    """
    n, hubs = len(field.doc), len(field.hub_doc)
    unary = np.where(field.allowed, potentials.node[field.shape], -50.0)
    fixed = np.flatnonzero(field.label)
    unary[fixed] = -50.0
    unary[fixed, field.label[fixed]] = 0.0
    unary = np.concatenate([unary, np.tile(potentials.hub, (hubs, 1))])
    doc = np.concatenate([field.doc, field.hub_doc])
    node, hub = field.members[:, 0], field.members[:, 1]
    source = np.concatenate([field.chain[:, 0], field.chain[:, 1], node, hub + n])
    target = np.concatenate([field.chain[:, 1], field.chain[:, 0], hub + n, node])
    c, m = len(field.chain), len(field.members)
    kind = np.repeat([0, 1, 2], [2 * c, m, m])
    tables = np.stack([potentials.chain, potentials.member.T, potentials.member])
    back = np.concatenate([np.arange(c, 2 * c), np.arange(c), np.arange(2 * c + m, 2 * c + 2 * m), np.arange(2 * c, 2 * c + m)])
    free = field.label[node] == 0
    weight = np.ones(len(source))
    weight[2 * c:2 * c + m] = np.where(free, 1 / np.maximum(1, np.bincount(hub[free], minlength=hubs))[hub], 1)
    weight = weight[:, None]
    messages, belief = np.zeros((len(source), _LABELS)), unary.copy()
    going = np.arange(len(source))
    documents = int(field.doc.max()) + 1 if n else 0
    for _ in range(ROUNDS):
        if not len(going):
            break
        out = (belief[source[going]] - (weight * messages)[back[going]])[:, :, None] + tables[kind[going]]
        top = out.max(1)
        new = _normal(top + np.log(np.exp(out - top[:, None, :]).sum(1)))
        change = np.zeros(documents)
        np.maximum.at(change, doc[source[going]], np.abs(new - messages[going]).max(1))
        messages[going] = DAMPING * messages[going] + (1 - DAMPING) * new
        belief[target[going]] = unary[target[going]]
        np.add.at(belief, target[going], weight[going] * messages[going])
        going = going[change[doc[source[going]]] > SETTLED]
    return np.exp(_normal(belief[:n])) if n else np.zeros((0, _LABELS))


def added_spans(field: Field, beliefs: np.ndarray, texts_: list[str], spans: list) -> list[list[tuple[int, int, int]]]:
    """Spans of nodes believed to be of a kind; neighbours of one kind are one span, pattern spans are left alone."""
    out = [[] for _ in texts_]
    best = beliefs.argmax(1)
    near = {int(b): int(a) for a, b in field.chain}
    last = {}
    for i in np.flatnonzero((best > 0) & (beliefs.max(1) >= BELIEF) & (field.label == 0)).tolist():
        d, kind = field.doc[i], int(best[i]) - 1
        if any(s < field.end[i] and e > field.start[i] for s, _, e in spans[d]):
            continue
        if near.get(i) in last and last[near[i]][1] == kind:
            out[d][-1] = (out[d][-1][0], kind, field.end[i])
        else:
            out[d].append((field.start[i], kind, field.end[i]))
        last[i] = out[d][-1]
    return out


def _with_nodes(part: pa.StringArray) -> np.ndarray:
    return np.flatnonzero(pc.match_substring_regex(part, "[0-9@]").to_numpy(zero_copy_only=False))


def count_potentials(rows: DataFrame) -> np.ndarray:
    """The counts over every text of ``(doc_id, text)``; added up in each batch, so few rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(SHAPES * _LABELS + 2 * _LABELS ** 2, np.int64)
        for b in batches:
            for _, part in slices(b.column(0), 4 << 20):
                some = part.take(pa.array(_with_nodes(part))).to_pylist()
                total += _counts(Field(some, [pattern_spans(t) for t in some]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    counted = rows.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SHAPES * _LABELS + 2 * _LABELS ** 2, np.int64)
    out[counted["at"].to_numpy()] = counted["n"].to_numpy()
    return out


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, added)``: arrays of ``(start, kind, end)`` of every whole text, each sorted.

    Null texts count as empty and have no spans; an empty table gives no rows.
    """
    rows = texts(docs, id_col, text_col)
    return _spans(rows, Potentials(count_potentials(rows)), ["doc_id"])


def _spans(rows: DataFrame, potentials: Potentials, keep: list[str]) -> DataFrame:
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()),
                                     T.StructField("end", T.IntegerType())]))
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("base", span), T.StructField("added", span)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
    at_text, at_keep, names = rows.columns.index("text"), [rows.columns.index(c) for c in keep], schema.names

    def run(batches):
        for b in batches:
            for first, part in slices(b.column(at_text), 4 << 20):
                found, added = [[]] * len(part), [[]] * len(part)
                at = _with_nodes(part)
                some = part.take(pa.array(at)).to_pylist()
                spans = [pattern_spans(t) for t in some]
                field = Field(some, spans)
                more = added_spans(field, infer(field, potentials), some, spans) if len(field.doc) else [[]] * len(some)
                named = lambda x: [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in x]
                for i, x, y in zip(at, spans, more):
                    found[i], added[i] = named(x), named(y)
                kept = [b.column(c).slice(first, len(part)) for c in at_keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, kind), pa.array(added, kind)], names)

    return rows.mapInArrow(run, schema)


def digest(spans: DataFrame) -> DataFrame:
    """Counts of the pattern spans, the hash of their list, and the list of all spans, in built-in functions."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    listed = F.array_join(F.transform("base", line), ",")
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(
        x["start"].alias("start"), order[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return spans.select(
        "doc_id", *[F.size(F.filter("base", lambda x: x["kind"] == F.lit(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed, 256).alias("base_sha256"), F.array_join(F.transform(every, line), ",").alias("spans"))


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans are replaced as one.

    All rows and columns stay, null texts stay null; ``length_col``, where there is such a
    column, gets the new length of texts that changed.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    potentials = Potentials(count_potentials(docs.select(text.alias("text"))))
    schema = docs.schema
    at = docs.columns.index(text_col)
    at_length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        for b in batches:
            for first, part in slices(b.column(at), 4 << 20):
                rows = _with_nodes(part)
                some = part.take(pa.array(rows)).to_pylist()
                spans = [pattern_spans(t) for t in some]
                field = Field(some, spans)
                more = added_spans(field, infer(field, potentials), some, spans) if len(field.doc) else [[]] * len(some)
                own = b.slice(first, len(part))
                changed, lengths = own.column(at).to_pylist(), own.column(at_length).to_pylist() if at_length is not None else []
                for i, t, x, y in zip(rows.tolist(), some, spans, more):
                    if x or y:
                        changed[i] = _masked(t, sorted([*x, *y]))
                        if lengths:
                            lengths[i] = len(changed[i])
                columns = list(own.columns)
                columns[at] = pa.array(changed, own.schema.field(at).type)
                if lengths:
                    columns[at_length] = pa.array(lengths, own.schema.field(at_length).type)
                yield pa.RecordBatch.from_arrays(columns, schema=own.schema)

    return docs.mapInArrow(run, schema)


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
