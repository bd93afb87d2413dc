"""Personal data: fixed patterns and a skip-chain conditional random field.

The patterns find e-mail addresses, IPv4 addresses, card and phone numbers;
their matches always stay.  The random field adds spans that the patterns miss.
Its nodes are the tokens (runs without white space) that hold a digit, an '@'
or a written-out 'at', and runs of groups of digits; all other tokens are
outside by their features.  A node that a pattern covers is observed.
Neighbouring nodes share a chain potential.  Distant nodes of one document with
the same digits, mailbox or address share a skip potential, and those that are
alike (the last seven digits, the mailbox at another domain, an address of the
same network) another one, so a number written once in full settles how its
other spellings are read; every open mention is also linked to an observed one
of its key.  Marginals come from loopy sum-product message passing over the
document's graph, in sweeps until the messages settle.

All potentials are learned together by pseudo-likelihood, on the labels that
the patterns give to the ``SAMPLE_DOCS`` documents of least id hash: each node
given its own features and its neighbours' labels.  Every document with
personal data is also learned from with each match spelled again in another way
(that label), beside a decoy of the same form with other characters and, for
addresses and cards, a copy with a mistake (both outside).  Equal cases are
counted together; of different ones at most the ``SAMPLE_CASES`` commonest reach
the driver.

Defined results.  Null and blank texts have no span.  Every row is worked on by
itself, whatever its id.  Offsets are code points, the end exclusive.  Spans
that are equal are listed once.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 20_000
SAMPLE_CASES = 100_000
ADD_AT = 0.9  #: marginal from which a span is added
SWEEPS = 100  #: and one more for each node, if messages have not settled before
DAMP_FROM = 20  #: sweeps without damping
SETTLED = 1e-4  #: largest change of a message
OUT = 0

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|\bat\b|\(at\)|\[at\]", re.I)
_GROUP = re.compile(r"\(?[0-9][0-9().-]*").fullmatch
_FOUR = re.compile(r"([0-9]{1,3})(\[\.\]|\(\.\)|[.,-])([0-9]{1,3})\2([0-9]{1,3})\2([0-9]{1,3})").fullmatch
_TOKEN = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    """Leftmost matches, found from each '@'; time follows the length of the text."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
            at = done
        else:
            done = max(done, at + 1)  # no local part reaches over an '@'
            at += 1


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind, then start."""
    if not text:
        return []
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split(".")))]
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() < 64 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def spans_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(set(spans)))


# nodes ------------------------------------------------------------------------

_BITS = 21
_STRIP = ".,;:!?\"'<>()[]"


@dataclass
class Node:
    start: int
    end: int
    text: str
    label: int | None  #: from a pattern: kind + 1
    key: str  #: what distant tokens are compared by
    loose: str  #: and what those that are alike have in common


def _keys(token: str) -> tuple[str, str]:
    low = re.sub(r"\((?:at)\)|\[(?:at)\]", "@", token.lower())
    low = re.sub(r"\[(?:\.|dot)\]|\((?:\.|dot)\)", ".", low).strip(_STRIP)
    if "@" in low:
        return "m:" + low, "m~" + low.split("@")[0]
    four = _FOUR(low)
    if four:
        parts = [four[1], four[3], four[4], four[5]]
        return "i:" + ".".join(parts), "i~" + ".".join(parts[:3])
    d = _digits(low)
    if len(d) >= 7 and not re.search(r"[a-z]", low):
        return "d:" + d[-10:], "d~" + d[-7:]
    return "", ""


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[Node]:
    """Tokens that can be personal data, with the patterns' labels.

    Tokens that a space splits but a pattern joins are one node, and so are
    groups of digits with one space between them.
    """
    if not _MARK.search(text):
        return []
    out: list[Node] = []
    order = sorted(base, key=lambda s: (s[1], -s[2]))
    i = 0
    held = None
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while i < len(order) and order[i][2] <= start:
            i += 1
        cover = next((s for s in order[i : i + 4] if s[1] < end and s[2] > start), None)
        if cover:
            if held is not cover:
                body = text[cover[1] : cover[2]]
                out.append(Node(cover[1], cover[2], body, cover[0] + 1, *_keys(re.sub(r"\s", "", body))))
                held = cover
            continue
        if _MARK.search(m[0]):
            x = out[-1] if out else None
            if x and x.label is None and x.end + 1 == start and text[x.end] == " " and _GROUP(m[0].rstrip(_STRIP)) and _GROUP(x.text.split(" ")[-1]) and sum("0" <= c <= "9" for c in text[x.start : end]) <= 19:
                x.end, x.text = end, text[x.start : end]
                x.key, x.loose = _keys(x.text.replace(" ", ""))
            else:
                out.append(Node(start, end, m[0], None, *_keys(m[0])))
    return out


def node_features(token: str) -> list[float]:
    """What a token alone says; shares are rounded, so that equal cases can be counted together."""
    body = token.strip(_STRIP)
    d = _digits(token)
    n = len(d)
    letters = sum(c.isalpha() for c in token)
    parts = body.split(".")
    written = bool(re.search(r"\bat\b|\(at\)|\[at\]", token, re.I))
    return [float(x) for x in (
        n == 0, 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n >= 20, "@" in token, "@" not in token and written,
        min(4, body.count(".")) / 4, "+" in token, "(" in token, "-" in token, round(letters / max(1, len(token)), 1), " " in token,
        len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts), len(parts) != 4 and bool(_FOUR(body)), 13 <= n <= 19 and luhn(d),
        "/" in token or ":" in body, "[.]" in token or "(.)" in token, 1,
    )]


CHAIN, SAME, ALIKE = 0, 1, 2  #: kinds of edges


@dataclass
class Field:
    """Potentials of the random field; label 0 is outside, kind + 1 the kinds."""

    weights: np.ndarray  #: features x labels
    pairs: np.ndarray  #: log potentials of an edge's labels, by kind of edge

    def marginals(self, unary: np.ndarray, edges: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
        """Loopy sum-product; ``edges`` are (i, j, log potential [label of i, label of j]).

        A sweep goes through the nodes forward and backward and passes on what it has just
        learned, so evidence crosses a path of any length in one sweep; a tree is exact after one.
        """
        n, k = unary.shape
        inbox: list[list[int]] = [[] for _ in range(n)]
        up: list[list[int]] = [[] for _ in range(n)]
        down: list[list[int]] = [[] for _ in range(n)]
        pot = []
        for i, j, p in edges:
            for a, b, q in ((i, j, p), (j, i, p.T)):
                inbox[b].append(len(pot))
                (up if a < b else down)[a].append(len(pot))
                pot.append(np.exp(q - q.max()))
        log_node = unary - unary.max(1, keepdims=True)
        log_msg = np.full((len(pot), k), -np.log(k))
        passes = [(v, out[v]) for order, out in ((range(n), up), (range(n - 1, -1, -1), down)) for v in order if out[v]]
        sweep, moved = 0, 1.0
        # only loops need more than two sweeps; the bound follows the graph
        while moved > SETTLED and sweep < SWEEPS + n:
            moved = 0.0
            for v, out in passes:
                belief = log_node[v] + log_msg[inbox[v]].sum(0)
                for e in out:
                    x = belief - log_msg[e ^ 1]
                    new = np.exp(x - x.max()) @ pot[e]
                    new /= new.sum()
                    old = np.exp(log_msg[e])
                    if sweep >= DAMP_FROM:
                        new = 0.5 * new + 0.5 * old
                    moved = max(moved, float(np.abs(new - old).max()))
                    log_msg[e] = np.log(np.maximum(new, 1e-300))
            sweep += 1
        belief = log_node + np.array([log_msg[e].sum(0) for e in inbox]).reshape(n, k)
        belief = np.exp(belief - belief.max(1, keepdims=True))
        return belief / belief.sum(1, keepdims=True)


def graph(found: list[Node]) -> list[tuple[int, int, int]]:
    """(kind, i, j) of the edges: neighbours with one gap of white space; each node with the one before of its key,
    and with the one before that is alike; each open node with the observed one of its key before it, else the first after it.

    A key's nodes form a path, so the edges follow the number of nodes.
    """
    out = [(CHAIN, i, i + 1) for i in range(len(found) - 1) if found[i + 1].start - found[i].end <= 1]
    last: dict[str, int] = {}
    known = set()
    for i, x in enumerate(found):
        if x.key:
            if x.key in last:
                out.append((SAME, last[x.key], i))
                known.add((last[x.key], i))
            j = last.get(x.loose)
            if j is not None and found[j].key != x.key:
                out.append((ALIKE, j, i))
            last[x.key] = last[x.loose] = i
    first: dict[str, int] = {}
    for i, x in enumerate(found):
        if x.key and x.label is not None:
            first.setdefault(x.key, i)
    seen: dict[str, int] = {}
    for i, x in enumerate(found):
        if x.key and x.label is not None:
            seen[x.key] = i
        elif x.key in first:
            edge = tuple(sorted((seen.get(x.key, first[x.key]), i)))
            if edge not in known:
                out.append((SAME, *edge))
    return out


def _with_open(n: int, edges: list[tuple[int, int, int]], is_open: list[bool]) -> list[int]:
    """Nodes of the components that hold an open node; the others are settled."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for _, i, j in edges:
        root[find(i)] = find(j)
    wanted = {find(i) for i in range(n) if is_open[i]}
    return [i for i in range(n) if find(i) in wanted]


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Spans that the random field adds to the patterns' matches."""
    found = nodes(text, base)
    edges = graph(found)
    kept = _with_open(len(found), edges, [x.label is None for x in found])
    if not kept:
        return []
    place = {i: k for k, i in enumerate(kept)}
    edges = [(place[i], place[j], field.pairs[kind]) for kind, i, j in edges if i in place]
    found = [found[i] for i in kept]
    unary = np.array([node_features(x.text) for x in found]) @ field.weights
    for i, x in enumerate(found):
        if x.label is not None:
            unary[i] = -50.0
            unary[i, x.label] = 0.0
    p = field.marginals(unary, edges)
    out = []
    for x, q in zip(found, p):
        label = int(q.argmax())
        if x.label is None and label != OUT and q[label] >= ADD_AT:
            body = x.text.strip(_STRIP)
            if body:
                start = x.start + x.text.index(body)
                out.append((label - 1, start, start + len(body)))
    return [s for s in out if not any(b[1] < s[2] and b[2] > s[1] for b in base)]


# learning -----------------------------------------------------------------------


def _spoiled(token: str, kind: int) -> str | None:
    """The token with the mistake that its pattern would reject, for addresses and cards."""
    if KINDS[kind] == "ip":
        return "999" + token[token.index(".") :]
    if KINDS[kind] == "card":
        return token[:-1] + str((int(token[-1]) + 1) % 10)
    return None


def _spelled(token: str, kind: int, way: int) -> str:
    """The same entity as its pattern would not find it."""
    if KINDS[kind] == "email":
        return token.replace("@", ("(at)", "[at]")[way % 2])
    if KINDS[kind] == "ip":
        return token.replace(".", ("[.]", "(.)", "-")[way % 3])
    d = _digits(token)
    if KINDS[kind] == "card":
        return "..".join(d[i : i + 4] for i in range(0, len(d), 4)) if way % 2 else "/".join(d[i : i + 4] for i in range(0, len(d), 4))
    d = d[-10:]
    return (d, f"{d[:-7]}-{d[-7:-4]}-{d[-4:]}", f"({d[:-7]}){d[-7:-4]}-{d[-4:]}", f"{d[:-7]} {d[-7:-4]} {d[-4:]}")[way % 4]


def _decoy(token: str) -> str:
    """Something of the same form that is nobody's."""
    digits = str.maketrans("0123456789", "7145920368")
    return re.sub(r"[A-Za-z0-9._%+-]+(?=\(at\)|\[at\])", "look", token.translate(digits))


def respelled(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with every match of a pattern once more in another spelling, beside decoys: (text, spans of the spellings)."""
    parts, spans, at = [text], [], len(text)

    def add(piece: str) -> int:
        nonlocal at
        parts.append(piece)
        at += len(piece)
        return at - len(piece)

    for kind, a, b in base_spans(text):
        token = text[a:b]
        again = _spelled(token, kind, zlib.crc32(token.encode("utf-8", "surrogatepass")))
        if base_spans(f" {again} "):
            continue  # the patterns find it anyway
        add("\nwhere one reads ")
        start = add(again)
        spans.append((kind, start, start + len(again)))
        for other in (_decoy(again), _spoiled(token, kind)):
            if other and not base_spans(f" {other} "):
                add(" elsewhere it says ")
                add(other)
    return "".join(parts), spans


def _cases(text: str, spans: list[tuple[int, int, int]]):
    """(features, label, neighbours' labels by kind of edge) of every node; ``spans`` are labels beside the patterns'."""
    base = base_spans(text)
    found = nodes(text, base)
    labels = [x.label if x.label is not None else next((k + 1 for k, a, b in spans if a <= x.start < b), OUT) for x in found]
    k = len(KINDS) + 1
    near = [[0.0] * (3 * k) for _ in found]
    for kind, i, j in graph(found):
        near[i][kind * k + labels[j]] += 1.0
        near[j][kind * k + labels[i]] += 1.0
    for x, y, z in zip(found, labels, near):
        yield node_features(x.text), y, z


def fit(x: np.ndarray, near: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1, steps: int = 600) -> Field:
    """Pseudo-likelihood of cases that occur ``n`` times: features x, counts of the neighbours' labels by kind of edge, label y.

    ``ridge`` is weighed against all cases together, so that kinds that are rare are learned as well.
    """
    k = len(KINDS) + 1
    if not len(x):
        weights = np.zeros((_BITS, k))
        weights[-1, OUT] = 10.0
        return Field(weights, np.zeros((3, k, k)))
    data, hot = np.hstack([x, near]), np.eye(k)[y]
    share = (n / n.sum())[:, None]
    w = np.zeros((data.shape[1], k))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):  # Adam on a convex function
        z = data @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = data.T @ ((p - hot) * share) + ridge / n.sum() * w
        for e in range(3):  # an edge has no direction
            part = grad[x.shape[1] + e * k : x.shape[1] + (e + 1) * k]
            part[:] = (part + part.T) / 2
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(w[: x.shape[1]], w[x.shape[1] :].reshape(3, k, k))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Learn from the patterns' labels on the documents of least id hash."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def run(batches):
        for batch in batches:
            out = {"x": [], "y": [], "near": []}
            for t in batch.column("text"):
                text = t.as_py() or ""
                if not _MARK.search(text):
                    continue
                again, spans = respelled(text)
                for version in ((text, []), (again, spans)) if spans else ((text, []),):
                    for x, y, near in _cases(*version):
                        out["x"].append(x)
                        out["y"].append(y)
                        out["near"].append(near)
            real = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(out["x"], real), pa.array(out["y"], pa.int32()), pa.array(out["near"], real)], list(out))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = texts.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(run, "x array<double>, y int, near array<double>")
    seen = got.groupBy("x", "y", "near").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "x", "y", "near").limit(SAMPLE_CASES).collect()
    return fit(np.array([r.x for r in seen]), np.array([r.near for r in seen]), np.array([r.y for r in seen], int), np.array([r.n for r in seen], float))


def find_pii(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base_spans, spans (all), n_added of every row."""

    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans", "n_added")}
            for t in batch.column("text"):
                text = t.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base, field) if _MARK.search(text) else []
                for k, name in enumerate(("n_email", "n_ip", "n_card", "n_phone")):
                    out[name].append(sum(s[0] == k for s in base))
                out["base_spans"].append(spans_text(base))
                out["spans"].append(spans_text(base + more))
                out["n_added"].append(len(set(more)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out.values(), kinds)]], ["doc_id", *out])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, n_added long")


def redact(text: str, spans) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in set(spans)):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redact_pii(docs: DataFrame, field: Field) -> DataFrame:
    """The documents with their personal data replaced; other columns stay, ``n_chars`` follows the new text."""

    def run(batches):
        for batch in batches:
            texts = []
            for t in batch.column("text"):
                text = t.as_py()
                if text and _MARK.search(text):
                    base = base_spans(text)
                    text = redact(text, base + added_spans(text, base, field))
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if name == "text" else pa.array([None if x is None else len(x) for x in texts], pa.int64()) if name == "n_chars" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    schema = ", ".join(f"`{c}` {'string' if c == 'text' else 'long' if c == 'n_chars' else t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, schema)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_pii(docs, learn(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")
