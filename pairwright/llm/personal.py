"""Personal data by rules and a skip-chain conditional random field.

Rules find e-mail addresses, IP addresses, card and phone numbers of exact form. The field finds further mentions. Its
nodes are a document's words with a digit or ``@``; no other word can be part of these kinds. Neighbouring nodes share a
chain potential; words that are equal, end in the same seven digits or have the same part after the ``@`` share a skip
potential, wherever they stand, from each occurrence to the next. Words inside a rule's span are observed. Loopy belief
propagation then carries a label from a clear mention to unclear ones, over all documents of an Arrow batch at once. A
word that gets a kind with ``SURE`` probability is a span, neighbours of one kind are one span.

Weights are trained here, by pseudolikelihood in numpy on what the rules say of a bounded sample: words of at most
``sample_docs`` documents, the first by a hash of doc_id among those with a digit or ``@``, ``sample_words`` in all. The
sample's features are made in tasks; integers reach the driver, never texts.

Rules and graphs are linear in a text. Scoring is one pass without a shuffle; texts without a digit or ``@`` stay in the
JVM.

Defined cases: null and empty texts have no spans; a null doc_id never is in the sample; equal rows get equal rows; texts are read
whole, however long; extra columns are ignored; an empty table gives no rows; a corpus without any find adds no spans.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
SAMPLE_DOCS, SAMPLE_WORDS = 4_000, 60_000
#: Features of a word.
WIDTH = 16
#: Feature buckets, training steps, rounds of messages, and what probability makes a span.
BUCKETS, STEPS, ROUNDS, SURE = 1 << 12, 250, 40, 0.9
#: What training starts from and is held to: neighbours tell little, linked words agree.
AGREE, RIDGE = 5.0, 1e-3
NEED = "[0-9@]"
SPACE = " \t\n\x0b\f\r"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9]+")
_NUMBER = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HIT = re.compile(NEED)
_BLANK = re.compile(f"[{SPACE}]")
_PARTS = ((re.compile(r"[0-9]+"), "9"), (re.compile(r"[^\W\d_]+"), "a"))
_EDGE = "\"'.,;:!?()[]{}<>#*$%&|="


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        while at > done and text[at - 1] in _LOCAL:
            at -= 1
        if at < m.start():
            done = m.end()
            yield at, done


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        parts = list(_DIGITS.finditer(text, *run.span())) if "." in run[0] else []
        for i in range(0, len(parts) - 3, 4):
            if all(len(x) <= 3 and int(x) <= 255 for x in (p[0].lstrip("0") or "0" for p in parts[i : i + 4])):
                yield parts[i].start(), parts[i + 3].end()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _NUMBER.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def base(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by the rules, by kind and start."""
    return [(k, *span) for k, find in enumerate((_emails, _ips, _cards, _phones)) for span in find(text)]


def nodes(text: str) -> list[tuple[int, int]]:
    """(start, end) of the words with a digit or ``@``, in order; every character is looked at a fixed number of times."""
    out, done = [], 0
    hit = _HIT.search(text)
    while hit:
        start = 1 + max(done - 1, *(text.rfind(c, done, hit.start()) for c in SPACE))
        end = m.start() if (m := _BLANK.search(text, hit.end())) else len(text)
        out.append((start, end))
        done = end
        hit = _HIT.search(text, end)
    return out


def features(word: str, before: str) -> list[int]:
    """Buckets of what a word looks like and of the word before it, ``WIDTH`` numbers."""
    core = word.strip(_EDGE)
    shape, digits = core, "".join(_DIGITS.findall(core)) if len(core) < 200 else core[:40]
    for pattern, sign in _PARTS:
        shape = pattern.sub(sign, shape)
    n = min(len(digits), 24)
    dotted = core.split(".")
    said = [
        "bias", f"shape:{shape if len(shape) < 60 else 'long'}", f"digits:{n}", f"size:{min(len(core), 40) // 4}", f"begins:{core[:1] if not core[:1].isalnum() else core[:1].isdigit()}",
        f"ends:{word[-1:] if not word[-1:].isalnum() else word[-1:].isdigit()}", f"dots:{min(len(dotted), 6)}", f"at:{'@' in core}", f"plus:{word.startswith('+')}", f"open:{word.startswith('(')}",
        f"card:{13 <= n <= 19 and luhn(digits[:24]) if digits.isascii() and digits.isdigit() else False}", f"bytes:{len(dotted) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in dotted)}",
        f"before:{before.strip(_EDGE).lower()[:24]}", f"lead:{before[-1:] if before[-1:] in ':=' else ''}", f"letters:{any(c.isalpha() for c in core[:64])}", f"dashes:{min(core.count('-'), 4)}",
    ]
    return [zlib.crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS for s in said]


def skip_keys(word: str) -> list[str]:
    """What makes words alike: the whole word, its last seven digits, what follows the ``@``."""
    core = word.strip(_EDGE).lower()
    digits = "".join(_DIGITS.findall(core))
    out = [core] if len(core) >= 4 else []
    out += [f"7:{digits[-7:]}"] if len(digits) >= 7 else []
    return out + ([f"@:{core.rpartition('@')[2]}"] if core.rpartition("@")[2] != core else [])


class Graph:
    """The fields of some texts side by side: words, features, observed labels (-1: none) and edges (kind 0 chain, 1 skip)."""

    def __init__(self, texts: list[str]) -> None:
        self.spans: list[list[tuple[int, int, int]]] = []
        self.words: list[tuple[int, int, int]] = []  # text, start, end
        self.next_to: list[bool] = []  # whether a word follows the one before it
        feats, seen, edges = [], [], {}
        for t, text in enumerate(texts):
            found = base(text)
            self.spans.append(found)
            last: dict[str, int] = {}
            done = 0
            by_start = sorted((s, e, k) for k, s, e in found)
            live: list[tuple[int, int, int]] = []
            at = 0
            for start, end in nodes(text):
                i = len(self.words)
                gap = text[done:start].split()
                beside = bool(done) and not gap
                self.words.append((t, start, end))
                self.next_to.append(beside)
                word = text[start:end]
                feats.append(features(word, gap[-1] if gap else text[max(0, done - 24) : done] if beside else ""))
                while at < len(by_start) and by_start[at][0] < end:
                    live.append(by_start[at])
                    at += 1
                live = [x for x in live if x[1] > start]
                seen.append(min((k for s, e, k in live if s < end and e > start), default=-1) + 1)
                if beside:
                    edges[i - 1, i] = 0
                for key in skip_keys(word):
                    if key in last:
                        edges.setdefault((last[key], i), 1)
                    last[key] = i
                done = end
        self.feats = np.array(feats, np.int64).reshape(len(feats), WIDTH)
        self.seen = np.array(seen, np.int64)
        self.ends = np.array(list(edges), np.int64).reshape(-1, 2)
        self.kinds = np.array(list(edges.values()), np.int64)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis, keepdims=True)) + most


def marginals(unary: np.ndarray, ends: np.ndarray, pots: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities per node by damped loopy belief propagation; *pots* (edge, label, label). Exact on trees no deeper than *rounds*."""
    n, labels = unary.shape
    m = len(ends)
    source, target = np.r_[ends[:, 0], ends[:, 1]], np.r_[ends[:, 1], ends[:, 0]]
    both = np.concatenate([pots, pots.transpose(0, 2, 1)])
    back = np.r_[np.arange(m, 2 * m), np.arange(m)]
    told = np.full((2 * m, labels), -np.log(labels))
    for turn in range(rounds + 1):
        belief = unary + np.stack([np.bincount(target, told[:, k], n) for k in range(labels)], 1)
        if turn == rounds or not m:
            break
        new = _log_sum((belief[source] - told[back])[:, :, None] + both, 1)[:, 0]
        new -= _log_sum(new, 1)
        moved = np.abs(new - told).max()
        told = new if turn < 3 else 0.5 * (new + told)
        if moved < 1e-5:
            break
    return np.exp(belief - _log_sum(belief, 1))


class Model:
    """Weights of features (bucket, label), chain and skip potentials (label, label)."""

    def __init__(self) -> None:
        self.own = np.zeros((BUCKETS, LABELS))
        self.own[zlib.crc32(b"bias") % BUCKETS, 0] = 6.0  # untrained: nothing is personal
        self.chain, self.skip = np.zeros((LABELS, LABELS)), AGREE * np.eye(LABELS)

    def spans(self, graph: Graph, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text the rules' spans and the field's, by kind and start."""
        out = [list(s) for s in graph.spans]
        if not len(graph.words):
            return out
        unary = self.own[graph.feats].sum(1)
        fixed = graph.seen > 0
        unary[fixed] = -1e3
        unary[fixed, graph.seen[fixed]] = 0
        p = marginals(unary, graph.ends, np.stack([self.chain, self.skip])[graph.kinds])
        best = p.argmax(1)
        open_ = (best > 0) & (p[np.arange(len(p)), best] >= SURE) & ~fixed
        i = 0
        while i < len(open_):
            j = i + 1
            if open_[i]:
                while j < len(open_) and open_[j] and best[j] == best[i] and graph.next_to[j] and best[i] > 2:
                    j += 1
                t, start, end = *graph.words[i][:2], graph.words[j - 1][2]
                if span := _trimmed(texts[t], int(best[i]) - 1, start, end):
                    out[t].append(span)
            i = j
        return [sorted(s) for s in out]


def _trimmed(text: str, kind: int, start: int, end: int) -> tuple[int, int, int] | None:
    """A new span without the marks around it; None where it lacks what the kind must have."""
    while start < end and not (text[start].isalnum() or kind == 3 and text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    body = text[start:end]
    digits = sum("0" <= c <= "9" for c in body)
    at = body.find("@")
    fine = (0 < at < len(body) - 1, body.count(".") == 3 and digits >= 4, 12 <= digits <= 19, 7 <= digits <= 15)[kind]
    return (kind, start, end) if fine and (kind == 0 or not any(c.isalpha() for c in body)) else None


def fit(feats: np.ndarray, labels: np.ndarray, around: np.ndarray, steps: int = STEPS, seed: int = 7) -> Model:
    """Pseudolikelihood: each word's label given its features and *around*, counts (word, 3 * labels) of labels before it,
    after it and linked to it. Full-batch Adam."""
    model = Model()
    if not len(labels) or not labels.any():
        return model
    start = [np.zeros((BUCKETS, LABELS)), np.zeros((3 * LABELS, LABELS))]
    start[1][2 * LABELS :] = AGREE * np.eye(LABELS)
    value = [x.copy() for x in start]
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in value]
    n = len(feats)
    flat = feats.ravel()
    truth = np.eye(LABELS)[labels]
    rng = np.random.default_rng(seed)
    for step in range(1, steps + 1):
        # Half of the features are left out at random, so that links, too, are learnt from.
        shown = 2.0 * (rng.random(feats.shape) < 0.5)
        z = np.einsum("nwl,nw->nl", value[0][feats], shown) + around @ value[1]
        err = (np.exp(z - _log_sum(z, 1)) - truth) / n
        grads = [np.stack([np.bincount(flat, (shown * err[:, k : k + 1]).ravel(), BUCKETS) for k in range(LABELS)], 1), around.T @ err]
        for v, v0, g, (m, s) in zip(value, start, grads, state, strict=True):
            g = g + RIDGE / n**0.5 * (v - v0)
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    model.own = value[0]
    left, right, skip = value[1].reshape(3, LABELS, LABELS)
    model.chain, model.skip = (left + right.T) / 2, (skip + skip.T) / 2
    return model


def _around(graph: Graph) -> np.ndarray:
    out = np.zeros((len(graph.words), 3, LABELS))
    for (a, b), kind in zip(graph.ends, graph.kinds, strict=True):
        out[b, 2 if kind else 0, graph.seen[a]] += 1
        out[a, 2 if kind else 1, graph.seen[b]] += 1
    return out.reshape(len(graph.words), -1)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Model:
    """The model of a bounded sample of *docs* (doc_id, text)."""
    able = docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(NEED)).select("doc_id", F.col("text").cast("string").alias("text"))
    turn = F.xxhash64("doc_id")
    # At most sample_docs ids.
    first = able.select("doc_id").distinct().orderBy(turn, "doc_id").limit(sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            graph = Graph(batch.column(1).to_pylist())
            turns = np.array(batch.column(0))
            owner = np.array([w[0] for w in graph.words], np.int64)
            start = np.array([w[1] for w in graph.words], np.int64)
            around = _around(graph).astype(np.int32)
            columns = [pa.array(turns[owner]), pa.array(start), pa.array(graph.seen.astype(np.int32)), pa.array(list(graph.feats.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(around), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["turn", "at", "label", "feats", "around"])

    held = able.join(F.broadcast(first), "doc_id").select(turn.alias("turn"), "text")
    rows = held.mapInArrow(run, "turn long, at long, label int, feats array<int>, around array<int>").orderBy("turn", "at", "label", "feats", "around").limit(sample_words).collect()
    if not rows:
        return Model()
    return fit(np.array([r["feats"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["around"] for r in rows], float))


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


NOTHING = hashlib.sha256(b"").hexdigest()


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of *docs* (doc_id, text): counts of the rules' spans, their digest, and all spans."""
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(i, t) for i, t in enumerate(batch.column(1).to_pylist()) if t]
            n, digest, spans = np.zeros((batch.num_rows, len(KINDS)), np.int64), [NOTHING] * batch.num_rows, [""] * batch.num_rows
            graph = Graph([t for _, t in texts])
            for (i, _), found, every in zip(texts, graph.spans, model.spans(graph, [t for _, t in texts]), strict=True):
                for k, _, _ in found:
                    n[i, k] += 1
                digest[i], spans[i] = hashlib.sha256(_said(found).encode()).hexdigest(), _said(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in n.T], pa.array(digest), pa.array(spans)], names=["doc_id", *counts, "base_sha256", "spans"])

    text = F.col("text").cast("string")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(NEED), text).alias("text"))
    return held.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, train(docs))
