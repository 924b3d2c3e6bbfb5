"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is lower-cased, everything but letters and digits becomes one blank, and its features are the character
n-grams inside and at the edges of words, each counted once. Each n-gram has an embedding; their mean goes through a linear softmax of
two classes. Embeddings and softmax are trained together on a bounded sample of labelled rows with both kinds in
it. A misspelt word shares most of its n-grams with the word, so
it needs no entry of its own. As the model is linear, scoring needs one number per n-gram bucket: that table
(2^``bits`` floats) is all that is sent to the tasks.

The sample holds at most ``per_class`` rows of each label, which reach the driver as the set of their n-gram buckets, packed:
2^``bits`` / 8 bytes a row at most, some 100 MB in all, and a few KB a row as a rule. n-grams that fewer than ``least`` of its
texts have, however large it is, are not learnt. Score and sample take whole texts, however long. Rows whose crc32(doc_id) mod 5 is 0 are held out.

Defined cases: null and empty texts have no n-grams and get the bias alone; texts are read whole; labels that are
null are not used; a label that repeats counts once (the larger); rows without doc_id are scored and not held out;
without labels of both kinds every score is the rate of toxic ones (0.5 without any); extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (3, 4, 5, 6)
BITS = 17
DIM = 8
PER_CLASS = 3000
STEPS = 1100
L2 = 1e-5
#: How much the rarer kind of label counts more in training: 0 not at all, 1 until both kinds weigh the same.
POWER = 0.5
#: Texts of the sample that must have an n-gram for it to be learnt.
LEAST = 3


class Grams:
    """Buckets of the n-grams of many texts at once."""

    def __init__(self, bits: int = BITS) -> None:
        self.bits = bits
        table = np.zeros(0x110000, bool)
        table[:] = [chr(i).isalnum() for i in range(0x110000)]
        self.inside = table

    def of(self, text: str | None) -> np.ndarray:
        """Distinct buckets of a text's n-grams, which have no blank strictly inside."""
        if not text:
            return np.zeros(0, np.intp)
        c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(self.inside[c], c, np.uint32(0))
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        c = c[keep]
        blanks = np.cumsum(c == 0, dtype=np.int32)
        seen = np.zeros(1 << self.bits, bool)
        h = c
        for n in range(2, min(max(SIZES), len(c)) + 1):
            h = h[: len(c) - n + 1] * np.uint32(0x01000193) ^ c[n - 1 :]
            if n in SIZES:
                ok = blanks[n - 2 : len(c) - 1] == blanks[: len(c) - n + 1]
                mixed = (h[ok] ^ (h[ok] >> np.uint32(15))) * np.uint32(0x9E3779B1)
                seen[mixed >> np.uint32(32 - self.bits)] = True
        return np.flatnonzero(seen)


def pack(found: np.ndarray, bits: int) -> bytes:
    """Buckets as a compressed row of bits."""
    seen = np.zeros(1 << bits, bool)
    seen[found] = True
    return zlib.compress(np.packbits(seen).tobytes(), 1)


def unpack(bag: bytes, bits: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bag), np.uint8), count=1 << bits))


def train(found: list[np.ndarray], labels: list[int], rate: float, bits: int = BITS, dim: int = DIM, steps: int = STEPS, seed: int = 5, least: int = LEAST) -> tuple[np.ndarray, float]:
    """(weight per bucket, bias): the model of texts with the buckets *found*, folded to one logit."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        return np.zeros(1 << bits, np.float32), float(np.log(rate / (1 - rate)))
    # Rarer n-grams have no embedding; the others are numbered, so a step costs what is learnt and not all buckets.
    used = np.flatnonzero(np.bincount(np.concatenate(found), minlength=1 << bits) >= least)
    place = np.full(1 << bits, -1)
    place[used] = np.arange(len(used))
    bags = [(place[b][place[b] >= 0], np.float32(1 / max(1, len(b)))) for b in found]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << bits, dim))[used].astype(np.float32)
    out = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    gain = np.float32(100)  # a few words in hundreds decide; scales the mean
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, out, bias)]
    step, batch = 0, 64
    shares = np.zeros((batch, len(used)), np.float32)  # what share each n-gram has in a text's mean, for the texts of a step
    weigh = (len(y) / 2 / np.bincount(y, minlength=2)) ** POWER  # the rarer kind counts more
    while step < steps:
        order = rng.permutation(len(bags))
        rate_now = 0.02 * max(0.0, 1 - step / steps) + 0.002
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            mixed = shares[: len(own)]
            for row, k in enumerate(own):
                mixed[row, bags[k][0]] = bags[k][1] * gain
            mean = mixed @ emb
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p *= weigh[y[own]][:, None] / len(own)
            back = p @ out.T
            grad_emb = mixed.T @ back.astype(np.float32)
            for row, k in enumerate(own):
                mixed[row, bags[k][0]] = 0
            grads = (grad_emb + L2 * emb, mean.T @ p, p.sum(0))
            step += 1
            for value, g, (m, v) in zip((emb, out, bias), grads, state, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                value -= (rate_now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    weight = np.zeros(1 << bits, np.float32)
    weight[used] = gain * (emb @ (out[:, 1] - out[:, 0]))
    return weight, float(bias[1] - bias[0])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Train on at most *per_class* labelled rows of each kind, in the order of a hash of doc_id."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter("toxic IN (0, 1)")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = None
    for kind in (0, 1):
        some = known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = some if ids is None else ids.unionAll(some)
    # The sample's ids: at most 2 * per_class rows.
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(bits)
        for batch in batches:
            bags = [pack(grams.of(t.as_py()), bits) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], names=["doc_id", "toxic", "bag"])

    bags = sample.filter("text IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, toxic int, bag binary")
    rows = sorted((r["doc_id"], r["toxic"], bytes(r["bag"])) for r in bags.collect())
    total = sum(n.values())
    return train([unpack(r[2], bits) for r in rows], [r[1] for r in rows], n.get(1, 0) / total if total else 0.5, bits)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """*docs* (doc_id, text) with held_out, score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = sent.value
        grams = Grams(int(len(weight)).bit_length() - 1)
        for batch in batches:
            logits = np.full(batch.num_rows, bias)
            for i, text in enumerate(batch.column(2)):
                found = grams.of(text.as_py())
                if len(found):
                    logits[i] += weight[found].mean(dtype=np.float64)
            p = 1 / (1 + np.exp(-np.clip(logits, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels.select("doc_id", "toxic")))
