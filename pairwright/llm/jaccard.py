"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is the set of its five-word shingles (lower case; a shorter one is a single shingle). Documents with the
same set are one class and only one of them goes on. In every tree of the forest a document's label is the sequence of
``depth`` min hashes of its own; the labels' prefixes are the nodes of a trie. Candidates share a node.

Matching begins with whole labels, where nodes are small. Of the pairs that exact verification confirms, a histogram
of similarities is kept, and each bin's chance to meet at the present prefix length gives the recall: it is measured on
the data at hand. While the least similar bin that occurs falls short of ``target``, the prefix is shortened to the longest
one at which it doesn't, and only pairs that no longer prefix brought together are new: those from different children
of a node. Without any pair so far the bin at the threshold stands for the least. So corpora whose near copies are close
stop early, and others go on.

Shingle sets are compared exactly, inside the tasks: a node's members are dealt out in blocks and every pair of blocks
is a task of bounded size, which gives each member its number of links and one edge to its group in the block, never a
row per pair. A pair that meets in many trees counts in the first. Edges are then contracted to classes.

Defined cases: documents without words (null, empty, blank) have no shingles and no links, each is a class of its
own; equal rows (doc_id and text) are linked copies; ties can't occur, as the threshold is compared in whole numbers;
rows without doc_id are ordered first and give a null class_id where they come first; doc_id is a long or casts to one;
texts are read whole, however long; extra columns are kept by ``keep_one`` and ignored by ``join``; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import NO_ID, cut, partitions, row_key
from pairwright.llm.components import components

SHINGLE = 5
MIN_J = 0.8
TREES = 24
DEPTH = 8
TARGET_RECALL = 0.9995
BLOCK = 256


#: Keys of two longs that may be broadcast, some 64 MB at most.
FEW = 2_000_000
#: Bins of similarity between the threshold and 1.
BINS = 20


def meets(j: float, trees: int, depth: int) -> float:
    """The chance that two documents of similarity *j* share a prefix of *depth* min hashes in some tree."""
    return 1 - (1 - j**depth) ** trees


def shortened(j: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix, of *depth* at most, at which documents of similarity *j* meet with the target recall."""
    while depth > 1 and meets(j, trees, depth) < target:
        depth -= 1
    return depth


class WordHash(dict):
    """Words to 64-bit hashes, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str | None, known: WordHash, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    ws = text.lower().encode("utf-8", "surrogatepass").split() if text else []
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """(k1, k2, digest, labels): a digest of the shingle set and the labels of all trees, two bytes per min hash in the
    order of trees; null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        rng = np.random.default_rng(7)
        a = (rng.integers(0, 2**31, trees * depth, np.uint32) * 2 + 1)[:, None]
        b = rng.integers(0, 2**32, trees * depth, np.uint32)[:, None]
        for batch in batches:
            digests, labels = [], []
            for text in batch.column(2):
                s = shingles(text.as_py(), known)
                if not len(s):
                    digests.append(None)
                    labels.append(None)
                    continue
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                low = (s >> np.uint64(32)).astype(np.uint32)
                least = np.full(trees * depth, 2**32 - 1, np.uint32)
                for at in range(0, len(low), 4096):
                    np.minimum(least, (low[at : at + 4096] * a + b).min(axis=1), out=least)
                # The least values crowd near 0; mixed, their upper halves tell them apart.
                labels.append(((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(labels, pa.binary())], names=["k1", "k2", "digest", "labels"])

    held = docs.select(*row_key(), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(run, "k1 long, k2 long, digest binary, labels binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first *keys* columns, which the input is sorted by."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and any(c[0] != x for c, x in zip(cols, last, strict=True))
        at = 0
        for cut_at in np.flatnonzero(new):
            if cut_at > at:
                held.append(batch.slice(at, cut_at - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut_at
        held.append(batch.slice(at))
        last = [c[-1] for c in cols]
    if held:
        yield pa.Table.from_batches(held)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, each of *left* with each of *right*."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], np.int64)
    both = [*left, *right]
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    word, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[number] > 1
    owner, number = owner[shared], np.unique(number[shared], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.int64)
    width = 16_384
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(number, [at, at + width])
        m = np.zeros((len(both), width), np.float32)
        m[owner[lo:hi], number[lo:hi] - at] = 1
        out += (m[: len(left)] @ m[len(left) :].T).astype(np.int64)
    return out


def _prefixes(labels: list, trees: int, depth: int, length: int) -> np.ndarray:
    """The node of each document (rows) in each tree (columns) at a prefix length, as one number."""
    least = np.frombuffer(b"".join(labels), ">u2").reshape(len(labels), trees, depth)
    node = np.zeros((len(labels), trees), np.uint64)
    for i in range(length):
        node = (node ^ least[:, :, i].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        node ^= node >> np.uint64(32)
    return node


def _verify(min_j: float, trees: int, depth: int, length: int, longer: int | None):
    """Links inside each pair of blocks: per member its links and one edge; and the histogram of similarities, in rows
    with a negative vid. Pairs that share a *longer* prefix were found before."""
    num, den = int(round(min_j * 10_000)), 10_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]
        bins = np.zeros(BINS, np.int64)
        for t in _groups(batches, 4):
            one = np.unique(t.column("vid").to_numpy(), return_index=True)[1]  # equal rows come twice
            t = t.take(pa.array(one))
            tree, b1, b2 = t.column("tree")[0].as_py(), t.column("b1")[0].as_py(), t.column("b2")[0].as_py()
            vid, size, block = (t.column(c).to_numpy() for c in ("vid", "size", "b"))
            n = len(vid)
            if n < 2:
                continue
            labels = t.column("labels").to_pylist()
            keys = _prefixes(labels, trees, depth, length)
            before = None if longer is None else _prefixes(labels, trees, depth, longer)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles").combine_chunks()]
            left = np.flatnonzero(block == b1)
            right = left if b1 == b2 else np.flatnonzero(block == b2)
            common = _overlaps([sets[i] for i in left], [sets[i] for i in right])
            lens = np.array([len(s) for s in sets], np.int64)
            union = lens[left][:, None] + lens[right][None, :] - common
            x, y = np.nonzero(common * den >= num * union)
            share = common[x, y] / union[x, y]
            i, j = left[x], right[y]
            ok = i < j if b1 == b2 else np.ones(len(i), bool)
            i, j, share = i[ok], j[ok], share[ok]
            new = np.zeros(len(i), bool)
            for at in range(0, len(i), 65_536):  # a pair counts in the first tree where it meets
                part = slice(at, at + 65_536)
                new[part] = (keys[i[part]] == keys[j[part]]).argmax(axis=1) == tree
                if before is not None:
                    new[part] &= ~(before[i[part]] == before[j[part]]).any(axis=1)
            i, j, share = i[new], j[new], share[new]
            if not len(i):
                continue
            bins += np.bincount(np.clip(((share - min_j) / (1 - min_j) * BINS + 1e-9).astype(np.int64), 0, BINS - 1), minlength=BINS)
            links = np.bincount(i, size[j], n) + np.bincount(j, size[i], n)
            texts = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
            root = np.arange(n)
            while True:  # least member of the linked group, by rounds of minima
                was = root.copy()
                np.minimum.at(root, i, root[j])
                np.minimum.at(root, j, root[i])
                root = root[root]
                if (root == was).all():
                    break
            for k in np.flatnonzero(texts):
                for col, v in zip(out, (vid[k], vid[root[k]], links[k], texts[k]), strict=True):
                    col.append(int(v))
            if len(out[0]) > 10_000:
                yield _rows(out)
                out = [[], [], [], []]
        for k in np.flatnonzero(bins):
            for col, v in zip(out, (-1 - k, -1, bins[k], 0), strict=True):
                col.append(int(v))
        if out[0]:
            yield _rows(out)

    return run


def _rows(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["vid", "root", "links", "texts"])


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHash()
    for batch in batches:
        at = batch.schema.get_field_index("text")
        made = pa.array([shingles(t.as_py(), known).tobytes() for t in batch.column(at)], pa.binary())
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), made], names=[*names, "shingles"])


@dataclass
class Classes:
    sketches: DataFrame  # (k1, k2, digest) per row of the documents
    found: DataFrame  # per shingle set: vid, k1, k2, digest, size, links, texts, root, root_k1
    depth: int  # prefix length at which matching stopped
    recall: float  # share of the linked pairs of different sets that are found, as measured; 1 without any
    pairs: int  # linked pairs of different sets


def _level(docs: DataFrame, sets: DataFrame, min_j: float, trees: int, depth: int, length: int, longer: int | None, block: int) -> DataFrame:
    """What ``_verify`` finds among documents that share a prefix of *length* and none of *longer*."""
    width = 2 * depth
    paths = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substr("labels", t * width + 1, F.lit(width)))
    nodes = sets.select("vid", F.posexplode(paths).alias("tree", "path")).select("vid", "tree", F.substring("path", 1, 2 * length).alias("node"), F.substring("path", 1, 2 * (longer or length)).alias("child"))
    crowd = nodes.groupBy("tree", "node").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("vid")).alias("x"), F.bit_xor(F.xxhash64("vid", F.lit(1))).alias("y"), F.min("child").alias("c1"), F.max("child").alias("c2")
    )
    crowd = crowd.filter("n > 1" if longer is None else "n > 1 AND c1 <> c2")
    # Nodes with the same members hold the same pairs; the first tree's node stands for them.
    crowd = crowd.groupBy("n", "x", "y").agg(F.min(F.struct("tree", "node")).alias("at")).select("at.*", "n")
    members = cut(nodes.drop("child").join(crowd, ["tree", "node"]))
    per_doc = members.groupBy("vid").agg(F.collect_list(F.struct("tree", "node", "n")).alias("nodes"))  # at most one per tree
    wanted = cut(per_doc.join(sets.select("vid", "k1", "k2", "size", "labels"), "vid"))
    # The keys alone first: up to FEW of them are broadcast, so no other text moves; else both joins use one shuffle.
    keys = wanted.select("k1", "k2")
    texts = docs.select(*row_key(), F.col("text").cast("string").alias("text")).join(F.broadcast(keys) if wanted.count() <= FEW else keys, ["k1", "k2"], "left_semi")
    near = texts.join(wanted.hint("shuffle_hash"), ["k1", "k2"])
    near = near.select("vid", "size", "labels", "nodes", "text").mapInArrow(_with_shingles, "vid long, size long, labels binary, nodes array<struct<tree:int,node:binary,n:long>>, shingles binary")
    near = near.select("vid", "size", "labels", "shingles", F.explode("nodes").alias("at")).withColumn("blocks", F.expr(f"cast(ceil(at.n / {block}D) as int)"))
    near = near.withColumn("b", F.expr("cast(pmod(xxhash64(vid, 2), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    near = near.select("at.tree", F.xxhash64("at.node").alias("node"), F.least("b", "other").alias("b1"), F.greatest("b", "other").alias("b2"), "b", "vid", "size", "labels", "shingles")
    key = ["tree", "node", "b1", "b2"]
    near = near.repartition(partitions(docs.sparkSession), *key).sortWithinPartitions(*key, "vid")
    return cut(near.mapInArrow(_verify(min_j, trees, depth, length, longer), "vid long, root long, links long, texts long"))


def classes(docs: DataFrame, min_j: float = MIN_J, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL, block: int = BLOCK) -> Classes:
    """The linked classes of *docs*. Only the histogram of similarities, BINS numbers, reaches the driver."""
    n_parts = partitions(docs.sparkSession)
    sketches = cut(sketch(docs, trees, depth))
    sets = sketches.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("k1", "k2", "labels")).alias("rep"), F.count(F.lit(1)).alias("size"))
    sets = sets.select("digest", "rep.*", "size").repartitionByRange(n_parts, "k1", "k2").sortWithinPartitions("k1", "k2")
    sets = cut(sets.withColumn("vid", F.monotonically_increasing_id()))  # in the order of (k1, k2)

    found, longer, length = None, None, depth
    bins = [0] * BINS
    while True:
        new = _level(docs, sets, min_j, trees, depth, length, longer, block)
        found = new if found is None else found.unionByName(new)
        for r in new.filter("vid < 0").groupBy("vid").agg(F.sum("links").alias("n")).collect():
            bins[-1 - r["vid"]] += r["n"]
        edges = [min_j + (1 - min_j) * k / BINS for k in range(BINS)]
        least = next((j for j, n in zip(edges, bins, strict=True) if n), min_j)
        if length == 1 or meets(least, trees, length) >= target:
            break
        longer, length = length, shortened(least, trees, length - 1, target)
    pairs = sum(bins)
    recall = pairs / sum(n / meets(j, trees, length) for j, n in zip(edges, bins, strict=True)) if pairs else 1.0

    found = found.filter("vid >= 0")
    roots = components(found.select(F.col("vid").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("vid").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    out = sets.select("vid", "digest", "k1", "k2", "size").join(counts, "vid", "left").join(roots.withColumnRenamed("v", "vid"), "vid", "left")
    out = out.withColumns({"root": F.coalesce("root", "vid"), "links": F.coalesce("links", F.lit(0)), "texts": F.coalesce("texts", F.lit(0))})
    heads = sets.select(F.col("vid").alias("root"), F.col("k1").alias("root_k1"))
    return Classes(sketches.select("k1", "k2", "digest"), cut(out.join(heads, "root")), length, recall, pairs)


def join(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, class_id (least doc_id of its linked class), n_links (other documents with a similarity
    of the threshold or more), n_text_links (different shingle sets among them), n_copies (others with its set)."""
    got = classes(docs, **options)
    out = got.sketches.join(got.found.drop("k1", "k2"), "digest", "left")
    plain = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(
        plain("k1").alias("doc_id"),
        F.when(F.col("digest").isNull(), plain("k1")).otherwise(plain("root_k1")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_text_links"),
        F.coalesce(F.col("size") - 1, F.lit(0)).alias("n_copies"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without words, and the first (doc_id, text hash) of every linked class, of equal rows any one."""
    got = classes(docs, **options)
    first = got.found.filter("root = vid").select("k1", "k2")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    with_words = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike("[^ \\t-\\r]")
    held = docs.filter(with_words).select(row, *row_key()).join(first.hint("shuffle_hash"), ["k1", "k2"])
    # An aggregate combines equal rows before the shuffle, however many there are.
    one = held.groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return one.select("row.*").unionAll(docs.filter(~with_words))


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
