"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ``window`` consecutive item words (a shorter item is one pattern). They are searched by
length: within one length m, a block is up to three consecutive words. The shift table holds how far the window may
move when it ends in a known block, m - block + 1 words for any other; a shift of 0 leads to the bucket of patterns
that end in that block, and the words themselves are compared.

The patterns travel to the tasks in groups of about ``group_chars`` characters of item text; a larger benchmark takes
one pass over the documents per group, so what is sent and held is bounded at every size. An item of more than
``SEGMENT`` words is cut into segments that overlap by a window, so none exceeds a group. A worker builds a group's
tables once and holds them as numpy arrays.

Defined cases: null and empty texts have no words and no hits; null item texts and items without words have no pattern;
an item without id is searched too, but is left out of the ids and their count;
the items of equal texts are all reported; an item id that repeats counts once; repeated documents are searched one
by one; a document is searched whole, however long. With an empty benchmark nothing is hit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm.common import cut

WINDOW = 10
#: Characters of item text in a group; a worker holds some 40 bytes for each (measured: README).
GROUP_CHARS = 2_000_000
#: Words of an item beyond which it is searched in segments.
SEGMENT = 20_000
#: Bytes that belong to words once A-Z are lower case: 0-9, a-z and all of non-ASCII; the others become blanks.
KEEP = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(KEEP).split() if text else []


class Searcher:
    """Shift tables and suffix buckets for a group of items (id or None, text)."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        self.ids: list[str | None] = []
        self.number: dict[bytes, int] = {}
        seqs: list[np.ndarray] = []
        for item, text in items:
            ws = split_words(text)
            if ws:
                number = self.number
                self.ids.append(item)
                seqs.append(np.fromiter((number.setdefault(w, len(number) + 1) for w in ws), np.int32, len(ws)))
        lens = np.array([min(window, len(s)) for s in seqs], np.int64)
        #: Per pattern length: the length, its block, per block its shift or, below 0, its bucket, where buckets begin,
        #: the patterns by bucket, and where the items of each begin.
        self.tables: list[tuple[int, int, dict[bytes, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for m in sorted(set(lens.tolist())):
            own = np.flatnonzero(lens == m)
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(seqs[k], m) for k in own])
            who = np.repeat(own, [len(seqs[k]) - m + 1 for k in own]).astype(np.int32)
            block = min(3, m)
            # Sorted by their last block, then by the rest: patterns of a bucket and equal ones are neighbours.
            order = np.lexsort([who, *rows[:, : m - block].T[::-1], *rows[:, m - block :].T[::-1]])
            rows, who = rows[order], who[order]
            first = np.append(np.flatnonzero(_changes(rows)), len(rows))  # a pattern's items lie in who[first[i] : first[i + 1]]
            patterns = np.ascontiguousarray(rows[first[:-1]])
            tails = patterns[:, m - block :]
            at = np.append(np.flatnonzero(_changes(tails)), len(tails))
            # A block may move the window by what is left to the end of the last pattern it can lie in.
            table: dict[bytes, int] = {}
            for end in range(block, m):
                table.update(dict.fromkeys(_blocks(np.concatenate([seqs[k][end - block : end][None] for k in own])), m - end))
            table.update((b, -1 - k) for k, b in enumerate(_blocks(tails[at[:-1]])))
            self.tables.append((m, block, table, at, patterns, first, who))

    def sequence(self, text: str | None) -> np.ndarray:
        """A text's words as numbers, 0 for any that no item has."""
        number = self.number
        ws = split_words(text)
        return np.fromiter((number.get(w, 0) for w in ws), np.int32, len(ws))

    def find(self, seq: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges of the occurrences, and the items they belong to."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        n, raw = len(seq), seq.tobytes()
        for m, block, table, at, patterns, first, who in self.tables:
            far = m - block + 1
            get = table.get
            i = m - 1
            while i < n:
                step = get(raw[4 * (i - block + 1) : 4 * (i + 1)], far)
                if step > 0:
                    i += step
                    continue
                lo, hi = at[-1 - step], at[-step]
                here = seq[i - m + 1 : i + 1]
                for p in (lo + np.flatnonzero((patterns[lo:hi] == here).all(axis=1))).tolist():
                    spans.append((i - m + 1, i + 1))
                    found.update(who[first[p] : first[p + 1]].tolist())
                i += 1
        return spans, found


def _changes(rows: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.ones(len(rows), bool)
    out[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return out


def _blocks(rows: np.ndarray) -> list[bytes]:
    """Rows of word numbers as byte strings, the keys of the tables."""
    raw, width = np.ascontiguousarray(rows).tobytes(), 4 * rows.shape[1]
    return [raw[k : k + width] for k in range(0, len(raw), width)]


_built: dict[str, Searcher] = {}


def searcher(name: str, items: list[tuple[str | None, str]], window: int) -> Searcher:
    """The tables of a group, built once per worker; of several groups a worker holds the last one."""
    if name not in _built:
        _built.clear()
        _built[name] = Searcher(items, window)
    return _built[name]


def segments(items: DataFrame, window: int, segment: int = SEGMENT) -> DataFrame:
    """(item_id, text) of items with words, long ones as segments of *segment* windows; together they have the same windows."""
    kept = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = kept.select("item_id", F.regexp_extract_all(lower, F.lit("([^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+)"), F.lit(1)).alias("ws")).filter("size(ws) > 0")
    starts = F.explode(F.expr(f"sequence(0, greatest(size(ws) - {window}, 0), {segment})"))
    return split.select("item_id", "ws", starts.alias("at")).select("item_id", F.array_join(F.slice("ws", F.col("at") + 1, F.lit(segment + window - 1)), " ").alias("text"))


def _groups(items: DataFrame, window: int, group_chars: int) -> tuple[int, DataFrame]:
    """The number of groups and the segments to deal out among them, each once."""
    held = cut(segments(items, window).distinct())
    size = held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    # Half-full on average, so that uneven hashing stays within the bound.
    return max(1, -(-2 * size // group_chars) if size > group_chars else 1), held


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, group_chars: int = GROUP_CHARS) -> DataFrame:
    """All columns of *docs* without ``text``, with n_words, spans (merged word ranges) and items (ids hit).

    One row per document and pattern group.
    """
    return _occurrences(docs, *_groups(items, window, group_chars), window)


def _occurrences(docs: DataFrame, n: int, items: DataFrame, window: int) -> DataFrame:
    others = [c for c in docs.columns if c != "text"]
    schema = docs.select(*[F.col(f"`{c}`") for c in others]).schema
    span = T.StructType().add("lo", T.IntegerType()).add("hi", T.IntegerType())
    schema = schema.add("n_words", "long").add("spans", T.ArrayType(span)).add("items", T.ArrayType(T.StringType()))
    out = None
    for g in range(n):
        one = docs.mapInArrow(_search(_send(items, g, n), others, window), schema)
        out = one if out is None else out.unionAll(one)
    return out


def _search(sent, others: list[str], window: int):
    name = uuid.uuid4().hex
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = searcher(name, sent.value, window)
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                seq = find.sequence(text.as_py())
                got, who = find.find(seq)
                counts.append(len(seq))
                spans.append([{"lo": a, "hi": b} for a, b in merged(got)])
                items.append(sorted({find.ids[k] for k in who} - {None}))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], names=[*others, "n_words", "spans", "items"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges as sorted, disjoint ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, group_chars: int = GROUP_CHARS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n, items = _groups(items, window, group_chars)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if n > 1:  # every group's pass must see the same row numbers
        docs = cut(docs.withColumn("row", F.monotonically_increasing_id()))
    got = _occurrences(docs, n, items, window)
    if n > 1:  # the groups' ranges of a document meet; touching ranges stay apart only in number, not in words
        got = got.groupBy("row", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        got = got.withColumn("spans", F.array_sort("spans"))
        got = got.withColumn(
            "n_hit",
            F.expr("aggregate(spans, named_struct('n', 0L, 'to', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.hi - greatest(x.lo, a.to)), 'to', greatest(a.to, x.hi)), a -> a.n)"),
        )
    else:
        got = got.withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, x) -> a + x.hi - x.lo)"))
    return got.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, group_chars: int = GROUP_CHARS) -> DataFrame:
    """The documents without a hit, with the columns they came with; one pass per pattern group."""
    n, items = _groups(items, window, group_chars)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    held = docs.select(row, F.col("text").cast("string").alias("text"))
    for g in range(n):
        held = held.mapInArrow(_drop_hit(_send(items, g, n), window), held.schema)
    return held.select("row.*")


def _send(items: DataFrame, g: int, n: int):
    part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g)
    return items.sparkSession.sparkContext.broadcast(sorted({(r["item_id"], r["text"]) for r in part.toLocalIterator()}, key=lambda x: (x[0] is None, x[0] or "", x[1])))


def _drop_hit(sent, window: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = searcher(name, sent.value, window)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([not find.find(find.sequence(t.as_py()))[0] for t in texts], pa.bool_()))

    return run


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return report(docs.select("doc_id", "text"), items.select("item_id", "text"))


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL
), p AS (
  SELECT DISTINCT item, least(10, len(ws)) AS m, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)
), g AS (
  SELECT rid, i, m, array_to_string(ws[i:i + m - 1], ' ') AS win
  FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(ws) >= m)
), h AS (
  SELECT rid, i, g.m, item FROM g JOIN p USING (win)
), x AS (
  SELECT rid, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS pos FROM (SELECT DISTINCT rid, i, m FROM h)) GROUP BY rid
), y AS (
  SELECT rid, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (rid) LEFT JOIN y USING (rid)
"""
