"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are additive. A batch of changes (insert, delete, revise) is counted
once per changed document and becomes signed deltas: what a document counted before is taken off, what it counts now
is added. Only those deltas touch the totals, so no old text is read again.

Batches are applied in the order of their numbers. A commit writes folders of its own and then a manifest that lists
them, so what a failed commit wrote counts nowhere; a number that is committed already is done and changes nothing, and
a smaller one that never was is refused, as later batches were counted without it. What a document counted before is
its state under the largest committed batch. ``compact`` rewrites the states and deltas of all batches as one folder
each; a commit does so by itself every ``compact_after`` batches, so it never reads a long history.

Defined cases: a null text has 0 tokens and still counts as a document; null source or language is a group of its
own; doc_id is a long or casts to one; a change without doc_id is keyed by its text; of several rows for one document in
a batch the last ``ord`` wins, then a delete, then the larger text hash; deleting an unknown document changes nothing,
inserting a known one revises it; an empty batch is committed and changes no total; texts are counted whole, however
long; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm.common import NO_ID, row_key, shared_dir, words
from pairwright.operators.manifests import Manifests

#: How the rank files' public vocabularies split text before merging; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of what PATTERN takes for white space that are counted by themselves.
_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")
#: Byte-level BPE ranks; a parameter of ``with_tokens``.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WORDS_VERSION, BPE_VERSION = "words/1", "byte-bpe-50k/1"
STATE = "batch long, k1 long, k2 long, source string, lang string, version string, docs long, tokens long"
DELTA = "batch long, source string, lang string, version string, docs long, tokens long"


def n_tokens(bpe, text: str) -> int:
    """How many tokens *text* has.

    The encoder's splitter can't take a very long run of white space. Such a run is one piece by PATTERN, less its last
    character where something follows it, as that may begin the next piece; it is counted by itself.
    """
    n, at = 0, 0
    for run in _BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        n += len(bpe.encode_ordinary(text[at : run.start()])) + len(bpe._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(bpe.encode_ordinary(text[at:]))


def with_tokens(rows: DataFrame, ranks: str | None = RANKS) -> DataFrame:
    """Add ``counts``, an array of (version, tokens): words, and BPE tokens where a rank file is given.

    The vocabulary (some 50,000 entries) is read on the driver and sent to the tasks.
    """
    if ranks is None:
        counted = F.array(F.struct(F.lit(WORDS_VERSION).alias("version"), F.size(words(F.col("text"))).cast("long").alias("tokens")))
        return rows.withColumn("counts", counted)
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sent = rows.sparkSession.sparkContext.broadcast(table)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=sent.value, special_tokens={})
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            tokens = [n_tokens(bpe, t.as_py() or "") for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64())], names=[*names, "n_bpe"])

    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("n_bpe", T.LongType())]))
    both = [F.struct(F.lit(v).alias("version"), c.alias("tokens")) for v, c in ((WORDS_VERSION, F.size(words(F.col("text"))).cast("long")), (BPE_VERSION, F.col("n_bpe")))]
    return out.withColumn("counts", F.array(*both)).drop("n_bpe")


class TokenRollup:
    """Document states and delta totals in parquet folders under *path*, as the newest manifest lists them."""

    def __init__(self, spark: SparkSession, path: str, ranks: str | None = RANKS, compact_after: int = 50) -> None:
        self.spark, self.ranks, self.compact_after = spark, ranks, compact_after
        self.manifests = Manifests(spark, path)

    def _now(self) -> tuple[int | None, dict]:
        number = self.manifests.number()
        return number, (self.manifests.read(number) if number else {"batches": [], "state": [], "deltas": []})

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str) -> str:
        folder = self.manifests.new_folder(name)
        rows.write.parquet(folder)
        return folder

    def commit(self, changes: DataFrame, batch: int) -> bool:
        """Apply *changes* (op, doc_id, text, source, lang and, if rows of a document compete, ord) as batch number
        *batch*; False if that number was committed before."""
        number, held = self._now()
        if batch in held["batches"]:
            return False
        if held["batches"] and batch < held["batches"][-1]:
            raise ValueError(f"batch {batch} comes after batch {held['batches'][-1]} was committed")
        order: Column = F.col("ord").cast("long") if "ord" in changes.columns else F.lit(0).cast("long")
        rows = changes.select(
            *row_key(), F.col("op"), F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), order.alias("ord")
        )
        rows = rows.withColumn("rank", F.struct("ord", (F.col("op") == "delete").alias("gone"), F.col("k2").alias("hash")))
        rows = rows.withColumn("k2", F.when(F.col("k1") == NO_ID, F.col("k2")).otherwise(F.lit(0).cast("long")))
        counted = with_tokens(rows.withColumn("text", F.when(F.col("op") != "delete", F.col("text"))), self.ranks).drop("text")
        last = counted.groupBy("k1", "k2").agg(F.max(F.struct("rank", "op", "source", "lang", "counts")).alias("x")).select("k1", "k2", "x.*")
        alive = (F.col("op") != "delete").cast("long")
        state = last.select("k1", "k2", "source", "lang", alive.alias("docs"), F.explode("counts").alias("c"))
        state = state.select(F.lit(batch).cast("long").alias("batch"), "k1", "k2", "source", "lang", "c.version", "docs", (F.col("c.tokens") * F.col("docs")).alias("tokens"))
        new = self._write(state, "state")
        now = self._read([new], STATE)
        signed = now.select("source", "lang", "version", "docs", "tokens")
        if held["state"]:
            was = self._read(held["state"], STATE).join(now.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
            was = was.groupBy("k1", "k2", "version").agg(F.max(F.struct("batch", "source", "lang", "docs", "tokens")).alias("x")).select("x.*", "version")
            signed = signed.unionByName(was.select("source", "lang", "version", (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        delta = signed.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")
        content = {"batches": [*held["batches"], batch], "state": [*held["state"], new], "deltas": [*held["deltas"], self._write(delta, "deltas")]}
        self.manifests.commit(content, number)
        if len(content["state"]) > self.compact_after:
            self.compact()
        return True

    def compact(self) -> None:
        """Rewrite the states (the last per document, none of deleted ones) and the deltas as one folder each."""
        number, held = self._now()
        last = self._read(held["state"], STATE).groupBy("k1", "k2", "version").agg(F.max(F.struct("batch", "source", "lang", "docs", "tokens")).alias("x"))
        state = last.select("k1", "k2", "version", "x.*").filter("docs > 0").select("batch", "k1", "k2", "source", "lang", "version", "docs", "tokens")
        content = {"batches": held["batches"], "state": [self._write(state, "state")], "deltas": [self._write(self.totals(), "deltas")]}
        self.manifests.commit(content, number)
        self.manifests.drop([*held["state"], *held["deltas"]])

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens over all committed batches."""
        _, held = self._now()
        sums = self._read(held["deltas"], DELTA).groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 OR tokens <> 0")


def query(spark, sf_dir: str) -> DataFrame:
    """Totals of all documents after four batches: all are inserted; the French ones are deleted; those come back, and the
    German ones are revised to another text, source and language; last, these are revised to what the table holds, in
    a batch that is committed twice. The end is the totals of the table as it is."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    rollup = TokenRollup(spark, f"{shared_dir(spark).rstrip('/')}/pairwright-counts-{uuid.uuid4().hex}")
    as_op = lambda rows, op: rows.withColumn("op", F.lit(op))
    known = docs.filter("doc_id IS NOT NULL")
    french, german = known.filter("lang = 'fr'"), known.filter("lang = 'de'")
    changed = german.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" revised")).alias("text"), F.col("lang").alias("source"), F.col("source").alias("lang"))
    rollup.commit(as_op(docs, "insert"), 1)
    rollup.commit(as_op(french, "delete"), 2)
    rollup.commit(as_op(french, "insert").unionByName(as_op(changed, "revise")), 3)
    for _ in range(2):
        rollup.commit(as_op(german, "revise"), 4)
    return rollup.totals()
