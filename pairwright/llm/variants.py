"""Grouping of spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters, an integer that only says which letters it has. Two words
that differ by one letter have keys that differ by that letter's power, or by the difference of two: taking a letter
away from the longer word, or one letter from each of two words as long, gives equal keys. So every word sends one
row per letter, its key less that letter's power, and keys are joined with keys. Anagrams share a key too; a second
integer, a hash of the remaining letters in their order, is part of the join, so that they never become rows, and every pair found
is then compared letter by letter. A group of equal keys and orders holds one word per letter of the alphabet and
place at most, whatever the table, and rows are integers, however long a word: its keys come from running sums.

Links are added up to a word's number of near words and its form, the most frequent near word, and forms are followed to
their last by doubling: frequencies double from form to form, so six rounds follow any chain of longs.

Defined cases: a null text has no words; a null doc_id counts as empty in the checksum; equal rows count each; ties between
near words go to the smallest in code-point order; words may have any length; texts are read whole; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import cut

#: Letters of a run once A-Z are lower case, the checksum's divisor, the least length and the least count.
RUN = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP, LENGTH, COUNT = 97, 5, 3
POWER = 5
#: An odd multiplier, so it has an inverse modulo 2**64.
TURN = 0x9E3779B97F4A7C15
#: Letters that a task hashes at a time.
LETTERS = 1 << 20


def word_counts(docs: DataFrame, length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """(word, n): the words of *docs* (doc_id, text) after slips, with their counts."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.col("doc_id").cast("string").alias("d"), F.explode(F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    h = F.crc32(F.concat(F.coalesce("d", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % SLIP == 0, less).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= count)


def _hashed(words: list[str]) -> tuple[np.ndarray, ...]:
    """Per letter of all *words*: which word, place (-1: the word itself, after its letters), key, order, whether the letter begins a run of equal ones."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    lens = np.array([len(w) for w in words])
    starts = np.cumsum(lens) - lens
    owner = np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(codes)) - starts[owner]
    power = codes**POWER
    key = np.add.reduceat(power, starts)
    turns = np.multiply.accumulate(np.full(int(lens.max()), TURN, np.uint64))
    mixed = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    each = (mixed ^ (mixed >> np.uint64(31))) * turns[place]
    upto = np.cumsum(each, dtype=np.uint64)
    upto -= (upto[starts] - each[starts])[owner]
    ends = starts + lens - 1
    order = upto[ends]
    # Letters after the one taken away move back by one place.
    rest = upto - each + (order[owner] - upto) * np.uint64(pow(TURN, -1, 1 << 64))
    begins = np.ones(len(codes), bool)
    begins[1:] = codes[1:] != codes[:-1]
    begins[starts] = True
    whole = np.full(len(words), -1)
    return np.r_[owner, np.arange(len(words))], np.r_[place, whole], np.r_[key[owner] - power, key], np.r_[rest, order], np.r_[begins, whole > 0]


def keys(words: DataFrame) -> DataFrame:
    """(key, order, place, begins, id) of *words* (id, word): the word's own row has place -1, the others lack a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = np.array(batch.column(0)), batch.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS)))
                owner, place, key, order, begins = _hashed(texts[at:to])
                columns = [key.view(np.int64), order.view(np.int64), place.astype(np.int32), begins, ids[at:to][owner]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "order", "place", "begins", "id"])
                at = to

    return words.select("id", "word").mapInArrow(run, "key long, order long, place int, begins boolean, id long")


def links(words: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, word_a, n_a, word_b, n_b) of near words, each pair once, from *words* (id, word, n) and their ``keys``."""
    less = found.filter("place >= 0").select("key", "order", "place", F.col("id").alias("a"))
    other = less.withColumnRenamed("a", "b")
    exchanged = less.join(other, ["key", "order", "place"]).filter("a < b").select("a", "b", "place", F.lit(False).alias("removed"))
    shorter = found.filter("place < 0").select("key", "order", F.col("id").alias("b"))
    removed = found.filter("place >= 0 AND begins").select("key", "order", "place", F.col("id").alias("a")).join(shorter, ["key", "order"])
    pairs = exchanged.unionByName(removed.select("a", "b", "place", F.lit(True).alias("removed")))
    named = pairs.join(words.select(F.col("id").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a")), "a")
    named = named.join(words.select(F.col("id").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b")), "b")
    same = "left(word_a, place) = left(word_b, place) AND substring(word_a, place + 2) = substring(word_b, place + IF(removed, 1, 2)) AND length(word_a) = length(word_b) + IF(removed, 1, 0)"
    return named.filter(same).select("a", "b", "word_a", "n_a", "word_b", "n_b")


def followed(forms: DataFrame) -> DataFrame:
    """(id, up): the last form that *forms* (id, up), at most one per id and without circles, lead to."""
    state = cut(forms)
    while True:
        further = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
        # A frequent form is the next of many words: the left side is what Spark splits, the right has one row per id.
        state = cut(state.join(further, "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        if state.filter("moved").isEmpty():
            return state.select("id", "up")
        state = state.select("id", "up")


def group(docs: DataFrame, length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = cut(word_counts(docs, length, count).withColumn("id", F.monotonically_increasing_id()))
    pairs = links(words, cut(keys(words)))
    way = lambda x, y: F.struct(F.col(x).alias("id"), F.struct((-F.col(f"n_{y}")).alias("less"), F.col(f"word_{y}").alias("word"), F.col(y).alias("id")).alias("near"))
    near = pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("x")).groupBy("x.id").agg(F.count(F.lit(1)).alias("n_near"), F.min("x.near").alias("best"))
    near = cut(near)
    held = words.join(near, "id", "left").withColumn("up", F.expr("IF(-best.less >= 2 * n, best.id, NULL)"))
    held = cut(held.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.expr("IF(up IS NULL, NULL, best.word)").alias("form"), F.expr("IF(up IS NULL, NULL, -best.less)").alias("form_n"), "up"))
    last = followed(held.filter("up IS NOT NULL").select("id", "up"))
    roots = last.join(words.select(F.col("id").alias("up"), F.col("word").alias("root")), "up").select("id", "root")
    out = held.join(roots, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same by plain patterns: a word with each of its letters made a star, or left out.
ORACLE = f"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS d, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL
), bytes AS (
  SELECT run, k, flatten(list_transform(string_split(d || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END)) AS b FROM runs
), sums AS (
  SELECT run, k, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, tab
), slips AS (
  SELECT CASE WHEN h % {SLIP} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM sums
), w AS (
  SELECT word, sum(k)::BIGINT AS n FROM slips WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(k) >= {COUNT}
), p AS (
  SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS star, left(word, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)
), links AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM p a JOIN p b ON a.star = b.star AND a.word <> b.word
  UNION SELECT p.word, w.word, w.n FROM p JOIN w ON p.less = w.word
  UNION SELECT w.word, p.word, p.n FROM p JOIN w ON p.less = w.word
), near AS (
  SELECT word, count(*) AS n_near, min({{'less': -other_n, 'word': other}}) AS best FROM links GROUP BY word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.less >= 2 * n THEN best.word END AS form, CASE WHEN -best.less >= 2 * n THEN -best.less END AS form_n
  FROM w LEFT JOIN near USING (word)
), r AS (
  SELECT word, word AS at, form AS next FROM f
  UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.next = f.word
)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r USING (word) WHERE r.next IS NULL
"""
