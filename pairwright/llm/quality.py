"""Quality rules as a bitmask ledger (DataFrame functions only).

``measured`` evaluates every rule once per document and gives the measurements with one integer of failure bits;
``Ledger`` stores them by content and rule version, so a text is measured once, whatever documents, batches or policies
follow. ``apply_policy`` is then one bitwise AND per document, so a new policy version needs no new look at the texts,
and ``ablate`` says by bitwise aggregation what each rule of a policy is worth.

Defined cases: a null or empty text has no words (it fails ``few_words``); lines and words are exact strings; texts are
measured whole, however long; repeated rows are judged one by one; extra columns pass through unless they carry a
measurement's name or start with ``_q_``, the names of what is computed here, which ``measure`` then replaces or leaves
out (``keep`` returns all of them). An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import SPACE_RE, shared_dir
from pairwright.operators.manifests import Manifests

#: Rules in bit order: name -> SQL condition of failure over the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "exclamations": "10 * n_bangs > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "repeated_lines": "10 * n_dup_lines > 5 * n_lines",
}
BASE = ("few_words", "repeated_windows")
#: Policy versions: the rules that reject. The base rules belong to each.
POLICIES: dict[str, tuple[str, ...]] = {
    "2024-base": BASE,
    "2025-web": (*BASE, "symbols", "exclamations", "word_length", "repeated_lines"),
}
CURRENT = "2025-web"
#: Changes whenever RULES or the measurements do.
RULE_VERSION = "2025-1"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs", "n_lines")


def mask(rules) -> int:
    """The bits of the named rules."""
    order = list(RULES)
    return sum(1 << order.index(r) for r in rules)


def measure(docs: DataFrame, text: str = "text", hash_bits: int = 64) -> DataFrame:
    """Add the measurements of MEASURES as long columns.

    ``n_repeat_words`` counts words in 3-word windows that occur twice or more in the text: each window becomes
    one long, its hash above its position, so sorting that array puts equal windows side by side; neighbours are
    compared word by word before they count. Where two different windows share a hash, that text's windows are sorted
    by their words instead, so the count is exact. *hash_bits* is for tests of that case.
    """
    clash = [c for c in docs.columns if c.startswith("_q_")]
    docs = docs.drop(*clash, *[c for c in MEASURES if c in docs.columns])
    blank = F.coalesce(F.col(text), F.lit(""))
    at = lambda x, n: f"get(_q_words, cast({x} & _q_low as int) + {n})"
    near = lambda j: f"coalesce(shiftrightunsigned(x ^ get(_q_sorted, {j}), _q_bits) = 0, false)"
    equal = lambda j: " AND ".join(f"{at('x', n)} = {at(f'get(_q_sorted, {j})', n)}" for n in range(3))
    hashed = "xxhash64(x, get(_q_words, i + 1), get(_q_words, i + 2))" + (f" & {2**hash_bits - 1}L" if hash_bits < 64 else "")
    windows = "slice(_q_words, 1, greatest(cast(n_words as int) - 2, 0))"
    exact = f"sort_array(transform({windows}, (x, i) -> named_struct('a', x, 'b', get(_q_words, i + 1), 'c', get(_q_words, i + 2), 'i', cast(i as bigint))))"
    same = lambda j: f"coalesce(x.a = get(_q_exact, {j}).a AND x.b = get(_q_exact, {j}).b AND x.c = get(_q_exact, {j}).c, false)"
    out = (
        docs.withColumns({"_q_words": F.array_remove(F.split(blank, SPACE_RE), ""), "_q_lines": F.filter(F.split(blank, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))})
        .withColumns({"n_words": F.size("_q_words").cast("long"), "_q_joined": F.array_join("_q_words", ""), "n_lines": F.size("_q_lines").cast("long")})
        .withColumns({"_q_bits": F.expr("IF(n_words < 16777216, 24, 31)")})
        .withColumns({"_q_low": F.expr("shiftleft(1L, _q_bits) - 1")})
        .withColumns(
            {
                "_q_sorted": F.expr(f"sort_array(transform({windows}, (x, i) -> shiftleft({hashed}, _q_bits) | cast(i as bigint)))"),
                "word_chars": F.length("_q_joined").cast("long"),
                "n_symbols": F.expr("cast(length(_q_joined) - length(regexp_replace(_q_joined, '[#*$%&|<>]', '')) as bigint)"),
                "n_bangs": F.expr("cast(length(_q_joined) - length(replace(_q_joined, '!', '')) as bigint)"),
                "n_dup_lines": F.expr("cast(size(_q_lines) - size(array_distinct(_q_lines)) as bigint)"),
            }
        )
        .withColumn("_q_pairs", F.expr(f"filter(_q_sorted, (x, i) -> {near('i - 1')} OR {near('i + 1')})"))
        .withColumn("_q_clash", F.expr(f"exists(transform(_q_sorted, (x, i) -> {near('i - 1')} AND NOT ({equal('i - 1')})), x -> x)"))
        .withColumn("_q_exact", F.expr(f"IF(_q_clash, {exact}, NULL)"))
        .withColumn("_q_twice", F.expr(f"transform(filter(_q_exact, (x, i) -> {same('i - 1')} OR {same('i + 1')}), x -> x.i)"))
        .withColumn("_q_at", F.expr("sort_array(IF(_q_clash, _q_twice, transform(_q_pairs, x -> x & _q_low)))"))
        .withColumn("n_repeat_words", F.expr("aggregate(transform(_q_at, (x, i) -> least(3L, x - get(_q_at, i - 1))), 0L, (a, x) -> a + x)"))
    )
    # A later filter on a measurement would be pushed below and repeat all of the above in its condition;
    # explode, here of one element, keeps it above.
    one = F.explode(F.array(F.struct(*MEASURES))).alias("_q")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], one).select(*[F.col(f"`{c}`") for c in docs.columns], "_q.*")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``: bit i is set where the i-th rule fails."""
    bits = " | ".join(f"IF({cond}, {1 << i}, 0)" for i, cond in enumerate(RULES.values()))
    return measure(docs.drop("fail_bits"), text).withColumn("fail_bits", F.expr(bits))


class Ledger:
    """Measurements and failure bits by content (SHA-256) and rule version, in parquet folders that a manifest lists.

    A commit evaluates the rules for contents that the ledger lacks only; copies within one batch are measured where they
    lie, as moving texts to find them would cost more. Policies and ablations read the stored bits. A commit that fails
    leaves nothing that counts; one that repeats adds nothing.
    """

    COLUMNS = ("content", *MEASURES, "fail_bits", "rule_version")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.manifests = spark, Manifests(spark, path)

    def read(self, version: str = RULE_VERSION) -> DataFrame | None:
        """The stored rows of a rule version; None before the first commit."""
        folders = (self.manifests.read() or {"folders": []})["folders"]
        return self.spark.read.parquet(*folders).filter(F.col("rule_version") == version).drop("rule_version") if folders else None

    def commit(self, docs: DataFrame, text: str = "text", version: str = RULE_VERSION) -> None:
        number = self.manifests.number()
        folders = (self.manifests.read(number) if number else {"folders": []})["folders"]
        known = self.read(version)
        fresh = docs.select(_content(text).alias("content"), F.col(f"`{text}`").cast("string").alias("text"))
        if known is not None:
            fresh = fresh.join(known.select("content"), "content", "left_anti")
        # Measured first, so that what is shuffled to drop copies is a few numbers each, not texts.
        rows = measured(fresh).drop("text").dropDuplicates(["content"]).withColumn("rule_version", F.lit(version))
        folder = self.manifests.new_folder("rules")
        rows.select(*self.COLUMNS).write.parquet(folder)
        self.manifests.commit({"folders": [*folders, folder]}, number)

    def judge(self, docs: DataFrame, policy: str = CURRENT, text: str = "text", version: str = RULE_VERSION) -> DataFrame:
        """*docs* (without *text*) with the stored measurements, bits and the policy's verdict; each content is committed."""
        others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, *MEASURES, "fail_bits", "base_failed", "kept")]
        held = docs.select(*others, _content(text).alias("_q_content"))
        return apply_policy(held.join(self.read(version), F.col("_q_content") == F.col("content")).drop("_q_content", "content"), policy)


def _content(text: str):
    return F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"), 256)


def apply_policy(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """Add ``base_failed`` and ``kept`` under a policy version; a base failure always rejects."""
    bits = mask(POLICIES[version]) | mask(BASE)
    return led.withColumns({"base_failed": F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0, "kept": F.col("fail_bits").bitwiseAND(F.lit(bits)) == 0})


def ablate(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail only it, and that the policy keeps without it."""
    bits = mask(POLICIES[version]) | mask(BASE)
    failed = F.col("fail_bits").bitwiseAND(F.lit(bits))
    counts = led.groupBy(failed.alias("failed")).agg(F.count(F.lit(1)).alias("n"))  # at most one row per bit pattern
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << i).alias("bit")) for i, name in enumerate(RULES) if bits >> i & 1]
    each = counts.select("failed", "n", F.explode(F.array(*rules)).alias("r"))
    hit = F.col("failed").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failing_alone"),
        F.sum(F.when(F.col("failed").isin(0) | (F.col("failed") == F.col("r.bit")), F.col("n")).otherwise(0)).alias("kept_without"),
    )


def keep(docs: DataFrame, version: str = CURRENT, text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with the columns they came with."""
    held = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("_row", F.col(f"`{text}`").alias("text"))
    return apply_policy(measured(held), version).filter("kept").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """Documents judged from a stored ledger. ``lone_rule`` names the one rule that rejects a document, which the policy
    would keep without it."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    led = Ledger(spark, f"{shared_dir(spark).rstrip('/')}/pairwright-rules-{uuid.uuid4().hex}")
    led.commit(docs)
    lone = F.coalesce(*[F.when(F.col("fail_bits") == 1 << i, F.lit(name)) for i, name in enumerate(RULES)])
    return led.judge(docs).select("doc_id", *MEASURES, "fail_bits", "base_failed", "kept", lone.alias("lone_rule"))


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS ls
  FROM d
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)
), r AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1
  ) GROUP BY rid
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(array_to_string(ws, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(array_to_string(ws, ''), '[^!]', '', 'g'))::BIGINT AS n_bangs, len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN r USING (rid)
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_bangs > n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 32 ELSE 0 END)::INTEGER AS fail_bits
  FROM m
)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept,
       CASE fail_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'exclamations' WHEN 16 THEN 'word_length' WHEN 32 THEN 'repeated_lines' END AS lone_rule FROM b
"""
