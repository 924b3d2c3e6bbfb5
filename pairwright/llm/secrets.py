"""Secret scans with an incremental blob ledger (DataFrame functions only).

Every version of a file is addressed by the SHA-256 of its content. A commit scans only the pairs (blob, rule version)
that the ledger lacks; what it scanned and what it found are folders that a manifest then lists, so a commit that fails
counts nowhere and one that repeats finds nothing left to scan. Findings are joined back to all rows that hold the
blob. Spans are code points, end exclusive: with the text split at a rule's matches, a match starts after the
lengths of all earlier pieces and matches.

Only hashes are shuffled for all rows: which blobs are new is decided on them, and of the new contents only those that
can hold a finding at all are moved, each once.

Defined cases: a null text is the empty blob; equal texts share one scan and get equal findings; a text may have
any number of matches and any length; extra columns are ignored; an empty table gives no rows; a batch committed twice
changes nothing; two writers that commit at once: the second is refused (Moved) and may try again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.llm.common import cut, shared_dir
from pairwright.operators.manifests import Manifests

RULE_VERSION = "2025-1"
#: Kinds in order: (name, pattern, group that is measured, least length). The first three are the base; all fixed values.
RULES = (
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "(AKIA)([A-Z0-9]+)", 0, 18),
    ("hex", "()([0-9a-f]+)", 0, 16),
    ("pem", "(-----BEGIN )([A-Z ]*PRIVATE KEY)-----", 0, 1),
    ("jwt", "(eyJ)([A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]+)", 0, 1),
    ("forge", "(gh[pousr]_)([A-Za-z0-9]{36,})", 0, 1),
)
BASE = ("assign", "access", "hex")
#: What a text must hold for a rule to have a match that is long enough; the same runs are found, read faster.
QUICK = {
    "assign": RULES[0][1][:-1].replace("=-]+", "=-]{12,}") + ")",
    "access": "AKIA[A-Z0-9]{14}",
    "hex": "[0-9a-f]{16}",
    "pem": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": RULES[4][1],
    "forge": "gh[pousr]_[A-Za-z0-9]{36}",
}


def blobs(docs: DataFrame, text: str = "text") -> DataFrame:
    """*docs* with ``blob``, the content's SHA-256, and ``content``."""
    return docs.withColumn("content", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("blob", F.sha2(F.col("content").cast("binary"), 256))


def find(contents: DataFrame) -> DataFrame:
    """(blob, kind, start, end) of all findings in rows (blob, content), one row per distinct blob."""
    per_rule = []
    for n, (kind, pattern, group, least) in enumerate(RULES):
        hit = F.struct(
            F.lit(n).alias("rule"),
            F.lit(least).alias("least"),
            F.split("content", pattern).alias("pieces"),
            F.regexp_extract_all("content", F.lit(pattern), F.lit(0)).alias("matches"),
            F.regexp_extract_all("content", F.lit(pattern), F.lit(group)).alias("values"),
        )
        per_rule.append(F.when(F.col("content").rlike(QUICK[kind]), hit))
    rules = contents.select("blob", F.explode(F.array(*per_rule)).alias("r")).filter("r IS NOT NULL")
    lens = F.expr("transform(r.matches, (x, i) -> named_struct('i', i, 'gap', length(get(r.pieces, i)), 'len', length(x), 'value', length(get(r.values, i))))")
    each = rules.select("blob", "r.rule", "r.least", F.explode(lens).alias("m"))
    upto = F.sum(F.col("m.gap") + F.col("m.len")).over(W.partitionBy("blob", "rule").orderBy("m.i").rowsBetween(W.unboundedPreceding, 0))
    each = each.withColumn("end", upto).filter("m.value >= least")
    kind = F.element_at(F.array(*[F.lit(r[0]) for r in RULES]), F.col("rule") + 1)
    return each.select("blob", "rule", kind.alias("kind"), (F.col("end") - F.col("m.len")).alias("start"), "end")


def unseen(contents: DataFrame, scanned: DataFrame | None, version: str = RULE_VERSION) -> DataFrame:
    """Distinct blobs of *contents* that *scanned* (blob, rule_version) doesn't have under *version*."""
    fresh = contents.select("blob").distinct()
    if scanned is None:
        return fresh
    return fresh.join(scanned.filter(F.col("rule_version") == version).select("blob"), "blob", "left_anti")


def can_match() -> Column:
    """Whether some rule can have a match in ``content``."""
    able = F.lit(False)
    for pattern in QUICK.values():
        able = able | F.col("content").rlike(pattern)
    return able


def suspects(contents: DataFrame) -> DataFrame:
    """One row (blob, content) per distinct content in which some rule can have a match."""
    return contents.select("blob", "content").filter(can_match()).dropDuplicates(["blob"])


def addressed(docs: DataFrame) -> DataFrame:
    """(doc_id, blob, content) of *docs*, written once: every text is hashed and looked through a single time, and
    content is kept where some rule can have a match only."""
    return cut(blobs(docs).select("doc_id", "blob", F.when(can_match(), F.col("content")).alias("content")))


class BlobLedger:
    """Scanned blobs and findings by rule version, in parquet folders that a manifest lists."""

    SCANNED = "blob string, rule_version string"
    FINDINGS = "blob string, rule int, kind string, start long, end long, rule_version string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.manifests = spark, Manifests(spark, path)

    def _read(self, name: str, schema: str) -> DataFrame:
        folders = (self.manifests.read() or {}).get(name, [])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", self.SCANNED)

    def findings(self, version: str = RULE_VERSION) -> DataFrame:
        return self._read("findings", self.FINDINGS).filter(F.col("rule_version") == version).drop("rule_version")

    def commit(self, docs: DataFrame, version: str = RULE_VERSION) -> None:
        """Scan what is unseen in *docs*, texts (text) or ``addressed`` rows (blob, content)."""
        number = self.manifests.number()
        held = (self.manifests.read(number) if number else None) or {"scanned": [], "findings": []}
        contents = (blobs(docs) if "text" in docs.columns else docs).select("blob", "content")
        v = F.lit(version).alias("rule_version")
        seen, found = self.manifests.new_folder("scanned"), self.manifests.new_folder("findings")
        unseen(contents, self.scanned() if number else None, version).select("blob", v).write.parquet(seen)
        if held["scanned"]:  # a first commit finds every blob new
            new = self.spark.read.schema(self.SCANNED).parquet(seen)
            contents = contents.join(new.select("blob"), "blob", "left_semi")
        find(cut(suspects(contents))).select("blob", "rule", "kind", F.col("start").cast("long"), F.col("end").cast("long"), v).write.parquet(found)
        self.manifests.commit({"scanned": [*held["scanned"], seen], "findings": [*held["findings"], found]}, number)


def report(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per row of *docs* (doc_id, blob): counts of the base kinds, their digest, and all spans."""
    span = F.struct(F.col("start"), F.col("rule"), F.concat_ws(":", "kind", "start", "end").alias("text"))
    base = F.col("kind").isin(*BASE)
    per = findings.groupBy("blob").agg(
        *[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n_{k}") for k in BASE],
        F.array_sort(F.collect_list(F.when(base, span))).alias("base"),
        F.array_sort(F.collect_list(span)).alias("all"),
    )
    # Written apart, so that the join deals its rows anew and can split those of a very common blob.
    per = cut(per.select("blob", *[f"n_{k}" for k in BASE], F.array_join("base.text", ",").alias("base"), F.array_join("all.text", ",").alias("spans")))
    out = docs.select("doc_id", "blob").join(per, "blob", "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """``report`` over *docs* (doc_id, text) without a ledger."""
    held = blobs(docs)
    return report(held, find(suspects(held)))


def query(spark, sf_dir: str) -> DataFrame:
    """Findings of all documents through a ledger: first the documents of one half of all contents are committed, as an
    earlier crawl, then all documents, of which only the other half is scanned then."""
    import uuid

    held = addressed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    ledger = BlobLedger(spark, f"{shared_dir(spark).rstrip('/')}/pairwright-blobs-{uuid.uuid4().hex}")
    ledger.commit(held.filter(F.substring("blob", 1, 1) < "8"))
    ledger.commit(held)
    return report(held, ledger.findings())


def _oracle() -> str:
    parts = []
    for n, (kind, pattern, group, least) in enumerate(RULES):
        sql = pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {n} AS rule, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{sql}', 0) AS ms, regexp_extract_all(t, '{sql}', {group}) AS vs, "
            f"regexp_split_to_array(t, '{sql}') AS ps FROM d"
        )
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), r AS (
  {" UNION ALL ".join(parts)}
), e AS (
  SELECT rid, rule, kind, least, i, length(ms[i]) AS n, length(vs[i]) AS v, length(ps[i]) AS g FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM r)
), s AS (
  SELECT *, (sum(n + g) OVER (PARTITION BY rid, rule ORDER BY i))::BIGINT AS hi FROM e
), f AS (
  SELECT rid, rule, kind, hi - n AS lo, kind || ':' || (hi - n) || ':' || hi AS span FROM s WHERE v >= least
), a AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY lo, rule) FILTER (rule < 3) AS base, string_agg(span, ',' ORDER BY lo, rule) AS spans FROM f GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""


ORACLE = _oracle()
