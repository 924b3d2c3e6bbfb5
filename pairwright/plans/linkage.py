"""Queries over record linkage and reports, on inputs derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.operators import linkage, report
from pairwright.sources.tables import table


def _documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return d.filter("id % 2 = 0"), d.filter("id % 2 = 1")


_DOCS = "WITH l AS (SELECT doc_id AS id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id AS id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1)"


def pair_uid(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), F.md5(F.col("text").cast("binary")).alias("hash"))
    return linkage.pair_uid(d, d.withColumn("hash", F.when(F.col("uid") % 3 != 0, F.col("hash"))))


def pair_content_mutual(spark, sf_dir):
    return linkage.content_match(*_documents(spark, sf_dir)).filter("l IS NOT NULL").select("l", "r", "hash")


def candidate_counts(spark, sf_dir):
    return linkage.content_candidates(*_documents(spark, sf_dir))


def _parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = p.select(
        k.alias("id"),
        F.when(k % 6 != 0, F.concat("p_name", F.lit("/"), F.expr("p_partkey div 500"))).alias("name"),
        F.when(k % 5 != 0, F.array(F.concat("p_brand", F.lit("/"), F.expr("p_partkey div 100")))).otherwise(F.expr("cast(array() as array<string>)")).alias("tokens"),
        F.col("p_type").alias("org"),
    )
    return rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")


_PARTS = """
WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 <> 0 THEN p_name || '/' || (p_partkey // 500) END AS name,
                  CASE WHEN p_partkey % 5 <> 0 THEN p_brand || '/' || (p_partkey // 100) END AS tok, p_type AS org FROM part),
     l AS (SELECT * FROM p WHERE id % 2 = 0), r AS (SELECT * FROM p WHERE id % 2 = 1),
     ident AS (SELECT l.id AS l, r.id AS r FROM l JOIN r ON l.name = r.name AND (l.tok = r.tok OR (l.tok IS NULL AND r.tok IS NULL AND l.org = r.org))),
     named AS (SELECT l.id AS l, r.id AS r FROM l JOIN r ON l.name = r.name AND l.tok = r.tok)
"""


def pair_identity_mutual(spark, sf_dir):
    return linkage.identity_match(*_parts(spark, sf_dir))


def may_be_same(spark, sf_dir):
    return linkage.may_be_same(*_parts(spark, sf_dir))


def token_overlap(spark, sf_dir):
    """Even and odd orders by the parts they hold, many of them shared."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.array(F.concat(F.lit("p"), F.expr("l_partkey % 1000"))).alias("tokens"))
    return linkage.overlap(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"))


def wide_overlap(spark, sf_dir):
    """Even and odd orders by parts, days and suppliers of parts, of few holders, and by groups of suppliers of returned lines,
    which hundreds share."""
    line = table(spark, sf_dir, "lineitem")
    mode = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("m:"), F.expr("l_suppkey % 7")))
    named = [F.concat(F.lit("p:"), "l_partkey"), F.concat(F.lit("d:"), "l_partkey", F.lit("/"), F.col("l_shipdate").cast("date").cast("string")), F.concat(F.lit("s:"), "l_partkey", F.lit("/"), "l_suppkey"), mode]
    rows = line.select(F.col("l_orderkey").alias("id"), F.array_compact(F.array(*named)).alias("tokens"))
    return linkage.overlap(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"))


def _refused(spark, sf_dir):
    """Content candidates for the even parts: those whose type is shared by few odd ones stand in."""
    left, right = _parts(spark, sf_dir)
    key = lambda df: df.select("id", F.concat("org", F.lit("/"), F.expr("id div 20")).alias("hash"))
    return linkage.content_candidates(key(left), key(right))


_REFUSED = """, cl AS (SELECT id, org || '/' || (id // 20) AS h FROM l), cr AS (SELECT id, org || '/' || (id // 20) AS h FROM r),
     cn AS (SELECT h, (SELECT count(*) FROM cl x WHERE x.h = y.h) AS nl, (SELECT count(*) FROM cr x WHERE x.h = y.h) AS nr FROM (SELECT DISTINCT h FROM cl) y),
     cand AS (SELECT cl.id, CASE WHEN nr = 1 THEN nl ELSE nr END AS c FROM cl JOIN cn USING (h) WHERE nr > 0)
"""


def settle_outcomes(spark, sf_dir):
    left, right = _parts(spark, sf_dir)
    known = right.filter("id % 4 = 1")
    return linkage.settle(left, right, known, _refused(spark, sf_dir))


def same_cycle_duplicates(spark, sf_dir):
    return linkage.same_cycle_duplicates(_parts(spark, sf_dir)[0])


def synced_duplicates(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.col("s_suppkey").alias("idx"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("name"), F.array(F.concat(F.lit("n"), "s_nationkey")).alias("tokens"))
    return linkage.synced_duplicates(rows)


def _groups(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("members"))


def unmapped_members(spark, sf_dir):
    known = table(spark, sf_dir, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("uid"))
    return report.unmapped_members(_groups(spark, sf_dir), known)


def relink_groups(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    fresh = p.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("old_uid"), (F.col("p_partkey") + 1).alias("uid"))
    old = p.filter("p_partkey % 30 = 0").select(F.col("p_partkey").alias("old_uid"), (F.col("p_partkey") + 2).alias("uid"))
    return report.relink_groups(_groups(spark, sf_dir), report.relink_aliases(fresh, old))


def relink_aliases(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    half = lambda m, d: p.filter(f"p_partkey % {m} = 0").select(F.col("p_partkey").alias("old_uid"), (F.col("p_partkey") + d).alias("uid"))
    return report.relink_aliases(half(2, 1), half(3, 2))


QUERIES = {
    f.__name__: f
    for f in (
        pair_uid, pair_content_mutual, candidate_counts, pair_identity_mutual, may_be_same, token_overlap, wide_overlap, settle_outcomes, same_cycle_duplicates, synced_duplicates, unmapped_members, relink_groups, relink_aliases,
    )
}

ORACLE = {
    "pair_uid": "SELECT doc_id AS uid, CASE WHEN doc_id % 3 <> 0 THEN 'adopt' ELSE 'conflict' END AS op FROM documents",
    "pair_content_mutual": f"""{_DOCS}
        SELECT l.id AS l, r.id AS r, h AS hash FROM l JOIN r USING (h) WHERE (SELECT count(*) FROM l x WHERE x.h = l.h) = 1 AND (SELECT count(*) FROM r x WHERE x.h = r.h) = 1""",
    "candidate_counts": f"""{_DOCS}, n AS (SELECT h, count(*) AS nr FROM r GROUP BY h), m AS (SELECT h, count(*) AS nl FROM l GROUP BY h)
        SELECT l.id, CASE WHEN nr = 1 THEN nl ELSE nr END AS candidates FROM l JOIN n USING (h) JOIN m USING (h)""",
    "pair_identity_mutual": f"""{_PARTS}
        SELECT l AS id, max(n_l) AS n, min(r) AS first, max(n_l) = 1 AND max(n_r) = 1 AS accepted
        FROM (SELECT *, count(*) OVER (PARTITION BY l) AS n_l, count(*) OVER (PARTITION BY r) AS n_r FROM ident) GROUP BY l""",
    "token_overlap": """
        WITH t AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 1000 AS tok FROM lineitem)
        SELECT a.id, count(DISTINCT b.id) AS n, min(b.id) AS first FROM t a JOIN t b USING (tok) WHERE a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY a.id""",
    "wide_overlap": """
        WITH x AS (SELECT l_orderkey AS id, unnest(['p:' || l_partkey, 'd:' || l_partkey || '/' || l_shipdate::DATE, 's:' || l_partkey || '/' || l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'm:' || (l_suppkey % 7) END]) AS tok FROM lineitem),
             t AS (SELECT DISTINCT id, tok FROM x WHERE tok IS NOT NULL)
        SELECT a.id, count(DISTINCT b.id) AS n, min(b.id) AS first FROM t a JOIN t b USING (tok) WHERE a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY a.id""",
    "may_be_same": f"""{_PARTS}
        SELECT l.id, count(*) AS n, min(r.id) AS first FROM l JOIN r ON l.name = r.name OR l.tok = r.tok OR (l.tok IS NULL AND r.tok IS NULL AND l.org = r.org) GROUP BY 1""",
    "settle_outcomes": f"""{_PARTS}{_REFUSED}, twin AS (SELECT l.id AS l, r.id AS r FROM l JOIN r ON l.name IS NULL AND r.name IS NULL AND l.tok = r.tok),
        pairs AS (SELECT 'twin' AS k, * FROM twin UNION ALL SELECT 'alike', * FROM ident),
        counted AS (SELECT *, count(*) OVER (PARTITION BY k, l) AS nl, count(*) OVER (PARTITION BY k, r) AS nr FROM pairs),
        num AS (SELECT k, l, CASE WHEN max(nl) = 1 THEN max(nr) ELSE max(nl) END AS n FROM counted GROUP BY k, l),
        dupe AS (SELECT l.id AS l, count(*) AS n FROM l JOIN r ON r.id % 4 = 1 AND r.tok = l.tok WHERE l.name IS NULL GROUP BY 1)
        SELECT l.id, CASE WHEN c.c IS NOT NULL OR l.name IS NULL AND t.n IS NOT NULL THEN 'ambiguous' WHEN l.name IS NULL AND d.n IS NOT NULL THEN 'likely_duplicate'
                          WHEN l.name IS NULL OR l.name NOT IN (SELECT name FROM r WHERE name IS NOT NULL) THEN 'create' ELSE 'ambiguous' END AS outcome,
               CASE WHEN c.c IS NOT NULL THEN c.c WHEN l.name IS NULL THEN coalesce(t.n, d.n, 0) WHEN l.name NOT IN (SELECT name FROM r WHERE name IS NOT NULL) THEN 0 ELSE coalesce(a.n, 0) END::BIGINT AS candidates
        FROM l LEFT JOIN cand c ON c.id = l.id LEFT JOIN num t ON t.k = 'twin' AND t.l = l.id LEFT JOIN num a ON a.k = 'alike' AND a.l = l.id LEFT JOIN dupe d ON d.l = l.id""",
    "same_cycle_duplicates": f"{_PARTS} SELECT a.id, count(DISTINCT b.id) AS candidates FROM l a JOIN l b ON a.tok = b.tok WHERE a.name IS NULL AND b.name IS NOT NULL GROUP BY 1",
    "synced_duplicates": """
        WITH s AS (SELECT s_suppkey AS i, s_nationkey AS t, s_suppkey % 3 <> 0 AS bare FROM supplier),
             b AS (SELECT a.i, min(c.i) AS j FROM s a JOIN s c ON a.t = c.t AND a.i <> c.i WHERE a.bare GROUP BY a.i)
        SELECT b.i AS idx, b.j AS other FROM b LEFT JOIN b k ON k.i = b.j WHERE NOT (b.j < b.i AND k.j IS NOT DISTINCT FROM b.i)""",
    "unmapped_members": """
        SELECT l_orderkey AS id, count(DISTINCT l_partkey) AS unmapped FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) GROUP BY 1""",
    "relink_groups": """
        SELECT l_orderkey AS id, count(*) FILTER (WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 50 = 0 OR p_partkey % 30 = 0)) AS relinked FROM lineitem GROUP BY 1""",
    "relink_aliases": "SELECT p_partkey AS old_uid, CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 1 ELSE p_partkey + 2 END AS uid FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0",
}
