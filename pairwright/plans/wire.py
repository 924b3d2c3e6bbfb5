"""Queries over what goes to a server and what comes back from it, on inputs derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.functions import text as T
from pairwright.operators import failures, photos, report, sinks
from pairwright.sources import protocol
from pairwright.sources.tables import table


def request_bodies(spark, sf_dir):
    k = F.col("c_custkey")
    hrefs = F.array(F.concat(F.lit("/b/"), k, F.lit(".vcf")), F.concat(F.lit("/b/<"), "c_name", F.lit("&>.vcf")))
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", protocol.sync_body(F.when(k % 3 != 0, F.concat(F.lit("t'"), k))).alias("sync"), protocol.multiget_body(hrefs).alias("multiget"), F.lit(protocol.propfind_body("d:getetag")).alias("propfind"))


def photo_fetch(spark, sf_dir):
    k = F.col("o_orderkey")
    uri = F.element_at(F.array(*[F.lit(x) for x in ("https://a.pics.org/x", "https://pics.org/y", "http://pics.org/y", "https://u@pics.org/y", "https://notpics.org/y")]), (k % 5 + 1).cast("int"))
    status = F.when(k % 7 != 0, F.element_at(F.array(*[F.lit(x) for x in (200, 404, 412, 503, 500, 401)]), (k % 6 + 1).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", photos.download_error(uri, "pics.org", status, k % 8 * 2_000_000).alias("error"))


def etag_learned(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.when(k % 2 == 0, "left").otherwise("right").alias("side"), k.alias("href"))
    h = F.col("href")
    read = o.filter("href % 5 <> 0").select("side", "href", F.concat(F.lit("r"), h).alias("etag"))
    return sinks.learn_etags(o.withColumn("etag", F.when(h % 3 != 0, F.concat(F.lit("p"), h))), read)


def photo_landed(spark, sf_dir):
    v = F.col("uid")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"))
    writes = e.select("uid", F.when(v % 5 == 0, "right").otherwise("left").alias("side"), F.when(v % 4 == 0, "kept").otherwise("set").alias("change"), F.concat(F.lit("h"), v).alias("left_hash"), F.when(v % 4 == 0, "old").alias("left_uri"), (v % 9 == 0).alias("stripped"))
    read = e.filter("uid % 6 <> 0").select("uid", (v % 7 != 0).alias("found"), F.when(v % 3 == 1, "uri").when(v % 2 == 0, "inline").alias("kind"), F.when(v % 3 == 1, F.concat(F.lit("u"), v)).alias("uri"))
    return photos.landed(writes, read)


def skip_log(spark, sf_dir):
    k = F.col("c_custkey")
    return report.skip_lines(table(spark, sf_dir, "customer").select(F.when(k % 2 == 0, "left").otherwise("right").alias("side"), k.cast("string").alias("uid"), F.when(k % 3 == 0, "ambiguous").otherwise("likely_duplicate").alias("outcome"), (k % 4).alias("candidates")))


def rediscovery(spark, sf_dir):
    code = F.when(F.col("o_orderkey") % 9 != 0, (400 + F.col("o_orderkey") % 200).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", failures.needs_discovery(T.status_class(code, F.lit(False))).alias("discover"))


def _multiget(spark, sf_dir):
    """A call per customer for its orders, five to a request; answers spell hrefs in another way and fail in various ways."""
    k, n = F.col("o_orderkey"), F.col("n")
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").withColumn("n", place).withColumn("doc_id", F.col("o_custkey") * 1000 + F.expr("n div 5"))
    o = o.withColumn("ord", F.expr("n % 5"))
    requested = o.select("doc_id", "ord", F.concat(F.lit("/b/%41"), k, F.lit(".vcf")).alias("href"))
    status = lambda code: F.lit(f"<d:status>HTTP/1.1 {code} X</d:status>")
    etag, data = F.concat(F.lit("<d:getetag>e"), k, F.lit("</d:getetag>")), F.concat(F.lit("<c:address-data>N:"), k, F.lit("\nX&lt;</c:address-data>"))
    prop = lambda inner, code: F.concat(F.lit("<d:propstat><d:prop>"), inner, F.lit("</d:prop>"), status(code), F.lit("</d:propstat>"))
    parts = F.when(k % 7 == 0, status(404)).when(k % 101 == 0, status(503)).when(k % 103 == 0, status(403)).when(k % 13 == 0, F.concat(prop(etag, 200), prop(F.lit("<c:address-data/>"), 404))).otherwise(prop(F.concat(etag, data), 200))
    entry = F.concat(F.lit("<d:response><d:href>http://h/b/A"), k, F.lit(".vcf</d:href>"), parts, F.lit("</d:response>"))
    head = '<d:multistatus xmlns:d="DAV:" xmlns:c="urn:ietf:params:xml:ns:carddav"><d:response><d:href>/b/</d:href><d:status>HTTP/1.1 507 X</d:status></d:response>'
    docs = o.groupBy("o_custkey", "doc_id").agg(F.sort_array(F.collect_list(F.when(k % 11 != 0, F.struct("ord", entry.alias("x"))))).alias("xs"))  # five at most
    call, batch = F.col("o_custkey"), F.col("doc_id") % 1000
    body = F.concat(F.when((call % 19 == 0) & (batch == 0), "<!DOCTYPE x>").otherwise(""), F.lit(head), F.array_join(F.transform("xs", lambda x: x["x"]), ""), F.lit("</d:multistatus>"))
    payloads = docs.select("doc_id", call.alias("call"), F.when((call % 17 == 0) & (batch == 1), 500).otherwise(207).alias("status"), body.alias("body"))
    return protocol.multiget_rows(requested, payloads, "http://h/b/")


def multiget_calls(spark, sf_dir):
    return protocol.multiget_calls(_multiget(spark, sf_dir))


def multiget_cards(spark, sf_dir):
    return protocol.multiget_cards(_multiget(spark, sf_dir)).select("call", "doc_id", "ord", "href", "outcome", "etag", "body")


QUERIES = {f.__name__: f for f in (request_bodies, photo_fetch, etag_learned, photo_landed, skip_log, rediscovery, multiget_calls, multiget_cards)}

_NS = 'xmlns:d="DAV:" xmlns:c="urn:ietf:params:xml:ns:carddav"'
_MULTIGET = """
    WITH o AS (SELECT o_custkey AS call, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders),
    e AS (SELECT *, n // 5 AS b, call * 1000 + n // 5 AS doc_id, n % 5 AS ord FROM o),
    r AS (SELECT call, doc_id, ord, '/b/A' || k || '.vcf' AS href,
                 CASE WHEN call % 19 = 0 AND b = 0 AND NOT (call % 17 = 0 AND b = 1) THEN 'permanent' WHEN call % 17 = 0 AND b = 1 THEN 'transient' END AS whole,
                 CASE WHEN k % 11 = 0 OR k % 7 = 0 THEN 'missing' WHEN k % 101 = 0 THEN 'transient' WHEN k % 103 = 0 THEN 'permanent' WHEN k % 13 = 0 THEN 'missing' ELSE 'found' END AS one, k FROM e),
    c AS (SELECT call, arg_min(coalesce(whole, one), (doc_id, CASE WHEN whole IS NULL THEN ord ELSE -1 END)) FILTER (whole IS NOT NULL OR one IN ('transient', 'permanent')) AS error,
                 count(*) FILTER (one = 'found') AS f, count(*) FILTER (one = 'missing') AS m FROM r GROUP BY 1)
    """
ORACLE = {
    "multiget_calls": f"{_MULTIGET} SELECT call, error, CASE WHEN error IS NULL THEN f END AS found, CASE WHEN error IS NULL THEN m END AS missing FROM c",
    "multiget_cards": f"""{_MULTIGET} SELECT call, doc_id, ord::INTEGER AS ord, href, one AS outcome, CASE WHEN one = 'found' THEN 'e' || k END AS etag, CASE WHEN one = 'found' THEN 'N:' || k || chr(13) || chr(10) || 'X<' END AS body
        FROM r WHERE call IN (SELECT call FROM c WHERE error IS NULL)""",
    "request_bodies": f"""
        SELECT c_custkey, '<d:sync-collection {_NS}><d:sync-token>' || CASE WHEN c_custkey % 3 <> 0 THEN 't&apos;' || c_custkey ELSE '' END
               || '</d:sync-token><d:sync-level>1</d:sync-level><d:prop><d:getetag/></d:prop></d:sync-collection>' AS sync,
               '<c:addressbook-multiget {_NS}><d:prop><d:getetag/><c:address-data/></d:prop><d:href>/b/' || c_custkey || '.vcf</d:href><d:href>/b/&lt;' || c_name || '&amp;&gt;.vcf</d:href></c:addressbook-multiget>' AS multiget,
               '<d:propfind {_NS}><d:prop><d:getetag/></d:prop></d:propfind>' AS propfind FROM customer""",
    "photo_fetch": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 THEN 'permanent' WHEN o_orderkey % 7 = 0 THEN 'transient' WHEN o_orderkey % 6 = 0 THEN CASE WHEN o_orderkey % 8 * 2000000 > 10485760 THEN 'permanent' END
               ELSE CASE o_orderkey % 6 WHEN 3 THEN 'rate_limited' WHEN 4 THEN 'transient' WHEN 5 THEN 'unauthorized' ELSE 'permanent' END END AS error FROM orders""",
    "etag_learned": """
        SELECT *, CASE WHEN etag IS NULL THEN 'permanent' END AS error FROM (
          SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, o_orderkey AS href, CASE WHEN o_orderkey % 3 <> 0 THEN 'p' || o_orderkey WHEN o_orderkey % 5 <> 0 THEN 'r' || o_orderkey END AS etag FROM orders)""",
    "photo_landed": """
        SELECT uid, landed, CASE WHEN landed IS DISTINCT FROM 'dropped' THEN 'h' || uid END AS left_hash, CASE WHEN landed = 'uri' THEN 'u' || uid WHEN landed IS DISTINCT FROM 'dropped' AND uid % 4 = 0 THEN 'old' END AS left_uri,
               uid % 9 = 0 OR landed IS NOT DISTINCT FROM 'dropped' AS stripped, CASE WHEN landed = 'gone' THEN 'permanent' END AS error
        FROM (SELECT vec_id AS uid, CASE WHEN vec_id % 5 <> 0 AND vec_id % 4 <> 0 THEN
                CASE WHEN vec_id % 6 = 0 THEN 'inline' WHEN vec_id % 7 = 0 THEN 'gone' WHEN vec_id % 3 = 1 THEN 'uri' WHEN vec_id % 2 = 0 THEN 'inline' ELSE 'dropped' END END AS landed FROM embeddings)""",
    "skip_log": """
        SELECT side, uid, 'warn' AS level, 'skipped uid=' || uid || ' side=' || side || ' outcome=' || outcome || ' candidates=' || n AS line
        FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, c_custkey::VARCHAR AS uid, CASE WHEN c_custkey % 3 = 0 THEN 'ambiguous' ELSE 'likely_duplicate' END AS outcome, c_custkey % 4 AS n FROM customer)""",
    "rediscovery": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN true ELSE c NOT IN (401, 429, 503) END AS discover FROM (SELECT o_orderkey, 400 + o_orderkey % 200 AS c FROM orders)""",
}
