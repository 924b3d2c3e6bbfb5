"""Protocol payloads as data: multistatus answers, collections, hrefs and dumps.

There is no network here; a source reads recorded payloads, one document per row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote_to_bytes, urljoin, urlsplit
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pairwright.functions.shared import cut
from pairwright.functions.text import restore_crlf, status_class, xml_escape

_DAV, _CARD = "{DAV:}", "{urn:ietf:params:xml:ns:carddav}"
MULTISTATUS = "doc_id long, ord int, href string, status int, propstat_error int, etag string, address_data string, is_collection boolean, is_addressbook boolean, displayname string, sync_token string, error string"
_TOKEN, _RESPONSE, _HREF, _STATUS, _PROPSTAT, _PROP, _KINDS = (_DAV + x for x in ("sync-token", "response", "href", "status", "propstat", "prop", "resourcetype"))
_VALUES = {f"{_DAV}getetag": "etag", f"{_DAV}displayname": "displayname", f"{_CARD}address-data": "address_data"}
#: Characters a path segment keeps unescaped.
_SAFE = "!$&'()*+,;=:@-._~"
#: Hrefs that nothing has to be resolved in: a path from the root, after a host or not, of characters that stay or are escaped.
_PLAIN = re.compile(r"(?:https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?=/)|(?!//))((?:/(?!\.{1,2}(?:/|\Z))[A-Za-z0-9!$&'()*+,=:@._~%-]*)+)")
_ASCII = re.compile("%[0-7][0-9A-Fa-f]")
_ONE_SPELLING = {f"%{h}{d}": quote(chr(int(h + d, 16)), safe=_SAFE) for h in "01234567" for d in "0123456789ABCDEFabcdef"}


def _status(text: str | None) -> int | None:
    parts = (text or "").split()
    return int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else None


def parse_multistatus(body: str) -> list[dict]:
    """The responses of one answer. Names match by namespace; a DTD, another root or broken XML is one error row."""
    if "<!doctype" in body.lower():
        return [{"ord": 0, "error": "dtd"}]
    try:
        root = ET.fromstring(body)
    except ET.ParseError:
        return [{"ord": 0, "error": "malformed"}]
    if root.tag != f"{_DAV}multistatus":
        return [{"ord": 0, "error": "root"}]
    token = root.findtext(_TOKEN)
    rows = []
    for n, r in enumerate(root.findall(_RESPONSE)):
        row: dict = {"ord": n, "href": (r.findtext(_HREF) or "").strip(), "status": _status(r.findtext(_STATUS)), "sync_token": token, "is_collection": False, "is_addressbook": False}
        for ps in r.findall(_PROPSTAT):
            code = _status(ps.findtext(_STATUS))
            if code is not None and not 200 <= code < 300:
                row.setdefault("propstat_error", code)
                continue
            for prop in ps.findall(_PROP):
                own: dict = {}
                for x in prop:
                    if (name := _VALUES.get(x.tag)) is not None:
                        own.setdefault(name, x.text or "")
                    elif x.tag == _KINDS:
                        kinds = [k.tag for k in x]
                        row["is_collection"] |= f"{_DAV}collection" in kinds
                        row["is_addressbook"] |= f"{_CARD}addressbook" in kinds
                row |= own
        rows.append(row)
    return rows


def multistatus(payloads: DataFrame) -> DataFrame:
    """Rows of MULTISTATUS from payloads (doc_id, body); line ends of card data are restored."""
    schema = to_arrow_schema(payloads.sparkSession.createDataFrame([], MULTISTATUS).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, row) for d, body in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in parse_multistatus(body or "")]
            columns = [[d for d, _ in rows], *([row.get(name) for _, row in rows] for name in schema.names[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    out = payloads.select("doc_id", "body").mapInArrow(run, MULTISTATUS)
    return out.withColumn("address_data", restore_crlf(F.col("address_data")))


def multiget_rows(requested: DataFrame, payloads: DataFrame, base: str) -> DataFrame:
    """What multiget reports say about the cards asked for: (call, doc_id, ord, href, outcome, etag, body).

    *requested* is (doc_id, ord, href), *payloads* (doc_id, call, status, body): a call is one or more requests, each with an
    answer, and doc_id numbers them in order. Hrefs of both are brought to one spelling below *base*; what a request
    didn't ask for falls away, what it didn't answer is missing, as is a card or a property that is not found (404, 410).
    Any other outcome is a class of error. A request that failed as a whole is one row of ord -1 without an href.
    """
    answers = payloads.select("doc_id", "call", F.col("status").alias("http"), "body")
    entries = cut(multistatus(answers.filter("http = 207")).drop("displayname", "is_collection", "is_addressbook"))
    broken = entries.filter("error IS NOT NULL").select("doc_id", F.lit("permanent").alias("outcome"))
    broken = broken.unionByName(answers.filter("NOT http <=> 207").select("doc_id", status_class(F.col("http"), F.lit(False)).alias("outcome")))
    asked = requested.select("doc_id", "ord", canonical_paths(base, F.col("href")).alias("href"))
    told = entries.filter("error IS NULL").select("doc_id", canonical_paths(base, F.col("href")).alias("href"), F.lit(True).alias("told"), "status", "propstat_error", "etag", "address_data")
    j = asked.join(broken.select("doc_id").distinct(), "doc_id", "left_anti").join(told, ["doc_id", "href"], "left")
    whole = F.col("etag").isNotNull() & F.col("address_data").isNotNull()
    code = F.when(F.col("status").isNotNull() & ~F.col("status").between(200, 299), F.col("status")).when(~whole, F.col("propstat_error"))
    outcome = F.when(F.col("told").isNull() | code.isin(404, 410), "missing").when(code.between(500, 599), "transient").when(code.isNull() & whole, "found").otherwise("permanent")
    rows = j.select("doc_id", "ord", "href", outcome.alias("outcome"), F.when(outcome == "found", F.col("etag")).alias("etag"), F.when(outcome == "found", F.col("address_data")).alias("body"))
    rows = rows.unionByName(broken.withColumn("ord", F.lit(-1)), allowMissingColumns=True)
    return rows.join(answers.select("doc_id", "call"), "doc_id").select("call", "doc_id", "ord", "href", "outcome", "etag", "body")


def multiget_calls(rows: DataFrame) -> DataFrame:
    """(call, error, found, missing) of rows as from ``multiget_rows``: one card's error is its whole call's, the first by
    request and place; a failed call has found nothing. One aggregation, combined map-side."""
    n = lambda outcome: F.count(F.when(F.col("outcome") == outcome, 1))
    bad = ~F.col("outcome").isin("found", "missing")
    out = rows.groupBy("call").agg(F.min_by(F.when(bad, F.col("outcome")), F.when(bad, F.struct("doc_id", "ord"))).alias("error"), n("found").alias("f"), n("missing").alias("m"))
    return out.select("call", "error", F.when(F.col("error").isNull(), F.col("f")).alias("found"), F.when(F.col("error").isNull(), F.col("m")).alias("missing"))


def multiget_cards(rows: DataFrame) -> DataFrame:
    """The rows of calls that did not fail, both found and missing ones. They are written once, as they are read twice."""
    rows = cut(rows)
    failed = multiget_calls(rows).filter("error IS NOT NULL").select("call")
    return rows.join(failed, "call", "left_anti")


def select_collection(collections: DataFrame, default: str) -> DataFrame:
    """One collection (principal, ord, path) per principal: the one whose last segment is *default*, else the first."""
    last = F.element_at(F.split(F.regexp_replace("path", "/+$", ""), "/"), -1)
    rest = [c for c in collections.columns if c != "principal"]
    return collections.groupBy("principal").agg(F.min_by(F.struct(*rest), F.struct(last != default, F.col("ord"))).alias("x")).select("principal", "x.*")


def canonical_path(base: str, href: str) -> str:
    """An href as a path: resolved, host dropped, each segment decoded and encoded in one way; a segment that isn't
    UTF-8 stays as it is."""
    if plain := _PLAIN.fullmatch(href):
        path, n = _ASCII.subn(lambda m: _ONE_SPELLING[m[0]], plain[1])
        if n == plain[1].count("%"):
            return path
    out = []
    for segment in urlsplit(urljoin(base, href)).path.split("/"):
        try:
            out.append(quote(unquote_to_bytes(segment).decode("utf-8"), safe=_SAFE))
        except UnicodeDecodeError:
            out.append(segment)
    return "/".join(out)


def canonical_paths(base: str, href: Column) -> Column:
    """``canonical_path`` as a column, in Arrow batches: url_decode turns a plus into a blank and can't be used."""

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return pd.Series([canonical_path(base, x) if isinstance(x, str) else None for x in s], dtype=object)

    return apply(href)


def dump_rows(cards: DataFrame) -> DataFrame:
    """(ord, card): one side's cards as JSON in the order of href.

    The position comes from a range-sorted table and one count per partition, not from a single sorted task.
    """
    from pyspark.sql import Window as W

    n = int(cards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    js = F.to_json(F.struct("href", "etag", "vcard"))
    rows = cut(cards.select("href", js.alias("card")).repartitionByRange(n, "href").withColumn("_pid", F.spark_partition_id()))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    base = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    here = F.row_number().over(W.partitionBy("_pid").orderBy("href")) - 1
    # One row per partition.
    return rows.join(F.broadcast(base), "_pid").select((F.col("_base") + here).alias("ord"), "card")


#: Namespaces of the request bodies; fixed values.
_NS = 'xmlns:d="DAV:" xmlns:c="urn:ietf:params:xml:ns:carddav"'


def propfind_body(*properties: str) -> str:
    """A PROPFIND that asks for *properties*, written with prefix d (WebDAV) or c (cards)."""
    return f"<d:propfind {_NS}><d:prop>{''.join(f'<{p}/>' for p in properties)}</d:prop></d:propfind>"


def sync_body(token: Column) -> Column:
    """A sync-collection report from *token* on; without one, of everything."""
    head, tail = f"<d:sync-collection {_NS}><d:sync-token>", "</d:sync-token><d:sync-level>1</d:sync-level><d:prop><d:getetag/></d:prop></d:sync-collection>"
    return F.concat(F.lit(head), xml_escape(F.coalesce(token, F.lit(""))), F.lit(tail))


def multiget_body(hrefs: Column) -> Column:
    """A multiget report of an array of hrefs."""
    each = F.transform(hrefs, lambda h: F.concat(F.lit("<d:href>"), xml_escape(h), F.lit("</d:href>")))
    head = f"<c:addressbook-multiget {_NS}><d:prop><d:getetag/><c:address-data/></d:prop>"
    return F.concat(F.lit(head), F.array_join(each, ""), F.lit("</c:addressbook-multiget>"))
