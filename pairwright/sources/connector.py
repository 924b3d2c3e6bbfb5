"""What a cycle asks of its two servers, and a recorded pair of servers that answers it from a versioned store."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.shared import cut
from pairwright.operators import failures, photos, sinks
from pairwright.operators.statestore import StateStore

SIDES = ("left", "right")
CARDS = "side string, href string, etag string, body binary"
PLACE = ("stage", "ord", "uid")


class TokenRejected(Exception):
    """A server no longer knows a sync token; listing starts over without one."""


class ListingFailed(Exception):
    """A side could not be listed; *error* is the error's class."""

    def __init__(self, side: str, error: str) -> None:
        super().__init__(f"{side}: {error}")
        self.side, self.error = side, error


class Connector(Protocol):
    """Both sides' servers. Rows go in and out as DataFrames; only tokens and collection paths are the driver's."""

    def collection(self, side: str) -> str:
        """The path under which new cards are put."""

    def token(self, side: str) -> str | None:
        """A token for the present content; None where the server has none."""

    def changes_since(self, side: str, token: str) -> DataFrame:
        """(href, kind 'changed' or 'removed', etag) since *token*; raises TokenRejected."""

    def listing(self, side: str) -> DataFrame:
        """(href, etag) of all cards; raises ListingFailed."""

    def fetch(self, wanted: DataFrame) -> DataFrame:
        """(side, href, etag, body) of the *wanted* (side, href) that are there."""

    def write(self, writes: DataFrame) -> DataFrame:
        """Carry out *writes* (stage, ord, uid, side, href, method, if_match, body) in the order of their places: (stage, ord,
        uid, side, href, method, outcome, etag). An account-wide error stops those of later places: outcome 'not_run'."""

    def pictures(self, uris: DataFrame) -> DataFrame:
        """(uri, data, error) of the left's photos at *uris* (uri); error is a class of error, null where there are bytes."""

    def forget(self, side: str) -> None:
        """Look the side up anew before the next cycle."""


def ordered_outcomes(writes: DataFrame, errors: DataFrame) -> DataFrame:
    """*writes* with ``error``: what *errors* (side, href, error) answer, and 'not_run' after the first place that meets an
    account-wide one. That place alone reaches the driver."""
    place = F.struct(*PLACE)
    w = writes.join(errors.select("side", "href", "error"), ["side", "href"], "left")
    end = w.filter(failures.is_fatal(F.col("error"))).agg(F.min(place).alias("place")).first()["place"]
    if end is None:
        return w
    upto = F.struct(*[F.lit(end[p]).cast(writes.schema[p].dataType).alias(p) for p in PLACE])
    return w.withColumn("error", F.when(place > upto, "not_run").otherwise(F.col("error")))


def carried_out(cards: DataFrame, writes: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards after *writes*, outcomes) of servers with *cards* (CARDS) that answer *errors*."""
    w = cut(ordered_outcomes(writes, errors))
    name = [*PLACE, "side", "href", "method"]
    out = w.filter("error IS NOT NULL").select(*name, F.col("error").alias("outcome"), F.lit(None).cast("string").alias("etag"))
    after = None
    for s in SIDES:
        own = w.filter((F.col("side") == s) & F.col("error").isNull())
        new, told = sinks.apply_writes(cards.filter(F.col("side") == s).drop("side"), own.select("href", F.col("method").alias("op"), "if_match", "body"))
        out = out.unionByName(own.select(*name).join(told.select("href", "outcome", "etag"), "href").select(*name, "outcome", "etag"))
        new = new.select(F.lit(s).alias("side"), "href", "etag", "body")
        after = new if after is None else after.unionByName(new)
    return cut(after), cut(out)


class FrameServer:
    """Servers whose cards are a DataFrame (CARDS), kept for one plan."""

    def __init__(self, cards: DataFrame, collections: dict[str, str], errors: DataFrame | None = None) -> None:
        self.cards, self.collections = cards, collections
        self.errors = errors if errors is not None else cards.sparkSession.createDataFrame([], "side string, href string, error string")

    def collection(self, side: str) -> str:
        return self.collections[side]

    def fetch(self, wanted: DataFrame) -> DataFrame:
        return self.cards.join(wanted.select("side", "href").distinct(), ["side", "href"], "left_semi").select("side", "href", "etag", "body")

    def write(self, writes: DataFrame) -> DataFrame:
        self.cards, out = carried_out(self.cards, writes, self.errors)
        return out


class RecordedServers:
    """Servers on a StateStore: every accepted batch of writes is a version, and a version's number is a sync token.

    *refuses* gives the errors (side, href, error) that writes meet, *unlisted* the error class that listing a side meets.
    The photos that the left's addresses lead to are (uri, status, data) in *album*, below *host*.
    """

    def __init__(self, spark: SparkSession, path: str, collections: dict[str, str], refuses: Callable[[], DataFrame] | None = None, album: DataFrame | None = None, host: str = "") -> None:
        self.spark, self.store, self.collections, self.refuses = spark, StateStore(spark, path), collections, refuses
        self.unlisted: dict[str, str] = {}
        self.forgotten: list[str] = []
        self.album, self.host = album if album is not None else spark.createDataFrame([], "uri string, status int, data binary"), host

    def put(self, cards: DataFrame) -> None:
        """Make *cards* (CARDS) the content of both servers, as their own users would."""
        self.store.commit({"cards": cards}, self.store.version())

    def cards(self, version: int | None = None) -> DataFrame:
        held = self.store.read("cards", version)
        return held if held is not None else self.spark.createDataFrame([], CARDS)

    def collection(self, side: str) -> str:
        return self.collections[side]

    def token(self, side: str) -> str | None:
        return str(self.store.version() or 0)

    def changes_since(self, side: str, token: str) -> DataFrame:
        version = int(token)
        if version and not self.store.readable(version):
            raise TokenRejected(f"{side}: {token}")
        of = lambda v, name: (self.cards(v) if v else self.cards().limit(0)).filter(F.col("side") == side).select("href", F.col("etag").alias(name))
        j = of(self.store.version(), "etag").join(of(version, "before"), "href", "full_outer").filter("NOT etag <=> before")
        return j.select("href", F.when(F.col("etag").isNull(), "removed").otherwise("changed").alias("kind"), "etag")

    def listing(self, side: str) -> DataFrame:
        if error := self.unlisted.get(side):
            raise ListingFailed(side, error)
        return self.cards().filter(F.col("side") == side).select("href", "etag")

    def fetch(self, wanted: DataFrame) -> DataFrame:
        return self.cards().join(wanted.select("side", "href").distinct(), ["side", "href"], "left_semi").select("side", "href", "etag", "body")

    def write(self, writes: DataFrame) -> DataFrame:
        version = self.store.version()
        errors = self.refuses() if self.refuses else self.spark.createDataFrame([], "side string, href string, error string")
        after, out = carried_out(self.cards(version), writes, errors)
        if not out.filter("outcome = 'done'").isEmpty():
            self.store.commit({"cards": after}, version)
        return out

    def pictures(self, uris: DataFrame) -> DataFrame:
        j = uris.select("uri").join(self.album, "uri", "left")
        error = photos.download_error(F.col("uri"), self.host, F.col("status"), F.octet_length("data"))
        return j.select("uri", F.when(error.isNull(), F.col("data")).alias("data"), error.alias("error"))

    def forget(self, side: str) -> None:
        self.forgotten.append(side)
        self.unlisted.pop(side, None)
