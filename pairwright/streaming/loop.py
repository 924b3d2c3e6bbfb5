"""The repeated run: a change stream into a keyed snapshot, and the poll loop."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairwright.operators import cdc
from pairwright.operators.statestore import StateStore

PAGES = "page long, ord long, href string, status int, etag string"


def change_stream(spark: SparkSession, path: str) -> DataFrame:
    """Recorded delta pages (parquet files of PAGES) as a stream; new files are new pages."""
    return spark.readStream.schema(PAGES).parquet(path)


def snapshot(store: StateStore, version: int | None = None) -> DataFrame | None:
    """The listing (href, etag) that the changes kept so far add up to."""
    held = store.read("changes", version)
    if held is None:
        return None
    return held.groupBy("href").agg(F.max_by(F.struct("kind", "etag"), "batch").alias("x")).filter("x.kind = 'changed'").select("href", "x.etag")


def keep_snapshot(changes: DataFrame, store: StateStore, checkpoint: str, interval: str | None = None, compact_after: int = 50) -> StreamingQuery:
    """Keep each micro-batch's changes in the store's table ``changes``; ``snapshot`` reads what they add up to.

    A batch appends its own changes only; the folders of more than *compact_after* batches are rewritten as one. The
    batch number is committed with them, so a batch that runs again after a crash changes nothing, with rows or without.
    """

    def fold(batch: DataFrame, number: int) -> None:
        version = store.version()
        if store.meta(version).get("batch", -1) >= number:
            return
        delta = cdc.latest_changes(batch).withColumn("batch", F.lit(number).cast("long"))
        if len(store.folders("changes", version)) < compact_after:
            store.commit({}, version, append={"changes": delta}, meta={"batch": number})
            return
        both = store.read("changes", version).unionByName(delta)
        last = both.groupBy("href").agg(F.max_by(F.struct("kind", "etag", "batch"), "batch").alias("x")).filter("x.kind = 'changed'").select("href", "x.*")
        store.commit({"changes": last}, version, meta={"batch": number})

    writer = changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def event_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Failures per record and window of a stream of events (ts, href, etag); late ones count within the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "href").agg(F.count(F.lit(1)).alias("failures"), F.max_by("etag", "ts").alias("etag"))


def poll(run: Callable[[], float | None], interval: float = 120, stop: Callable[[], bool] = lambda: False, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run now, then every *interval* seconds (60 at least) until *stop*; returns the number of runs.

    *run* may return seconds to wait, as a server asked for; the next run is then at the later of both times. A missed
    tick delays, it does not pile up. An error ends one run, not the loop.
    """
    interval, n = max(60, interval), 0
    while not stop():
        began, wait = clock(), None
        try:
            wait = run()
        except Exception as e:
            print(f"cycle failed: {type(e).__name__}")
        n += 1
        until = max(began + interval, clock() + (wait or 0))
        while not stop() and (left := until - clock()) > 0:
            sleep(min(left, 1.0))
    return n
