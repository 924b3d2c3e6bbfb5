"""Retry times over a stream against the batch rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pairwright.operators import failures
from pairwright.streaming import retries

OUTCOMES = "side string, href string, etag string, at timestamp, reason string"


def test_stream_keeps_the_batch_rows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    batches = [
        [("left", "/a", "1", at(0), "transient"), ("left", "/b", None, at(0), "rejected"), ("right", "/a", "9", at(5), "rejected")],
        [("left", "/a", "1", at(130), "transient"), ("left", "/b", None, at(131), None)],
        [("left", "/a", "2", at(500), "too_large"), ("left", "/c", "7", at(4000), "transient")],
        [("left", "/z", "7", at(90_000), None)],
        [("left", "/z", "7", at(90_001), None)],
    ]
    path = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, OUTCOMES).coalesce(1).write.parquet(f"{path}/{i}")
    seen = []

    def run():
        stream = spark.readStream.schema(OUTCOMES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
        query = retries.retry_changes(stream, "1 second").writeStream.foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None

    run()
    failed = {(r.side, r.href, r.etag, r.attempts, r.first_at, r.next_retry_at, r.reason) for r in seen if r.event == "failed"}
    events = spark.createDataFrame([r for rows in batches for r in rows if r[4]], OUTCOMES)
    hist = failures.replay_history(events, ["side", "href"], ["at"]).withColumn("next", F.col("at") + F.make_dt_interval(secs=F.col("wait_s")))
    assert failed == {(r.side, r.href, r.etag, r.attempts, r.first_at, r.next, r.reason) for r in hist.collect()} and len(failed) == 6
    assert [(r.href, r.attempts) for r in seen if r.event == "cleared"] == [("/b", 1)]
    due = {(r.side, r.href, r.attempts, r.next_retry_at) for r in seen if r.event == "due"}
    assert due >= {("left", "/a", 1, at(620)), ("left", "/c", 1, at(4120)), ("right", "/a", 1, at(125))}
    before = len(seen)
    run()  # nothing new: a restart repeats nothing
    assert len(seen) == before
