"""Recorded feeds as a data source, and pinned versions of a store."""

import json

import pytest
from pyspark.sql import functions as F

from pairwright.operators import cdc
from pairwright.operators.statestore import Moved, StateStore
from pairwright.sources.feed import FeedSource


def page(folder, n, token, after, members, more=False):
    folder.mkdir(exist_ok=True)
    rows = [{"href": h, "status": s, "etag": e} for h, s, e in members]
    (folder / f"{n:012d}.json").write_text(json.dumps({"token": token, "after": after, "more": more, "members": rows}))


def test_batch_stream_restarts_and_rejected_tokens(spark, tmp_path):
    spark.dataSource.register(FeedSource)
    feed, path = tmp_path / "feed", str(tmp_path / "feed")
    page(feed, 0, "t1", None, [("/a", 200, "1"), ("/b", 200, "1")])
    page(feed, 1, "t2", "t1", [("/b", 404, None), ("/c", 200, "1")], more=True)
    page(feed, 2, "t3", "t2", [("/c", 200, "2")])
    load = lambda: {(r.href, r.kind, r.etag) for r in cdc.latest_changes(spark.read.format("pairwright_feed").load(path)).collect()}
    assert load() == {("/a", "changed", "1"), ("/b", "removed", None), ("/c", "changed", "2")}
    seen = []

    def run():
        query = spark.readStream.format("pairwright_feed").load(path).writeStream.foreachBatch(lambda df, n: seen.extend(map(tuple, df.sort("page", "ord").collect())))
        query = query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    assert [(r[2], r[4], r[5]) for r in seen] == [("/a", "1", True), ("/b", "1", True), ("/b", None, False), ("/c", "1", False), ("/c", "2", False)]
    run()
    assert len(seen) == 5  # a restart repeats nothing
    page(feed, 3, "t4", "t3", [("/d", 200, "1")])
    run()
    assert [r[2] for r in seen[5:]] == ["/d"]
    for n in range(4):
        (feed / f"{n:012d}.json").unlink()
    page(feed, 4, "u1", None, [("/a", 200, "3"), ("/d", 200, "1")])  # the server forgot t4
    run()
    assert [(r[2], r[5]) for r in seen[6:]] == [("/a", True), ("/d", True)]


def test_writer_appends_a_page_or_nothing(spark, tmp_path):
    spark.dataSource.register(FeedSource)
    path = str(tmp_path / "out")
    rows = spark.range(20).select(F.concat(F.lit("/"), "id").alias("href"), F.lit(200).alias("status"), F.lit("e").alias("etag")).repartition(3)
    rows.write.format("pairwright_feed").mode("append").save(path)
    rows.limit(1).withColumn("status", F.lit(404)).write.format("pairwright_feed").mode("append").save(path)
    bad = rows.withColumn("href", F.when(F.col("href") == "/7", F.raise_error(F.lit("no"))).otherwise(F.col("href")))
    with pytest.raises(Exception, match="no"):
        bad.write.format("pairwright_feed").mode("append").save(path)
    got = cdc.latest_changes(spark.read.format("pairwright_feed").load(path))
    assert (got.count(), got.filter("kind = 'removed'").count()) == (20, 1)
    assert not [x for x in (tmp_path / "out").iterdir() if x.name.startswith("_")]
    with pytest.raises(Exception, match="only grows"):
        rows.write.format("pairwright_feed").mode("overwrite").save(path)


def test_a_pinned_version_stays_whole(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    one = lambda x: spark.createDataFrame([(x,)], "x int")
    store.commit({"a": one(1), "b": one(1)}, None, meta={"n": 1})
    with store.pin() as pinned:
        for v in range(2, 6):
            store.commit({"a": one(v), "b": one(v)} if v % 2 else {"a": one(v)}, v - 1, meta={"n": v})
            store.vacuum(1)
        assert pinned.tables() == ["a", "b"] and [pinned.read(n).first().x for n in ("a", "b")] == [1, 1] and pinned.meta() == {"n": 1}
        assert not store.readable(2) and store.read("b").first().x == 5
    assert store.vacuum(1) and not store.readable(1)
    with pytest.raises(Moved):
        store.pin(1)
    left = store.pin(5)
    assert store.manifests.pinned(3600) == {5} and store.manifests.pinned(-5) == set() and left.read("a").first().x == 5
