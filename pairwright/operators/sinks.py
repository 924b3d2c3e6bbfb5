"""Writes against a server's table of records, guarded by etags as a server would guard them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_writes(server: DataFrame, writes: DataFrame, max_bytes: int = 280_000) -> tuple[DataFrame, DataFrame]:
    """(new server table, outcomes) for writes (href, op 'put'|'delete', if_match, body) on server (href, etag, body).

    A put without if_match must create, one with it must find that etag; a body over the limit is too large. A delete
    of a record that is gone, or that some other etag now guards but is gone, is done. Refused writes change nothing.
    """
    w = writes.select("href", F.col("op").alias("w_op"), F.col("if_match"), F.col("body").alias("w_body"))
    j = server.join(w, "href", "full_outer")
    here = F.col("etag").isNotNull()
    put, delete = F.col("w_op") == "put", F.col("w_op") == "delete"
    guard = F.when(F.col("if_match").isNull(), ~here | delete).otherwise(F.col("etag").eqNullSafe(F.col("if_match")))
    outcome = (
        F.when(F.col("w_op").isNull(), None)
        .when(put & (F.octet_length("w_body") > max_bytes), "too_large")
        .when(delete & ~here, "done")
        .when(guard, "done")
        .otherwise("precondition_failed")
    )
    j = j.withColumn("outcome", outcome)
    ok = F.coalesce(F.col("outcome") == "done", F.lit(False))
    new = j.filter(~(ok & delete) & (here | ok)).select(
        "href", F.when(ok & put, F.md5(F.col("w_body").cast("binary"))).otherwise(F.col("etag")).alias("etag"), F.when(ok & put, F.col("w_body")).otherwise(F.col("body")).alias("body")
    )
    return new, j.filter("w_op IS NOT NULL").select("href", F.col("w_op").alias("op"), "outcome", F.when(ok & put, F.md5(F.col("w_body").cast("binary"))).alias("etag"))


def read_back(outcomes: DataFrame, server: DataFrame, photos: DataFrame) -> DataFrame:
    """What became of a written photo: uri, inline or dropped, by the record as the server now has it."""
    done = outcomes.filter("op = 'put' AND outcome = 'done'").select("href")
    now = server.select("href").join(photos.select("href", "photo_kind"), "href", "left")
    return done.join(now, "href", "left").select("href", F.coalesce("photo_kind", F.lit("dropped")).alias("photo"))


def learn_etags(accepted: DataFrame, read: DataFrame) -> DataFrame:
    """The etags of *accepted* puts (side, href, etag, null if the server sent none): those of cards *read* (side, href, etag)
    afterwards stand in. A card that then has none is gone right after its write, an error; it stays listed as written."""
    j = accepted.join(read.select("side", "href", F.col("etag").alias("_read")), ["side", "href"], "left")
    etag = F.coalesce("etag", "_read")
    return j.select("side", "href", etag.alias("etag"), F.when(etag.isNull(), "permanent").alias("error"))


def new_conflicts(history: DataFrame, conflicts: DataFrame, cycle: str) -> DataFrame:
    """A cycle's *conflicts* that the history doesn't have."""
    return conflicts.withColumn("cycle", F.lit(cycle)).join(history.select("cycle", "uid"), ["cycle", "uid"], "left_anti").select(*conflicts.columns, "cycle")


def append_conflicts(history: DataFrame | None, conflicts: DataFrame, cycle: str) -> DataFrame:
    """The conflict history with *conflicts* of a cycle. History only ever grows; a cycle's conflicts that are there already,
    because they were stored before its writes or because the cycle runs again, are not added twice."""
    if history is None:
        return conflicts.withColumn("cycle", F.lit(cycle))
    return history.unionByName(new_conflicts(history, conflicts, cycle))


def dump(rows: DataFrame, path: str) -> None:
    """One side's cards as JSON lines in the order of href."""
    rows.sort("href").write.mode("overwrite").json(path)
