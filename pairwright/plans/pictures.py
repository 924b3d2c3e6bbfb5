"""Photos inside a cycle: what each side holds, what the ops do about it, and the photo state afterwards.

A record's photo is decided apart from the rest of it and then joins the record's op: the op's own write carries it, or a
second write to the other side follows (the counter write), or a record that needs nothing else is updated for its photo
alone. Photo rows are of PHOTOS, one per uid; a record without a row is untracked and only fills a gap on one side.
Bytes stay in the cards' own frame: a plan holds hashes and actions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions import cards
from pairwright.functions.shared import cut
from pairwright.operators import photos

PHOTOS = "uid string, tracked boolean, left_uri string, left_hash string, right_hash string, stripped boolean"
SIDES = ("left", "right")


@dataclass
class Pictures:
    now: DataFrame  # (side, uid, now_hash, now_uri, has_bytes, available) of cards that were read
    data: DataFrame  # (side, uid, data): the bytes behind the left's addresses, as far as they were fetched
    stored: DataFrame  # PHOTOS
    failed: DataFrame  # (uid, href, reason): left cards whose photo could not be fetched


def known_as(stored: DataFrame) -> DataFrame:
    """Photo rows under the names that ``photos`` reads."""
    return stored.select("uid", F.col("tracked").alias("photo_tracked"), F.col("left_uri").alias("photo_uri"), F.col("left_hash").alias("photo_hash"))


def look(own: DataFrame, stored: DataFrame, fetch) -> Pictures:
    """The photos of both sides' cards *own* (side, uid, href, photo), photo as from ``apply.snapshot_cards``.

    *fetch* answers (uri, data, error) for addresses (uri); each address that is needed is asked for once. One that gives
    no bytes blocks its cards.
    """
    held = cut(own.filter("photo IS NOT NULL").select("side", "uid", "href", "photo.kind", "photo.hash", "photo.uri"))
    state = known_as(stored)
    left = held.filter("side = 'left' AND kind = 'uri'").select("uid", "href", "uri")
    got = cut(fetch(photos.downloads(left, state)))
    fine = got.filter("error IS NULL").select("uri", "data", F.sha2("data", 256).alias("hash"))
    now = photos.current(held.select("side", "uid", "kind", "hash", "uri"), state, fine.select("uri", "hash"))
    data = left.join(fine, "uri").select(F.lit("left").alias("side"), "uid", "data")
    failed = left.join(got.filter("error IS NOT NULL").select("uri", F.col("error").alias("reason")), "uri").select("uid", "href", "reason")
    return Pictures(cut(now.select("side", "uid", "now_hash", "now_uri", "has_bytes", "available")), cut(data), stored, cut(failed))


def bytes_to_copy(pictures: Pictures, own: DataFrame, ops: DataFrame, rows: DataFrame) -> DataFrame:
    """(side, uid, data) of the photos that the ops copy; only their cards *own* (side, uid, body) are read for it."""
    across = lambda c: F.when(F.col(c) == "left", "right").otherwise("left").alias("side")
    need = ops.filter("op IN ('create', 'copy_group')").select("uid", across("on"))
    j = ops.select("uid", "on").join(rows, "uid")
    need = need.unionByName(j.filter("action IN ('set', 'copy')").select("uid", across("on"))).unionByName(j.filter("counter_action = 'set'").select("uid", across("counter_side")))
    need = cut(need)
    bodies = own.join(need, ["side", "uid"], "left_semi").join(pictures.data, ["side", "uid"], "left_anti").select("side", F.col("uid").alias("card_uid"), "body")
    inline = cards.parse(bodies, "body").select("side", F.col("card_uid").alias("uid"), cards.photo(F.col("props"))["bytes"].alias("data")).filter("data IS NOT NULL")
    return cut(inline.unionByName(pictures.data.join(need, ["side", "uid"], "left_semi").select("side", "uid", "data")))


def merge(decided: DataFrame, pictures: Pictures, winner: str) -> tuple[DataFrame, DataFrame]:
    """(decided rows with the photos' part in op, on and diag; their photo rows).

    A photo row is (uid, action, counter_side, counter_action, photo_only, open, and what ``photos.next_state`` reads).
    *open* rows get a new photo state; others, such as one with a photo that isn't at hand, keep theirs.
    """
    s = pictures.stored.select("uid", "tracked", "stripped", F.col("left_uri").alias("s_uri"), F.col("left_hash").alias("left_recorded"), F.col("right_hash").alias("right_recorded"))
    j = decided.select("uid", "op", "on", "diag", "left_status", "right_status").join(s, "uid", "left")
    fine = F.lit(True)
    for side in SIDES:
        n = pictures.now.filter(F.col("side") == side).select("uid", F.col("now_hash").alias(f"{side}_now"), F.col("now_uri").alias(f"{side}_now_uri"), F.col("has_bytes").alias(f"{side}_has"), F.col("available").alias(f"{side}_ok"))
        j = j.join(n, "uid", "left")
        read, quiet = F.col(f"{side}_status").isin("same", "changed"), F.col(f"{side}_status") == "unchanged"
        fine = fine & (~read | F.coalesce(f"{side}_ok", F.lit(True)))
        j = j.withColumns({f"{side}_hash": F.when(read, F.col(f"{side}_now")).when(quiet, F.col(f"{side}_recorded")), f"{side}_bytes": read & F.coalesce(f"{side}_has", F.lit(False))})
        if side == "left":
            j = j.withColumn("left_uri", F.when(read, F.col("left_now_uri")).when(quiet, F.col("s_uri")))
    j = photos.decide(j.withColumn("fine", fine), winner)
    j = j.withColumns({f"{side}_action": F.when(F.col("fine"), F.col(f"{side}_action")).otherwise("keep") for side in SIDES})
    before = j.select("uid", F.coalesce(F.col("op"), F.lit("none")).alias("op_before"))
    m = photos.merge_ops(j).join(before, "uid")
    unread = (F.col("left_status") == "unchanged") | (F.col("right_status") == "unchanged")
    known = F.col("fine") & (F.coalesce("tracked", F.lit(False)) | ~unread)
    rows = m.select(
        "uid",
        F.when(F.col("fine"), F.col("photo_action")).alias("action"),
        "counter_side",
        "counter_action",
        ((F.col("op") == "update") & (F.col("op_before") != "update")).alias("photo_only"),
        (known & F.coalesce("op", F.lit("none")).isin("none", "refresh", "update", "conflict") & F.col("diag").isNull() & (F.col("left_status") != "deleted") & (F.col("right_status") != "deleted")).alias("open"),
        *["tracked", "stripped", "left_uri", "left_hash", "right_hash", "left_recorded", "right_recorded", "left_action", "right_action"],
    )
    moved = m.select("uid", "op", "on", "diag")
    return decided.drop("op", "on", "diag").join(moved, "uid"), rows


def body(content: Column, target: Column, action: Column, data: Column, to_left: Column) -> tuple[Column, Column]:
    """(card to put, what that does to the photo) for *content* written over *target* (null: nothing is there).

    The content's own photo never goes along: without an action the target keeps its photo. A photo that would make a
    card of the left too large is left out.
    """
    bare = cards.without_photos(content)
    kept = F.coalesce(cards.with_photos_of(bare, target), bare)
    fits = ~to_left | photos.fits(F.octet_length(bare), F.octet_length(data))
    copied, has = F.coalesce(action.isin("set", "copy"), F.lit(False)), data.isNotNull()
    out = F.when(copied, F.when(has & fits, cards.with_inline_photo(bare, data)).otherwise(bare)).when(action == "remove", bare).otherwise(kept)
    change = F.when(copied, F.when(~has, "none").when(fits, "set").otherwise("stripped")).when(action == "remove", "removed").when(kept == bare, "none").otherwise("kept")
    return out, change


def actions(ops: DataFrame, rows: DataFrame | None, data: DataFrame | None) -> DataFrame:
    """*ops* with action, counter_side, counter_action, photo_only and the bytes at hand, left_data and right_data; without
    photo rows all of them are null. New copies take their source's photo along."""
    spark = ops.sparkSession
    rows = rows if rows is not None else spark.createDataFrame([], "uid string, action string, counter_side string, counter_action string, photo_only boolean")
    data_of = lambda s: (data if data is not None else spark.createDataFrame([], "side string, uid string, data binary")).filter(F.col("side") == s).select("uid", F.col("data").alias(f"{s}_data"))
    out = ops.join(rows.select("uid", "action", "counter_side", "counter_action", "photo_only"), "uid", "left").join(data_of("left"), "uid", "left").join(data_of("right"), "uid", "left")
    return out.withColumn("action", F.when(F.col("op").isin("create", "copy_group") & F.lit(data is not None), "copy").otherwise(F.col("action")))


def next_photos(pictures: Pictures, rows: DataFrame, ops: DataFrame, outcomes: DataFrame, changes: DataFrame, read: DataFrame) -> DataFrame:
    """PHOTOS after a cycle.

    *outcomes* are of ``apply_plan``, *changes* (uid, side, change) of its accepted puts, *read* (uid, found, kind, uri) the
    left cards read back after a photo was set there. Failed ops and records that nothing was decided about keep their row,
    deleted records lose it, as do pairs that are new: those are filled in the next cycle.
    """
    failed = outcomes.filter("reason IS NOT NULL").select("uid")
    late = ops.select("uid").join(outcomes.select("uid"), "uid", "left_anti")  # ops that didn't run
    done = ops.join(outcomes.filter("reason IS NULL").select("uid"), "uid", "left_semi").select("uid", "op", "on")
    of = lambda s: changes.filter(F.col("side") == s).groupBy("uid").agg(F.max("change").alias(f"{s}_change"))
    stay = failed.unionByName(late).distinct()
    merged = rows.filter("open").join(stay, "uid", "left_anti").join(of("left"), "uid", "left").join(of("right"), "uid", "left")
    own_uri = (F.col("left_action") == "keep") | F.col("left_change").isNull()
    merged = photos.next_state(merged).select(
        "uid", F.col("left_change").alias("change"), F.col("next_left_hash").alias("left_hash"), F.when(own_uri, F.col("left_uri")).alias("left_uri"), F.col("next_right_hash").alias("right_hash"), F.col("next_stripped").alias("stripped")
    )
    again = done.filter("op = 'resurrect'").join(rows.filter("action = 'copy'").select("uid"), "uid", "left_semi").select("uid", F.lit("create").alias("op"), "on")
    copies = done.filter("op IN ('create', 'copy_group')").unionByName(again)
    source = pictures.now.withColumn("on", F.when(F.col("side") == "left", "right").otherwise("left")).drop("side")
    wrote = changes.select("uid", F.col("side").alias("on"), (F.col("change") != "stripped").alias("fits"))
    source = copies.select("uid", "on").join(source, ["uid", "on"]).join(wrote, ["uid", "on"], "left").drop("on")
    fresh = photos.attach_to_copies(copies, source).filter("tracked")
    fresh = fresh.select("uid", F.when(F.col("on") == "left", F.col("change")).alias("change"), "left_hash", "left_uri", "right_hash", "stripped")
    new = cut(merged.unionByName(fresh))
    landed = photos.landed(new.select("uid", F.lit("left").alias("side"), "change", "left_hash", "left_uri", F.coalesce("stripped", F.lit(False)).alias("stripped")), read)
    new = new.select("uid", "right_hash").join(landed.filter("error IS NULL"), "uid").select("uid", F.lit(True).alias("tracked"), "left_uri", "left_hash", "right_hash", "stripped")
    gone = done.filter("op IN ('delete', 'forget', 'recreate', 'adopt', 'resurrect', 'create', 'copy_group')").select("uid")
    old = pictures.stored.join(gone.unionByName(new.select("uid")).distinct(), "uid", "left_anti")
    return old.unionByName(new)
