"""The photo dimension of a merge, decided apart from the rest of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.text import status_class

MAX_CARD_BYTES = 280_000
MAX_PHOTO_BYTES = 10 * 1024 * 1024


def downloads(fetched: DataFrame, state: DataFrame) -> DataFrame:
    """Photo addresses to fetch, each once: of fetched cards (uid, uri) whose row is missing, untracked, has another
    address or no hash."""
    s = state.select("uid", "photo_tracked", F.col("photo_uri").alias("s_uri"), F.col("photo_hash").alias("s_hash"), F.lit(True).alias("known"))
    need = F.col("known").isNull() | ~F.col("photo_tracked") | ~F.col("uri").eqNullSafe(F.col("s_uri")) | F.col("s_hash").isNull()
    return fetched.filter("uri IS NOT NULL").join(s, "uid", "left").filter(need).select("uri").distinct()


def allowed(uri: Column, host: str) -> Column:
    """https only, no user info, *host* or a host below it."""
    h = F.lower(F.try_parse_url(uri, F.lit("HOST")))
    return uri.rlike("(?i)^https://") & F.try_parse_url(uri, F.lit("USERINFO")).isNull() & ((h == host) | h.endswith(f".{host}"))


def download_error(uri: Column, host: str, status: Column, n_bytes: Column, limit: int = MAX_PHOTO_BYTES) -> Column:
    """Why a download of *uri* gives no photo, null if it does: an address that isn't allowed and a body over the limit are
    permanent, a status outside 200 to 299 has its own class (none at all: transient)."""
    return F.when(~F.coalesce(allowed(uri, host), F.lit(False)), "permanent").when(~F.coalesce(status.between(200, 299), F.lit(False)), status_class(status, F.lit(False))).when(n_bytes > limit, "permanent")


def blocked(entries: DataFrame, failed: DataFrame) -> DataFrame:
    """Fetched cards (href, kind, uid) whose photo could not be fetched: (uid, href, reason) of *failed* (uid, reason). They
    are held: their photo would read as removed."""
    return entries.filter("kind = 'fetched' AND uid IS NOT NULL").select("uid", "href").join(failed.select("uid", "reason"), "uid")


def current(cards: DataFrame, state: DataFrame, downloaded: DataFrame) -> DataFrame:
    """The photos of cards (side, uid, kind, hash, uri), kind as in ``cards.photo``: adds now_hash, now_uri, has_bytes
    and available.

    An address on the left is known by the state's hash where the row is tracked under that address, without bytes; else
    by what was *downloaded* (uri, hash); else it isn't available. An address on the right stands for itself, an
    unreadable photo for its card's uid; neither can be copied. *state* is (uid, photo_tracked, photo_uri, photo_hash).
    """
    s = state.select("uid", F.when(F.col("photo_tracked"), F.col("photo_uri")).alias("uri"), F.col("photo_hash").alias("_known")).filter("uri IS NOT NULL AND _known IS NOT NULL")
    d = downloaded.filter("hash IS NOT NULL").select("uri", F.col("hash").alias("_down"))
    out = cards.join(s, ["uid", "uri"], "left").join(d, "uri", "left")
    left_uri = (F.col("kind") == "uri") & (F.col("side") == "left")
    text = lambda x: F.sha2(F.col(x).cast("binary"), 256)
    now = F.when(F.col("kind") == "inline", F.col("hash")).when(left_uri, F.coalesce("_known", "_down")).when(F.col("kind") == "uri", text("uri")).when(F.col("kind") == "unreadable", text("uid"))
    has = F.coalesce((F.col("kind") == "inline") | left_uri & F.col("_known").isNull() & F.col("_down").isNotNull(), F.lit(False))
    return out.select(*cards.columns, now.alias("now_hash"), F.when(left_uri & now.isNotNull(), F.col("uri")).alias("now_uri"), has.alias("has_bytes"), (F.col("kind").isNull() | now.isNotNull()).alias("available"))


def recorded(state: DataFrame) -> DataFrame:
    """What stands for the photos of a side that was not read: (side, uid, now_hash, now_uri, has_bytes), as recorded."""
    of = lambda s, hash_, uri: state.select(F.lit(s).alias("side"), "uid", F.col(hash_).alias("now_hash"), uri.alias("now_uri"), F.lit(False).alias("has_bytes")).filter("now_hash IS NOT NULL")
    return of("left", "left_photo_hash", F.col("left_photo_uri")).unionByName(of("right", "right_photo_hash", F.lit(None).cast("string")))


def attach_to_copies(ops: DataFrame, sources: DataFrame) -> DataFrame:
    """The photos of copies: ops (uid, op, on) that create a card, with *sources* as from ``current`` (uid, now_hash,
    now_uri, has_bytes, available) and fits, whether the copy may hold the photo.

    Adds change (none, set, stripped; null for other ops) and the row's photo state after the op: tracked, left_hash,
    left_uri, right_hash, stripped. Without the bytes, or where the photo isn't available, the row stays untracked.
    """
    j = ops.join(sources.select("uid", "now_hash", "now_uri", "has_bytes", "available", "fits"), "uid", "left")
    copies = F.col("op").isin("create", "copy_group")
    there, to_left = F.col("now_hash").isNotNull(), F.col("on") == "left"
    open_row = copies & (F.coalesce("available", F.lit(True)) & (~there | F.col("has_bytes")))
    change = F.when(~copies, None).when(open_row & there, F.when(to_left & ~F.coalesce("fits", F.lit(True)), "stripped").otherwise("set")).otherwise("none")
    kept, set_ = F.when(open_row, F.col("now_hash")), F.when(change == "set", F.col("now_hash"))
    return j.select(
        *ops.columns,
        change.alias("change"),
        F.when(copies, open_row).alias("tracked"),
        F.when(to_left, set_).otherwise(kept).alias("left_hash"),
        F.when(~to_left & open_row, F.col("now_uri")).alias("left_uri"),
        F.when(to_left, kept).otherwise(set_).alias("right_hash"),
        F.coalesce(change == "stripped", F.lit(False)).alias("stripped"),
    )


def push(raw: Column, target: Column) -> tuple[Column, Column, Column]:
    """(card as recorded, body to write, change) of a card that replaces *target*, or none (null): it is recorded without
    photos; what is written keeps the target's."""
    from pairwright.functions import cards

    bare = cards.without_photos(raw)
    body = F.coalesce(cards.with_photos_of(bare, target), bare)
    return bare, body, F.when(body == bare, "none").otherwise("kept")


def decide(rows: DataFrame, winner: str = "left") -> DataFrame:
    """Add left_action and right_action (keep, set, remove) to rows with tracked, left_hash, right_hash,
    left_bytes, right_bytes (whether bytes are at hand), left_recorded and right_recorded.

    Untracked rows only fill a gap on one side. Tracked rows carry a change across; if both sides changed and differ
    the winner's photo goes. Without bytes a photo can't be copied and is kept; none at the source removes.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    left_new, right_new = ~same("left_hash", "left_recorded"), ~same("right_hash", "right_recorded")
    carry = lambda s: F.when(F.col(f"{s}_hash").isNull(), "remove").when(F.col(f"{s}_bytes"), "set").otherwise("keep")
    tracked = F.coalesce("tracked", F.lit(False))
    both = left_new & right_new & ~same("left_hash", "right_hash")
    to_right = F.when(tracked, (left_new & ~right_new) | (both & F.lit(winner == "left"))).otherwise(F.col("left_hash").isNotNull() & F.col("right_hash").isNull())
    to_left = F.when(tracked, (right_new & ~left_new) | (both & F.lit(winner == "right"))).otherwise(F.col("right_hash").isNotNull() & F.col("left_hash").isNull())
    return rows.withColumns({"left_action": F.when(to_left, carry("right")).otherwise("keep"), "right_action": F.when(to_right, carry("left")).otherwise("keep")})


def apply_action(action: Column, has_photo: Column, fits: Column) -> Column:
    """What a write did to a side's photo: kept, none, removed, set, or stripped where the card would be too large."""
    return F.when(action == "keep", F.when(has_photo, "kept").otherwise("none")).when(action == "remove", "removed").when(fits, "set").otherwise("stripped")


def fits(card_bytes: Column, photo_bytes: Column, limit: int = MAX_CARD_BYTES) -> Column:
    """Whether a card with an embedded photo stays within the limit: base64, a fold every 74 characters, the head."""
    encoded = F.ceil(photo_bytes / 3) * 4
    return card_bytes + encoded + F.ceil(encoded / 74) * 3 + 40 <= limit


def next_state(rows: DataFrame) -> DataFrame:
    """The photo state after an op: adds next_left_hash, next_right_hash, next_stripped to rows as from ``decide`` with
    left_change and right_change (null: not written), stripped."""
    left_kept = (F.col("left_action") == "keep") | F.col("left_change").isNull()
    right_kept = (F.col("right_action") == "keep") | F.col("right_change").isNull()
    moved = ~F.col("left_hash").eqNullSafe(F.col("left_recorded"))
    return rows.withColumns(
        {
            "next_left_hash": F.when(left_kept, F.col("left_hash")).when(F.col("left_change") == "set", F.col("right_hash")),
            "next_right_hash": F.when(right_kept, F.col("right_hash")).when(F.col("right_change") == "set", F.col("left_hash")),
            "next_stripped": F.when(left_kept, F.coalesce("stripped", F.lit(False)) & ~moved).otherwise(F.col("left_change") == "stripped"),
        }
    )


def merge_ops(rows: DataFrame) -> DataFrame:
    """Carry photo actions into plan rows (op, on, diag, left_status, right_status, tracked, left_action, right_action).

    Adds photo_action for the side the op writes, counter_side and counter_action for a second write to the other
    side. A row that only needs a photo becomes an update of that side, or a refused one where that side was not read.
    Deletions, forgotten and refused rows stay as they are, and so does an untracked row with an unread side: that
    photo is unknown, and recording it as none would overwrite it later.
    """
    listed = lambda s: F.col(f"{s}_status") != "deleted"
    fetched = lambda s: F.col(f"{s}_status").isin("same", "changed")
    acts = lambda s: F.col(f"{s}_action") != "keep"
    unread = (F.col("left_status") == "unchanged") | (F.col("right_status") == "unchanged")
    known = F.coalesce("tracked", F.lit(False)) | ~unread
    op = F.coalesce("op", F.lit("none"))
    writes = op.isin("update", "conflict") & known
    open_row = op.isin("refresh", "none") & F.col("diag").isNull() & known & listed("left") & listed("right")
    to = F.when(open_row & acts("left"), "left").when(open_row & acts("right"), "right")
    blind = F.when(to == "left", ~fetched("left")).when(to == "right", ~fetched("right"))
    by = lambda side, what: F.when(side == "left", F.col(f"left_{what}")).when(side == "right", F.col(f"right_{what}"))
    across = F.when(F.col("on") == "left", "right").when(F.col("on") == "right", "left")
    counter = writes & ((across == "left") & acts("left") & fetched("left") | (across == "right") & acts("right") & fetched("right"))
    return rows.withColumns(
        {
            "photo_action": F.when(writes, by(F.col("on"), "action")).when((op == "resurrect") & known, "copy").when(to.isNotNull() & ~blind, by(to, "action")),
            "counter_side": F.when(counter, across),
            "counter_action": F.when(counter, by(across, "action")),
            "op": F.when(to.isNull(), F.col("op")).when(~blind, "update"),
            "on": F.coalesce(to, "on"),
            "diag": F.when(blind, "unread_target").otherwise(F.col("diag")),
        }
    )


def landed(writes: DataFrame, read: DataFrame) -> DataFrame:
    """The photo state after writes (uid, side, change, left_hash, left_uri, stripped) that may have set a photo on the left.

    *read* (uid, found, kind, uri) are the cards as read back, kind as in ``cards.photo``. Without a row the read-back
    failed: the photo is there, its address unknown. A photo that the server did not keep is recorded as stripped, or it
    would read as removed in the next cycle. A card that is gone right after its write is an error.
    """
    r = read.select("uid", "found", F.col("kind").alias("_kind"), F.col("uri").alias("_uri"))
    j = writes.join(r, "uid", "left")
    back = F.when(F.col("found").isNull(), "inline").when(~F.col("found"), "gone").when(F.col("_kind") == "uri", "uri").when(F.col("_kind").isNotNull(), "inline").otherwise("dropped")
    j = j.withColumn("landed", F.when((F.col("side") == "left") & (F.col("change") == "set"), back))
    kept = ~F.col("landed").eqNullSafe(F.lit("dropped"))
    return j.select(
        "uid",
        "landed",
        F.when(kept, F.col("left_hash")).alias("left_hash"),
        F.when(F.col("landed") == "uri", F.col("_uri")).when(kept, F.col("left_uri")).alias("left_uri"),
        (F.col("stripped") | ~kept).alias("stripped"),
        F.when(F.col("landed") == "gone", "permanent").alias("error"),
    )
