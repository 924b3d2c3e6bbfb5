"""Groups, summaries and reports over plan rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sections of the report in order: (name, title). The titles are ours.
SECTIONS = (
    ("in_sync", "In sync:"),
    ("conflicts", "Conflicts:"),
    ("reuid", "Given the other side's id, same content:"),
    ("by_identity", "Paired by identity:"),
    ("skipped", "Skipped, ambiguous:"),
    ("likely_duplicates", "Likely duplicates, not copied:"),
    ("copies", "To copy:"),
    ("unreadable", "Unreadable:"),
    ("held", "Held:"),
    ("held_deletes", "Held deletes:"),
    ("unmapped_groups", "Groups with unmapped members:"),
    ("synced_duplicates", "Synced records that look like duplicates:"),
    ("photos_stripped", "Photos too large:"),
    ("photos_unavailable", "Photos not fetched:"),
)


def summary(ops: DataFrame) -> DataFrame:
    """One row of counts over ops (op, on, winner, put_left, counter_side).

    A group copy adds on the left and updates on the right; a re-creation updates the right, the left too where the
    card is put there, and counts a conflict against the winner's other side; a counter write is one update.
    """
    op, on = F.col("op"), F.col("on")
    n = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    loser = F.when(F.col("winner") == "left", "right").when(F.col("winner") == "right", "left")
    cols = []
    for s in ("left", "right"):
        added = op.isin("create", "resurrect") & (on == s) | ((op == "copy_group") & F.lit(s == "left"))
        own = (op == "update") & (on == s) | ((op == "copy_group") & F.lit(s == "right"))
        own = own | ((op == "recreate") & (F.lit(s == "right") | F.coalesce("put_left", F.lit(False))))
        counter = F.coalesce(F.col("counter_side") == s, F.lit(False))
        cols += [
            n(added, f"{s}_added"),
            (F.sum(F.when(own, 1).otherwise(0)) + F.sum(F.when(counter, 1).otherwise(0))).alias(f"{s}_updated"),
            n((op == "delete") & (on == s), f"{s}_removed"),
            n(op.isin("conflict", "recreate") & (loser == s), f"{s}_conflicts"),
        ]
    cols += [n(op == "adopt", "adopted"), n(op == "refresh", "refreshed"), n(op == "forget", "forgotten")]
    return ops.agg(*cols)


def target_side(op, on):
    """The side an op writes to; null for one that only touches the state."""
    return F.when(op.isin("create", "update", "resurrect", "delete", "conflict"), on).when(op == "copy_group", "left").when(op == "recreate", "right")


def sections(ops: DataFrame) -> DataFrame:
    """(section, seq, line) of plan rows (seq, op, origin, pass, on, uid)."""
    op = F.col("op")
    section = (
        F.when(op == "adopt", "in_sync")
        .when((op == "conflict") & (F.col("origin") == "baseline"), "conflicts")
        .when((op == "recreate") & (F.col("pass") == "content"), "reuid")
        .when((op == "recreate") & (F.col("pass") == "identity"), "by_identity")
        .when(op.isin("create", "copy_group"), "copies")
    )
    line = F.concat(F.lit("uid="), F.col("uid"), F.when(op.isin("create", "copy_group"), F.concat(F.lit(" to "), F.col("on"))).otherwise(""))
    return ops.withColumn("section", section).filter("section IS NOT NULL").select("section", "seq", line.alias("line"))


def all_sections(ops: DataFrame, skips: DataFrame, diagnostics: DataFrame, unmapped: DataFrame, duplicates: DataFrame, stripped: DataFrame | None = None) -> DataFrame:
    """(section, seq, line) of all sections; seq orders the lines of a section.

    *ops* are plan rows with no_name, *skips* (side, uid, outcome, candidates), *diagnostics* (side, diag, uid, with_uid,
    href), *unmapped* and *stripped* (uid), *duplicates* (uid, like_uid). Lines name uids, sides and hrefs, never a
    contact point.
    """
    op, diag = F.col("op"), F.col("diag")
    uid = lambda *more: F.concat(F.lit("uid="), F.col("uid"), *more)
    wins = F.when(F.col("winner").isNotNull(), F.concat(F.lit(", "), "winner", F.lit(" wins"))).otherwise("")
    copy = op.isin("create", "copy_group")
    section = (
        F.when(op == "adopt", "in_sync").when((op == "conflict") & (F.col("origin") == "baseline"), "conflicts")
        .when((op == "recreate") & (F.col("pass") == "content"), "reuid").when((op == "recreate") & (F.col("pass") == "identity"), "by_identity").when(copy, "copies")
    )
    bare = F.when(F.col("no_name"), " (no name to match on)").otherwise("")
    parts = [
        ops.select(section.alias("section"), F.concat_ws("/", "stage", F.lpad(F.coalesce("ord", F.lit(0)).cast("string"), 20, "0"), "uid").alias("seq"), F.when(copy, uid(F.lit(" to "), F.col("on"), bare)).otherwise(uid(wins)).alias("line")),
        skips.select(
            F.when(F.col("outcome") == "likely_duplicate", "likely_duplicates").otherwise("skipped").alias("section"), F.concat_ws("/", "side", "uid").alias("seq"),
            F.concat("side", F.lit(" "), uid(F.lit(", candidates "), F.col("candidates").cast("string"))).alias("line"),
        ),
        diagnostics.select(
            F.when(diag == "unreadable", "unreadable").when(diag.isin("duplicate_uid", "uid_changed"), "held").when(diag == "delete_held", "held_deletes").when(diag == "photo_unavailable", "photos_unavailable").alias("section"),
            F.concat_ws("/", "side", "uid", "href").alias("seq"),
            F.concat_ws(" ", "side", "diag", F.when(F.col("uid").isNotNull(), uid()), F.when(F.col("with_uid").isNotNull(), F.concat(F.lit("with uid="), F.col("with_uid"))), "href").alias("line"),
        ),
        unmapped.select(F.lit("unmapped_groups").alias("section"), F.col("uid").alias("seq"), uid(F.lit(" to left")).alias("line")),
        duplicates.select(F.lit("synced_duplicates").alias("section"), F.col("uid").alias("seq"), uid(F.lit(" like uid="), F.col("like_uid")).alias("line")),
    ]
    if stripped is not None:
        parts.append(stripped.select(F.lit("photos_stripped").alias("section"), F.col("uid").alias("seq"), uid(F.lit(" to left")).alias("line")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter("section IS NOT NULL")


def known_after(known: DataFrame, ops: DataFrame) -> DataFrame:
    """(uid) of *known* and what ops (stage, ord, uid, op, on) add on the left, without what they delete or forget; the
    last op of a uid decides."""
    op = F.col("op")
    change = F.when(op.isin("create", "resurrect") & (F.col("on") == "left") | (op == "copy_group"), True).when(op.isin("delete", "forget"), False)
    last = ops.withColumn("_there", change).filter("_there IS NOT NULL").groupBy("uid").agg(F.max_by("_there", F.struct("stage", "ord")).alias("_there"))
    both = known.select("uid", F.lit(True).alias("_there"), F.lit(0).alias("_late")).unionByName(last.select("uid", "_there", F.lit(1).alias("_late")))
    return both.groupBy("uid").agg(F.max_by("_there", "_late").alias("_there")).filter("_there").select("uid")


def error_counts(failed: DataFrame, diagnostics: DataFrame, skips: DataFrame) -> DataFrame:
    """One row: errors of failed ops (op, on) by the side they write to, those of state-only ops apart; what diagnostics
    (side, diag) add to the other side's; deferred rows, held deletes and skips."""
    n = lambda cond, name: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).alias(name)
    to, diag = target_side(F.col("op"), F.col("on")), F.col("diag")
    own = failed.agg(n(to == "left", "l"), n(to == "right", "r"), n(to.isNull(), "state_errors"))
    broken = diag.isin("unreadable", "duplicate_uid", "uid_changed", "photo_unavailable")
    said = diagnostics.agg(n(broken & (F.col("side") == "right"), "dl"), n(broken & (F.col("side") == "left"), "dr"), n(diag.isin("unread_target", "deletion_deferred"), "deferred"), n(diag == "delete_held", "held_deletes"))
    left_out = skips.agg(F.count(F.lit(1)).alias("skipped"))
    out = own.crossJoin(said).crossJoin(left_out)  # one row each
    return out.select((F.col("l") + F.col("dl")).alias("left_errors"), (F.col("r") + F.col("dr")).alias("right_errors"), "state_errors", "deferred", "held_deletes", "skipped")


def fetched_counts(entries: DataFrame) -> DataFrame:
    """One row: cards read per direction, from entries (side, kind); a card read on the left counts to the right."""
    n = lambda s: F.coalesce(F.sum(F.when((F.col("side") == s) & F.col("kind").isin("fetched", "unreadable"), 1).otherwise(0)), F.lit(0))
    return entries.agg(n("right").alias("left_fetched"), n("left").alias("right_fetched"))


def held_delete_uids(diagnostics: DataFrame) -> DataFrame:
    """The uids whose deletes a cycle held or deferred; the next one doesn't wait for them."""
    return diagnostics.filter(F.col("diag").isin("delete_held", "deletion_deferred")).select("uid").distinct()


def log_lines(ops: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(stage, ord, uid, level, line): a line per op that wrote something or failed, of uids, sides, ops and reasons only."""
    to = target_side(F.col("op"), F.col("on"))
    j = ops.join(outcomes.select("uid", "reason"), "uid", "left")
    direction = F.when(to == "left", "right to left").when(to == "right", "left to right")
    failed = F.col("reason").isNotNull()
    line = F.when(failed, F.concat(F.lit("sync failed uid="), F.col("uid"), F.lit(" reason="), F.col("reason"))).when(to.isNotNull(), F.concat(F.lit("synced uid="), F.col("uid"), F.lit(" op="), F.col("op"), F.lit(" direction="), direction))
    return j.select("stage", "ord", "uid", F.when(failed, "warn").otherwise("info").alias("level"), line.alias("line")).filter("line IS NOT NULL")


def skip_lines(skips: DataFrame) -> DataFrame:
    """(side, uid, level, line): a warning per skipped card (side, uid, outcome, candidates), without names or contact points."""
    line = F.format_string("skipped uid=%s side=%s outcome=%s candidates=%d", "uid", "side", "outcome", "candidates")
    return skips.select("side", "uid", F.lit("warn").alias("level"), line.alias("line"))


def report_lines(lines: DataFrame) -> DataFrame:
    """(part, seq, line) of the whole report, to be sorted by (part, seq): a line of counts, then each section that has
    lines under its title."""
    spark = lines.sparkSession
    titles = spark.createDataFrame([(i + 1, name, title) for i, (name, title) in enumerate(SECTIONS)], "part int, section string, title string")
    counts = titles.join(lines.groupBy("section").agg(F.count(F.lit(1)).alias("n")), "section", "left")  # 14 rows
    seq = lines.schema["seq"].dataType
    heads = counts.filter("n > 0").select("part", F.lit(None).cast(seq).alias("seq"), F.col("title").alias("line"))
    first = counts.filter("part <= 7").agg(F.array_sort(F.collect_list(F.struct("part", F.format_string("%s %d", "section", F.coalesce("n", F.lit(0))).alias("text")))).alias("x"))
    first = first.select(F.lit(0).alias("part"), F.lit(None).cast(seq).alias("seq"), F.array_join("x.text", ", ").alias("line"))
    body = lines.join(titles, "section").select("part", "seq", F.concat(F.lit("  "), "line").alias("line"))
    return first.unionByName(heads).unionByName(body)


def write_report(lines: DataFrame, path: str) -> None:
    """The report as text files in order; nothing of it passes through the driver."""
    report_lines(lines).sort("part", F.col("seq").asc_nulls_first()).select("line").write.mode("overwrite").text(path)


def relink_aliases(recreated: DataFrame, replayed: DataFrame) -> DataFrame:
    """(old_uid, uid): pairs of this cycle before replayed ones."""
    both = recreated.select("old_uid", "uid", F.lit(0).alias("p")).unionByName(replayed.select("old_uid", "uid", F.lit(1).alias("p")))
    return both.groupBy("old_uid").agg(F.min_by("uid", "p").alias("uid"))


def relink_groups(groups: DataFrame, aliases: DataFrame) -> DataFrame:
    """Groups (id, members) that list an old uid: how many member lines change; all other groups have 0."""
    hits = groups.select("id", F.explode("members").alias("old_uid")).join(aliases.select("old_uid"), "old_uid").groupBy("id").agg(F.count(F.lit(1)).alias("relinked"))
    return groups.select("id").join(hits, "id", "left").select("id", F.coalesce("relinked", F.lit(0)).alias("relinked"))


def unmapped_members(groups: DataFrame, known: DataFrame) -> DataFrame:
    """Groups (id, members) that list a uid which *known* (uid) lacks, with how many such members."""
    each = groups.select("id", F.explode("members").alias("uid")).distinct()
    return each.join(known.select("uid").distinct(), "uid", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("unmapped"))
