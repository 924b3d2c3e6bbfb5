"""The state store: parquet tables under versions, and the relational operations on them.

A commit writes the tables it is given to folders of their own and then adds a manifest that lists every table's
folders, so readers see all of it or none. Tables a commit doesn't name are carried forward by reference, and a writer
that is refused leaves nothing that anyone reads.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.manifests import Manifests, Moved

__all__ = ["Moved", "Pinned", "Repeated", "StateStore"]
#: Tables that a reset keeps: the conflict history and the journal.
KEPT = ("conflicts", "pending")


class Repeated(ValueError):
    """A commit would have given two rows one key."""


class StateStore:
    """Tables below *path*; the newest manifest says which folders they consist of."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, self.path)

    def version(self) -> int | None:
        """The committed version."""
        return self.manifests.number()

    def _content(self, version: int | None) -> dict:
        found = None if version is None else self.manifests.read(version)
        return found or {"tables": {}, "meta": {}}

    def meta(self, version: int | None = None) -> dict:
        """Small facts committed with the tables, such as the last batch number."""
        return self._content(self.version() if version is None else version)["meta"]

    def folders(self, name: str, version: int | None = None) -> list[str]:
        return self._content(self.version() if version is None else version)["tables"].get(name, [])

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version, by default the newest; None where it has none."""
        found = self.folders(name, version)
        return self.spark.read.parquet(*found) if found else None

    def readable(self, version: int) -> bool:
        """Whether all folders of a version are still there."""
        content = self.manifests.read(version)
        return content is not None and self.manifests.there([f for folders in content["tables"].values() for f in folders])

    def commit(
        self, tables: dict[str, DataFrame], expect: int | None, append: dict[str, DataFrame] | None = None, drop: Iterable[str] = (), meta: dict | None = None, unique: dict[str, list[list[str]]] | None = None
    ) -> int:
        """The next version: *tables* replaced, *append* added to, *drop* left out, all others as they were.

        Refuses (Moved) if another commit came after *expect*; the other one's tables stay untouched. *unique* names the
        keys of written tables; two rows with the same values, nulls aside, are refused (Repeated) and the version stays.
        """
        before = self._content(expect)
        now = {name: folders for name, folders in before["tables"].items() if name not in set(drop)}
        for name, df in tables.items():
            now[name] = [self._write(name, df)]
        for name, df in (append or {}).items():
            now[name] = [*now.get(name, []), self._write(name, df)]
        for name, keys in (unique or {}).items():
            for key in keys if name in tables else []:
                twice = require_unique(self.spark.read.parquet(*now[name]).dropna(subset=key), key)
                if not twice.isEmpty():
                    self.manifests.drop(now[name])
                    raise Repeated(f"{name}: {', '.join(key)}")
        return self.manifests.commit({"tables": now, "meta": before["meta"] | (meta or {})}, expect)

    def _write(self, name: str, df: DataFrame) -> str:
        folder = self.manifests.new_folder(name)
        df.write.parquet(folder)
        return folder

    def reset(self, keep: tuple[str, ...] = KEPT) -> int | None:
        """Forget all tables but the history and the journal, and all facts."""
        now = self.version()
        if now is None:
            return None
        held = {name: folders for name, folders in self._content(now)["tables"].items() if name in keep}
        return self.manifests.commit({"tables": held, "meta": {}}, now)

    def pin(self, version: int | None = None) -> Pinned:
        """A handle on one version, by default the newest: all its tables are of that version while others commit and vacuum."""
        return Pinned(self, self.version() if version is None else version)

    def vacuum(self, last: int = 2, max_age: float = 7 * 86_400) -> list[str]:
        """Delete what only manifests before the newest *last* list that no reader has pinned (less than *max_age* seconds
        ago); folders of a commit under way are in none."""
        now = self.version() or 0
        listed = lambda n: {f for folders in self._content(n)["tables"].values() for f in folders}
        spared = self.manifests.pinned(max_age) | set(range(max(1, now - last + 1), now + 1))
        live = set().union(*(listed(n) for n in spared))
        old = set().union(*(listed(n) for n in range(1, now + 1) if n not in spared)) - live
        self.manifests.drop(sorted(old))
        return sorted(old)


class Pinned:
    """One version of a store for reading; as a context manager it lets go at the end."""

    def __init__(self, store: StateStore, version: int | None) -> None:
        self.store, self.version = store, version
        self._pin = None if version is None else store.manifests.pin(version)
        if version is not None and not store.readable(version):  # vacuumed before the pin was set
            self.release()
            raise Moved(f"version {version} is gone")

    def tables(self) -> list[str]:
        return sorted(self.store._content(self.version)["tables"])

    def read(self, name: str) -> DataFrame | None:
        return None if self.version is None else self.store.read(name, self.version)

    def meta(self) -> dict:
        return self.store._content(self.version)["meta"]

    def release(self) -> None:
        if self._pin:
            self.store.manifests.unpin(self._pin)
            self._pin = None

    def __enter__(self) -> Pinned:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def require_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows of *key* values that occur more than once; empty for a good table."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def upsert(stored: DataFrame, changes: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Insert or update by *key*: given fields replace, nulls keep what is stored, the version counts up on a change."""
    c = changes.select(*key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_hit"))
    j = stored.join(c, key, "full_outer")
    new = {f: F.coalesce(f"_{f}", f) for f in fields}
    moved = F.lit(False)
    for f in fields:
        moved = moved | ~new[f].eqNullSafe(F.col(f))
    version = F.when(F.col("version").isNull(), 1).otherwise(F.col("version") + F.when(F.col("_hit") & moved, 1).otherwise(0))
    return j.select(*key, version.cast("long").alias("version"), *[e.alias(f) for f, e in new.items()])


def update_versioned(stored: DataFrame, updates: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Optimistic updates (id, version, fields): (new table, refused updates with reason conflict or not_found)."""
    u = updates.select("id", F.col("version").alias("_version"), *[F.col(f).alias(f"_{f}") for f in fields])
    j = stored.join(u, "id", "left")
    hit = F.col("_version") == F.col("version")
    new = j.select("id", F.when(hit, F.col("version") + 1).otherwise(F.col("version")).alias("version"), *[F.when(hit, F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields])
    known = stored.select("id", F.col("version").alias("stored_version"))
    refused = updates.select("id", "version").join(known, "id", "left").filter("stored_version IS NULL OR stored_version <> version")
    return new, refused.select("id", F.when(F.col("stored_version").isNull(), "not_found").otherwise("conflict").alias("reason"))


def last_seen(stored: DataFrame, seen: DataFrame, key: str, column: str) -> DataFrame:
    """*column* moves forward to what *seen* has, never back; no version changes."""
    s = seen.groupBy(key).agg(F.max(column).alias("_seen"))
    return stored.join(s, key, "left").withColumn(column, F.greatest(column, "_seen")).drop("_seen")


def replace(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Delete by key, then insert: journal and skip upserts."""
    return stored.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def endpoint_upsert(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Endpoints (side, url, host, token): another url clears the token, another host alone keeps it."""
    f = found.select("side", F.col("url").alias("_url"), F.col("host").alias("_host"))
    j = stored.join(f, "side", "full_outer")
    return j.select("side", F.coalesce("_url", "url").alias("url"), F.coalesce("_host", "host").alias("host"), F.when(F.col("_url").isNull() | F.col("url").eqNullSafe(F.col("_url")), F.col("token")).alias("token"))


def replay_journal(pending: DataFrame, listed: DataFrame) -> DataFrame:
    """What becomes of interrupted re-creations (id, uid, left_href, old_right_href, new_right_href, ...).

    alias: the old record is gone, so its uid now means the new one; action: done (the old record is still there or the
    new one is listed), put (neither is, but the left card is: write the saved card again) or drop.
    """
    flag = lambda side, col: listed.filter(F.col("side") == side).select(F.col("href").alias(col), F.lit(True).alias(f"has_{col}"))
    out = pending.join(flag("left", "left_href"), "left_href", "left").join(flag("right", "old_right_href"), "old_right_href", "left").join(flag("right", "new_right_href"), "new_right_href", "left")
    gone = F.col("has_old_right_href").isNull()
    return out.select(
        "id",
        "uid",
        gone.alias("alias"),
        F.when(~gone | F.col("has_new_right_href").isNotNull(), "done").when(F.col("has_left_href").isNotNull(), "put").otherwise("drop").alias("action"),
    )


def delete_rows(stored: DataFrame, keys: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Delete by key: (what stays, per wanted key whether it was found)."""
    asked = keys.select(*key).distinct()
    here = stored.select(*key).distinct().withColumn("found", F.lit(True))
    return stored.join(asked, key, "left_anti"), asked.join(here, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def newest_first(history: DataFrame, uid: Column | None = None) -> DataFrame:
    """Conflicts, the newest (greatest id) first; of one uid where it is given."""
    return (history if uid is None else history.filter(F.col("uid") == uid)).sort(F.desc("id"))


def in_order(table: DataFrame) -> DataFrame:
    """A whole table by ascending id, as every scan of the state returns it."""
    return table.sort("id")


def lookup(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Point lookups: per wanted key the stored row, or nulls and found = false."""
    rest = [c for c in table.columns if c not in key]
    return keys.select(*key).distinct().join(table.select(*key, *rest, F.lit(True).alias("found")), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def set_token(stored: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Endpoints (side, version, token, ...) with new tokens (side, token): (new table, outcome per wanted side).

    A side that was never discovered is not_found; an equal token is no write and keeps the version.
    """
    new = tokens.select("side", F.col("token").alias("_token"), F.lit(True).alias("_hit"))
    j = stored.join(new, "side", "left")
    moved = F.coalesce("_hit", F.lit(False)) & ~F.col("_token").eqNullSafe(F.col("token"))
    table = j.select("side", *[F.when(moved, F.col("_token")).otherwise(F.col("token")).alias("token") if c == "token" else (F.col("version") + moved.cast("long")).alias("version") if c == "version" else F.col(c) for c in stored.columns if c != "side"])
    known = stored.select("side", F.col("token").alias("_old"), F.lit(True).alias("_known"))
    told = tokens.join(known, "side", "left").select("side", F.when(F.col("_known").isNull(), "not_found").when(F.col("token").eqNullSafe(F.col("_old")), "unchanged").otherwise("written").alias("outcome"))
    return table, told


def drop_row(contacts: DataFrame, failures: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop the rows of *gone* (uid) and clear their failures: (contacts, failures)."""
    uids = gone.select("uid").distinct()
    return contacts.join(uids, "uid", "left_anti"), failures.join(uids, "uid", "left_anti")


#: What a stored column must look like to be read: table -> (column, SQL condition). Null columns are judged like others.
DECODE = {
    "contacts": (
        ("version", "version >= 0"), ("hash_version", "hash_version >= 0"), ("content_hash", "content_hash RLIKE '^[0-9a-fA-F]{64}$'"),
        ("left_photo_hash", "left_photo_hash IS NULL OR left_photo_hash RLIKE '^[0-9a-fA-F]{64}$'"), ("right_photo_hash", "right_photo_hash IS NULL OR right_photo_hash RLIKE '^[0-9a-fA-F]{64}$'"),
    ),
    "failures": (("side", "side IN ('left', 'right')"), ("op", "op IN ('read', 'create', 'update', 'delete')"), ("attempts", "attempts >= 1")),
    "skips": (("side", "side IN ('left', 'right')"), ("content_hash", "content_hash RLIKE '^[0-9a-fA-F]{64}$'"), ("hash_version", "hash_version >= 0"), ("candidate_count", "candidate_count >= 0")),
    "conflicts": (("origin", "origin IN ('sync', 'baseline')"), ("winner", "winner IN ('left', 'right')")),
    "endpoints": (("side", "side IN ('left', 'right')"), ("url", "url IS NOT NULL AND url <> ''")),
}


def decode(rows: DataFrame, table: str) -> DataFrame:
    """Add ``corrupt``, the first column of a row that can't be what the store wrote; null for a good row."""
    checks = [F.when(~F.coalesce(F.expr(cond), F.lit(False)), F.lit(col)) for col, cond in DECODE[table]]
    return rows.withColumn("corrupt", F.coalesce(*checks))
