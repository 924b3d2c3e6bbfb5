"""Manifests: which folders make up the current state of a table set, switched in one step.

A manifest is a small JSON file below ``<path>/manifests``, named by its number. Data folders have names of their own
(``new_folder``) that no other writer uses, so nothing that is committed is ever overwritten; a folder counts once a
manifest lists it. A manifest is written aside and renamed to the next number, which fails where another writer was
faster. Only the newest manifest is read by the driver; it names folders, never rows.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession


class Moved(RuntimeError):
    """Another writer committed first."""


class Manifests:
    """Numbered manifests below *path*, on any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def number(self) -> int | None:
        """The newest manifest's number."""
        fs, at = self._fs(), self._at(f"{self.path}/manifests")
        if not fs.exists(at):
            return None
        return max((int(name) for s in fs.listStatus(at) if (name := s.getPath().getName()).isdigit()), default=None)

    def read(self, number: int | None = None) -> dict | None:
        """The manifest of that number, by default the newest; None where there is none."""
        number = self.number() if number is None else number
        at = None if number is None else self._at(f"{self.path}/manifests/{number}")
        fs = self._fs()
        if at is None or not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, content: dict, after: int | None) -> int:
        """Make *content* the manifest that follows number *after*; raises Moved where another one does already."""
        new = (after or 0) + 1
        fs = self._fs()
        aside, to = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._at(f"{self.path}/manifests/{new}")
        if self.number() != after:
            raise Moved(f"state moved on from version {after}")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(to), none)  # atomic, and refused where the number is taken
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(to):
                raise Moved(f"state moved on from version {after}") from e
            raise
        return new

    def new_folder(self, name: str) -> str:
        """A folder path that no other writer uses."""
        return f"{self.path}/{name}-{uuid.uuid4().hex}"

    def there(self, folders: list[str]) -> bool:
        """Whether all *folders* exist."""
        fs = self._fs()
        return all(fs.exists(self._at(f)) for f in folders)

    def pin(self, number: int) -> str:
        """Mark a manifest as being read; what it lists is spared until ``unpin``."""
        at = f"{self.path}/pins/{number}-{uuid.uuid4().hex}"
        self._fs().create(self._at(at), False).close()
        return at

    def unpin(self, pin: str) -> None:
        self._fs().delete(self._at(pin), False)

    def pinned(self, max_age: float) -> set[int]:
        """Manifests that are being read; pins older than *max_age* seconds, of readers that died, are taken away."""
        fs, at = self._fs(), self._at(f"{self.path}/pins")
        found = set()
        for s in fs.listStatus(at) if fs.exists(at) else []:
            if s.getModificationTime() < (time.time() - max_age) * 1000:
                fs.delete(s.getPath(), False)
            else:
                found.add(int(s.getPath().getName().split("-")[0]))
        return found

    def drop(self, folders: list[str]) -> None:
        """Delete folders that no manifest lists any more."""
        fs = self._fs()
        for folder in folders:
            fs.delete(self._at(folder), True)
