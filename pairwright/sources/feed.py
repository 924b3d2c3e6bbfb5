"""Recorded change feeds as a Spark data source: batch listing, a stream whose offset is the sync token, and a writer.

A feed is a folder of JSON pages, one answer of a server each: ``token`` is what the page leads to, ``after`` the token it
answers (null: a full listing), ``members`` its rows (href, status, etag). ``more`` says that the server cut the answer
short (507), so that the page after its token follows. A server that no longer knows a token has no page for it.

    spark.dataSource.register(FeedSource)
    spark.read.format("pairwright_feed").load(path)            # a full listing, then all changes
    spark.readStream.format("pairwright_feed").load(path)      # from the stored token on
    df.write.format("pairwright_feed").mode("append").save(path)   # one more page: all of it or nothing

Rows are (page, ord, href, status, etag, restart), as ``cdc.latest_changes`` takes them; ``restart`` marks rows of a full
listing, which replaces what was known before. Paths may be of any file system that Arrow opens.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "page long, ord long, href string, status int, etag string, restart boolean"
#: Pages that one micro-batch reads at most; the others follow in the next.
PAGES = 100


def _files(path: str):
    from pyarrow import fs

    found, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return found, base.rstrip("/")


class Feed:
    """The pages of a folder by the token they answer; of several for one token the first by file name counts."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.files, base = _files(path)
        self.pages: list[dict] = []
        infos = self.files.get_file_info(fs.FileSelector(base, allow_not_found=True))
        for info in sorted(infos, key=lambda x: x.path):
            if info.is_file and info.base_name.endswith(".json") and not info.base_name.startswith((".", "_")):
                with self.files.open_input_stream(info.path) as f:
                    page = json.loads(f.read())
                self.pages.append({"file": info.path, "token": page["token"], "after": page.get("after"), "more": bool(page.get("more")), "n": len(self.pages)})
        self.after: dict[str | None, dict] = {}
        self.full = None
        for p in self.pages:
            if p["after"] is None:
                self.full = p  # the newest full listing
            else:
                self.after.setdefault(p["after"], p)

    def chain(self, token: str | None, limit: int = PAGES) -> list[dict]:
        """The pages that follow *token*, at most *limit*. A token that the server doesn't know any more, or none, starts with a
        full listing."""
        known = token is not None and (token in self.after or any(p["token"] == token for p in self.pages))
        out, seen = [], set()
        page = self.after.get(token) if known else self.full
        while page is not None and len(out) < limit and page["n"] not in seen:
            seen.add(page["n"])
            out.append(page)
            page = self.after.get(page["token"])
        return out


@dataclass
class Page(InputPartition):
    file: str
    n: int
    restart: bool


def _rows(path: str, page: Page) -> Iterator[tuple]:
    files, _ = _files(path)
    with files.open_input_stream(page.file) as f:
        members = json.loads(f.read()).get("members", [])
    for i, m in enumerate(members):
        yield page.n, i, m["href"], m.get("status", 200), m.get("etag"), page.restart


class _Batch(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Page]:
        return [Page(p["file"], p["n"], p["after"] is None) for p in Feed(self.path).chain(None, 10**9)]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from _rows(self.path, partition)


class _Stream(DataSourceStreamReader):
    """Offsets are {"token": t, "pages": how many pages of the chain after the batch's start lead to t}."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.token: str | None = None

    def initialOffset(self) -> dict:
        return {"token": None}

    def latestOffset(self) -> dict:
        chain = Feed(self.path).chain(self.token)
        self.token = chain[-1]["token"] if chain else self.token
        return {"token": self.token}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.token = end["token"]
        out = []
        for p in Feed(self.path).chain(start["token"]) if start != end else []:
            out.append(Page(p["file"], p["n"], p["after"] is None))
            if p["token"] == end["token"]:
                break
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from _rows(self.path, partition)


@dataclass
class Part(WriterCommitMessage):
    file: str
    rows: int


class _Writer(DataSourceWriter):
    """Tasks write their members aside; the commit gathers the names of their files into one page that follows the last."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.names, self.run = path, schema.fieldNames(), uuid.uuid4().hex

    def write(self, rows: Iterator) -> Part:
        files, base = _files(self.path)
        aside = f"{base}/_parts-{self.run}"
        files.create_dir(aside, recursive=True)
        at, n = f"{aside}/{uuid.uuid4().hex}", 0
        with files.open_output_stream(at) as f:
            for r in rows:
                row = dict(zip(self.names, r, strict=True))
                f.write((json.dumps({"href": row["href"], "status": row.get("status", 200), "etag": row.get("etag")}) + "\n").encode())
                n += 1
        return Part(at, n)

    def commit(self, messages: list) -> None:
        files, base = _files(self.path)
        pages = Feed(self.path).pages
        last = pages[-1]["token"] if pages else None
        token = f"{self.run}"
        at = f"{base}/_page-{self.run}"
        with files.open_output_stream(at) as out:  # one part at a time passes through the driver
            out.write(f'{{"token": {json.dumps(token)}, "after": {json.dumps(last)}, "members": ['.encode())
            first = True
            for m in messages:
                if m is None:
                    continue
                with files.open_input_stream(m.file) as f:
                    for line in f.read().splitlines():
                        out.write((b"" if first else b",") + line)
                        first = False
            out.write(b"]}")
        files.move(at, f"{base}/{len(pages):012d}-{self.run}.json")
        self._forget(files, base)

    def abort(self, messages: list) -> None:
        self._forget(*_files(self.path))

    def _forget(self, files, base: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{base}/_parts-{self.run}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/_parts-{self.run}")


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pairwright_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a feed only grows")
        return _Writer(self.options["path"], schema)
