"""Paged sources of records as Python data sources: plain pages, and recorded works with pruned pages."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, StringContains, WriterCommitMessage


class PagedSource(DataSource):
    """``spark.read.format("paged").option("path", ...)``: JSON pages ``{"items": [...]}``, one partition a page.

    ``path`` names a folder of page files; a remote transport subclasses ``PagedReader.fetch``.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "json string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.count = options["path"], int(options.get("pages", "1"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.count)]

    def fetch(self, page: int) -> dict:
        with open(f"{self.path}/page-{page}.json", encoding="utf-8") as f:
            return json.load(f)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for item in self.fetch(partition.value).get("items", []):
            yield (json.dumps(item),)


#: Columns of recorded works. ``authors`` is ``|orcid|orcid|``, ``words`` the normalized title between blanks.
WORKS_SCHEMA = "id string, published string, authors string, words string, json string"
_AUTHOR, _WORD = re.compile(r"^\|([^|]+)\|$"), re.compile(r"^ (\S+) $")


class Terms:
    """Words that a page may hold, as bits: no word of the page is missed, others pass now and then."""

    HASHES, BITS = 7, 10

    def __init__(self, bits: bytes):
        self.bits = bits

    @staticmethod
    def places(word: str, n: int) -> list[int]:
        d = hashlib.blake2b(word.encode(), digest_size=16).digest()
        a, b = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1
        return [(a + i * b) % n for i in range(Terms.HASHES)]

    @classmethod
    def of(cls, words: set[str]) -> Terms:
        held = bytearray((max(64, cls.BITS * len(words)) + 7) // 8)
        for w in words:
            for at in cls.places(w, 8 * len(held)):
                held[at >> 3] |= 1 << (at & 7)
        return cls(bytes(held))

    def may_hold(self, word: str) -> bool:
        return all(self.bits[at >> 3] >> (at & 7) & 1 for at in self.places(word, 8 * len(self.bits)))


@dataclass
class Narrowed:
    """What a read is narrowed to, for choosing pages; rows are filtered by Spark all the same."""

    ids: frozenset[str] | None = None
    terms: tuple[str, ...] = ()
    since: str | None = None

    def wants(self, head: dict) -> bool:
        if self.ids is not None and not any(head["least"] <= i <= head["most"] for i in self.ids):
            return False
        if self.since is not None and head["last"] < self.since:
            return False
        bits = Terms(base64.b64decode(head["terms"])) if self.terms else None
        return all(bits.may_hold(t) for t in self.terms)


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(path: str, name: str, data: bytes) -> None:
    """A file that is there whole or not at all, where moving a file is atomic."""
    files, at = _files(path)
    files.create_dir(at, recursive=True)
    aside = f"{at}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(aside) as f:
        f.write(data)
    files.move(aside, f"{at}/{name}")


def _get(path: str, name: str) -> bytes:
    files, at = _files(path)
    with files.open_input_stream(f"{at}/{name}") as f:
        return f.read()


class WorksSource(DataSource):
    """``format("works")``: works in recorded pages under ``path``, read by id, author, title word or date.

    A part is a file of pages, each a line of JSON as a paged interface answers, and a file of heads, one a page:
    where it lies, its ids, its last date and the bits of its authors and title words. ``catalog.json`` names
    the parts of the last write that was committed. Options: ``path``; ``page_size`` (100); ``range_pages`` (64),
    pages of a partition; ``id``, ``author``, ``word``, ``since`` narrow a read as filters do.

    With ``filters`` ``pushed``, which needs ``spark.sql.python.filterPushdown.enabled``, filters are pushed down: equality and ``IN`` of
    ``id``; ``authors`` containing ``|orcid|``; ``words`` containing a word between blanks; ``published`` from a date on.
    """

    @classmethod
    def name(cls) -> str:
        return "works"

    def schema(self) -> str:
        return WORKS_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushedWorksReader if self.options.get("filters") == "pushed" else WorksReader)(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WorksWriter(self.options, overwrite)


class WorksReader(DataSourceReader):
    """A partition is a part and a range of its pages: a task that is lost starts again at its own first page."""

    def __init__(self, options: dict):
        self.path, self.range_pages = options["path"], int(options.get("range_pages", "64"))
        ids = frozenset(x for x in options.get("id", "").split(",") if x)
        terms = [f"|{options['author']}"] if options.get("author") else []
        self.narrowed = Narrowed(ids or None, (*terms, *options.get("word", "").split()), options.get("since"))

    def partitions(self) -> list[InputPartition]:
        parts = json.loads(_get(self.path, "catalog.json"))["parts"]
        near = [p for p in parts if self.narrowed.ids is None or any(p["least"] <= i <= p["most"] for i in self.narrowed.ids)]
        return [InputPartition((p["name"], at, min(at + self.range_pages, p["pages"]))) for p in near for at in range(0, p["pages"], self.range_pages)]

    def fetch(self, part: str, head: dict) -> dict:
        """One page, by its place in the part; a remote transport overrides this."""
        files, at = _files(self.path)
        with files.open_input_file(f"{at}/{part}.pages") as f:
            f.seek(head["at"])
            return json.loads(f.read(head["bytes"]))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        part, first, last = partition.value
        for line in _get(self.path, f"{part}.heads").splitlines()[first:last]:
            head = json.loads(line)
            if self.narrowed.wants(head):
                for r in self.fetch(part, head)["results"]:
                    yield (r["id"], r["published"], r["authors"], r["words"], r["json"])


class PushedWorksReader(WorksReader):
    """Also narrowed by the filters of the query, where the session pushes them down."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        now = self.narrowed
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "id" and isinstance(f, (EqualTo, In)):
                asked = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                now.ids = asked if now.ids is None else now.ids & asked
            elif column == "authors" and isinstance(f, StringContains) and (m := _AUTHOR.match(f.value)):
                now.terms += (f"|{m[1]}",)
            elif column == "words" and isinstance(f, StringContains) and (m := _WORD.match(f.value)):
                now.terms += (m[1],)
            elif column == "published" and isinstance(f, GreaterThanOrEqual):
                now.since = f.value if now.since is None else max(now.since, f.value)
            # pages hold other rows too, so that Spark still looks at each
            yield f


@dataclass
class Part(WriterCommitMessage):
    name: str
    pages: int
    least: str
    most: str


class WorksWriter(DataSourceWriter):
    """Each task writes a part of its own; only parts of tasks that were committed enter the catalog."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.size, self.overwrite = options["path"], int(options.get("page_size", "100")), overwrite

    def write(self, rows: Iterator) -> Part:
        name, heads, page, at = uuid.uuid4().hex, [], [], 0
        files, root = _files(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{name}.pages") as out:

            def end_page() -> None:
                nonlocal page, at
                data = (json.dumps({"results": page, "meta": {"cursor": len(heads)}}, ensure_ascii=False) + "\n").encode()
                terms = {w for r in page for w in (r["words"] or "").split()} | {f"|{a}" for r in page for a in (r["authors"] or "").split("|") if a}
                ids = [r["id"] or "" for r in page]
                heads.append({"at": at, "bytes": len(data), "least": min(ids), "most": max(ids), "last": max(r["published"] or "" for r in page),
                    "terms": base64.b64encode(Terms.of(terms).bits).decode()})
                out.write(data)
                page, at = [], at + len(data)

            for row in rows:
                page.append(row.asDict())
                if len(page) == self.size:
                    end_page()
            if page:
                end_page()
        _put(self.path, f"{name}.heads", "".join(json.dumps(h) + "\n" for h in heads).encode())
        return Part(name, len(heads), min((h["least"] for h in heads), default=""), max((h["most"] for h in heads), default=""))

    def commit(self, messages: list[Part | None]) -> None:
        parts = [] if self.overwrite else self._before()
        parts += [vars(m) for m in messages if m is not None and m.pages]
        _put(self.path, "catalog.json", json.dumps({"parts": parts}).encode())

    def _before(self) -> list[dict]:
        try:
            return json.loads(_get(self.path, "catalog.json"))["parts"]
        except FileNotFoundError:
            return []

    def abort(self, messages: list[Part | None]) -> None:
        files, root = _files(self.path)
        for m in messages:
            if m is not None:
                for end in ("pages", "heads"):
                    files.delete_file(f"{root}/{m.name}.{end}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
    spark.dataSource.register(WorksSource)


def read_works(spark: SparkSession, path: str, **narrow: str) -> DataFrame:
    """Recorded works of ``path``; ``narrow`` (id, author, word, since) chooses pages, the caller's filters choose rows."""
    register(spark)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true":
        narrow["filters"] = "pushed"
    return spark.read.format("works").option("path", path).options(**{k: v for k, v in narrow.items() if v}).load()


def record_works(works: DataFrame, path: str, page_size: int = 100) -> None:
    """Record ``works`` (columns of WORKS_SCHEMA) as pages, sorted by id so that a page holds a range of them."""
    register(works.sparkSession)
    columns = [c.split()[0] for c in WORKS_SCHEMA.split(", ")]
    works.select(*columns).repartitionByRange("id").sortWithinPartitions("id").write.format("works").option("path", path).option("page_size",
        str(page_size)).mode("overwrite").save()
