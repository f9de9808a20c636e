"""A data source of documents' pages: each task reads a range of pages of one file.

`spark.read.format(...)` gives a row for every page and one for every file
(page_number null) with its checksum, page count and metadata. Files that a
filter on filename, document_id or path leaves out are not opened. A library for
some kind of document is plugged in as an `Opener`.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..errors import IngestionError

#: The metadata keys that a scan reports, each null where it is absent or can't be read.
METADATA_KEYS = ("title", "author", "subject", "creator", "producer", "creation_date_raw", "mod_date_raw")
SCHEMA = (
    "path string, filename string, document_id string, page_number int, text string, page_width double, page_height double, extraction_status string, extraction_error string, "
    "sha256 string, page_count int, encrypted boolean, error string, metadata map<string,string>"
)
#: Bytes of a file for which one task reads the pages, by default.
RANGE_BYTES = 4 << 20


class Document(Protocol):
    """An open document. Pages are numbered from 0; any method may raise, for what it can't read alone."""

    page_count: int
    encrypted: bool

    def page(self, number: int) -> tuple[str | None, float | None, float | None]: ...

    def metadata(self, key: str) -> object: ...


Opener = Callable[[bytes], Any]


class Listed:
    """A document given as (pages, encrypted, metadata); a page that is an exception can't be read."""

    def __init__(self, pages: list, encrypted: bool, metadata: dict) -> None:
        self._pages, self.encrypted, self._metadata, self.page_count = pages, encrypted, metadata, len(pages)

    def page(self, number: int) -> tuple[str | None, float | None, float | None]:
        found = self._pages[number]
        if isinstance(found[0], Exception):
            raise found[0]
        return found

    def metadata(self, key: str) -> object:
        found = self._metadata.get(key)
        if isinstance(found, Exception):
            raise found
        return found


class Pdf:
    """A PDF, by an installed library."""

    def __init__(self, content: bytes) -> None:
        try:
            import pypdf
        except ImportError as missing:
            raise IngestionError("reading PDF files needs pypdf") from missing
        self._reader = pypdf.PdfReader(io.BytesIO(content))
        self.encrypted = bool(self._reader.is_encrypted)
        self.page_count = 0 if self.encrypted else len(self._reader.pages)

    def page(self, number: int) -> tuple[str | None, float | None, float | None]:
        page = self._reader.pages[number]
        return page.extract_text() or "", float(page.mediabox.width), float(page.mediabox.height)

    def metadata(self, key: str) -> object:
        return getattr(self._reader.metadata, key, None)


def opened(opener: Opener, content: bytes) -> Document:
    found = opener(content)
    return Listed(*found) if isinstance(found, tuple) else found


def described(problem: Exception) -> str:
    return f"{type(problem).__name__}: {problem}"


def metadata_of(document: Document) -> dict[str, str | None]:
    """Every known key; a field that can't be read is null, and the others are kept."""
    values: dict[str, str | None] = {}
    for key in METADATA_KEYS:
        try:
            value = document.metadata(key)
            values[key] = None if value is None else str(value)
        except Exception:
            values[key] = None
    return values


def document_id_of(filename: str) -> str:
    """The first two parts of a file's name in upper case, or its stem where it has one part."""
    stem = filename.rsplit(".", 1)[0] if "." in filename[1:] else filename
    parts = stem.split("-")
    return f"{parts[0]}-{parts[1]}".upper() if len(parts) >= 2 else stem


@dataclass
class PageRange(InputPartition):
    """Range `number` of the `of` equal ones of a file's pages."""

    path: str
    number: int
    of: int

    def __post_init__(self) -> None:
        super().__init__(None)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class PageReader(DataSourceReader):
    def __init__(self, options: dict, opener: Opener) -> None:
        self.root, self.opener = options.get("path") or "", opener
        if not self.root:
            raise IngestionError("a path is needed")
        self.suffix = options.get("suffix", "")
        self.range_bytes = int(options.get("rangebytes") or options.get("rangeBytes") or RANGE_BYTES)
        if self.range_bytes < 1:
            raise IngestionError("rangeBytes must be positive")
        self.wanted: list[tuple[str, set]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Notes which files are asked for; Spark still filters the rows."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute[0] in ("filename", "document_id", "path"):
                self.wanted.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            yield f

    def partitions(self) -> list[PageRange]:
        fs, root = filesystem(self.root)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise IngestionError(f"no file or folder {self.root!r}")
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        ranges = []
        for file in sorted(found, key=lambda f: f.path):
            facts = {"filename": file.base_name, "document_id": document_id_of(file.base_name), "path": file.path}
            if file.type != pafs.FileType.File or file.base_name.startswith((".", "_")) or not file.base_name.endswith(self.suffix) or any(facts[c] not in values for c, values in self.wanted):
                continue
            of = max(1, -(-file.size // self.range_bytes))
            ranges += [PageRange(file.path, n, of) for n in range(of)]
        return ranges or [PageRange("", 0, 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, _ = filesystem(self.root)
        name = partition.path.rsplit("/", 1)[-1]
        key = (partition.path, name, document_id_of(name))
        with fs.open_input_file(partition.path) as file:
            content = file.read()
        digest = hashlib.sha256(content).hexdigest().upper() if not partition.number else None
        try:
            document = opened(self.opener, content)
            count, encrypted = document.page_count, bool(document.encrypted)
        except Exception as failed:
            if not partition.number:
                yield (*key, None, None, None, None, None, None, digest, None, None, described(failed), dict.fromkeys(METADATA_KEYS))
            return
        if not partition.number:
            yield (*key, None, None, None, None, None, None, digest, count, encrypted, None, metadata_of(document))
        for number in range(count * partition.number // partition.of, count * (partition.number + 1) // partition.of):
            try:
                text, width, height = document.page(number)
                yield (*key, number + 1, text or "", width, height, None, None, None, None, None, None, None)
            except Exception as failed:
                yield (*key, number + 1, "", None, None, "failed", described(failed), None, None, None, None, None)


def register_pages(spark: SparkSession, opener: Opener = Pdf, name: str = "lodestone_pages") -> str:
    """Registers the source for one kind of document and gives its format name.

    Options: path (a file or folder), suffix (of file names), rangeBytes (a file
    of so many bytes, or each part of so many, is one task's).
    """

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> PageReader:
            return PageReader(self.options, opener)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Pages)
    return name
