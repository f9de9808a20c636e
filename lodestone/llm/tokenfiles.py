"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A shard file is

    magic, 8 bytes            LSTOKEN1
    frames                    one zstandard frame for each document, in order
    index, one zstd frame     for each document: id (int64), has an id (uint8),
                              offset of its frame (uint64), tokens (uint64), each as one column
    footer, 64 bytes          documents, index offset, index length, token width (uint64 each),
                              SHA-256 of the dictionary (32 bytes)

Ids are little-endian unsigned integers of the footer's width. The dictionary
is a file of its own beside the shards, named by its SHA-256. A document is
read by its index entry alone, without the rest of its shard.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import Staging
from .encoder import encoder
from .text import over_texts, slices, strings

MAGIC = b"LSTOKEN1"
FOOTER = struct.Struct("<QQQQ32s")
#: Documents that the dictionary is trained on, bytes of each one's ids (of longer ones, stretches from all over), and its size.
TRAIN_DOCS, TRAIN_BYTES, DICTIONARY = 1000, 1 << 16, 1 << 15

MANIFEST = ("shard", "uri", "dictionary", "docs", "tokens", "first_id", "last_id", "without_id")


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs ...) or plain path, and the path there."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def write_whole(uri: str, parts: Iterator[bytes]) -> None:
    """Writes under another name first, so that a repeated or lost attempt leaves no half file."""
    at, path = place(uri)
    at.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with at.open_output_stream(part) as out:
        for x in parts:
            out.write(x)
    at.move(part, path)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of at most `size` bytes; where the samples are too few or too alike to train one, their own content."""
    samples = [s for s in samples if s]
    if len(samples) >= 8:
        try:
            return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 4)), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(dict.fromkeys(samples))[-size:]


def stretches(cells: bytes, most: int, parts: int = 16) -> bytes:
    """At most `most` bytes of a document's cells: all, or stretches of equal length evenly spread over it."""
    if len(cells) <= most:
        return cells
    each = most // parts // 8 * 8
    return b"".join(cells[at : at + each] for at in (i * (len(cells) - each) // (parts - 1) // 8 * 8 for i in range(parts)))


class Codec:
    def __init__(self, dictionary: bytes) -> None:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.pack = zstandard.ZstdCompressor(level=3, dict_data=shared).compress
        self.unpack = zstandard.ZstdDecompressor(dict_data=shared).decompress


def shard_parts(docs: Iterator[tuple[int | None, bytes]], dictionary: bytes, width: int, seen: dict) -> Iterator[bytes]:
    """The bytes of a shard; `seen` gets the numbers of documents and tokens and the range of ids."""
    codec, at, ids, offsets, counts = Codec(dictionary), len(MAGIC), [], [], []
    yield MAGIC
    for doc_id, cells in docs:
        frame = codec.pack(cells)
        ids.append(doc_id)
        offsets.append(at)
        counts.append(len(cells) // width)
        at += len(frame)
        yield frame
    columns = (np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids], "u1"), np.array(offsets, "<u8"), np.array(counts, "<u8"))
    index = zstandard.compress(b"".join(c.tobytes() for c in columns))
    yield index
    yield FOOTER.pack(len(ids), at, len(index), width, hashlib.sha256(dictionary).digest())
    known = [i for i in ids if i is not None]
    seen |= {"docs": len(ids), "tokens": sum(counts), "first_id": min(known, default=None), "last_id": max(known, default=None), "without_id": len(ids) - len(known)}


class Shard:
    """An open shard file: its index, and its documents by position or id."""

    def __init__(self, uri: str, dictionary: bytes) -> None:
        at, path = place(uri)
        self.file = at.open_input_file(path)
        size = self.file.size()
        n, where, length, self.width, digest = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if self.file.read_at(8, 0) != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a token file of this dictionary")
        self.codec = Codec(dictionary)
        index = io.BytesIO(zstandard.decompress(self.file.read_at(length, where), max_output_size=25 * n + 1))
        ids, known, self.offsets, self.counts = (np.frombuffer(index.read(w * n), dtype) for w, dtype in ((8, "<i8"), (1, "u1"), (8, "<u8"), (8, "<u8")))
        self.ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.place = np.flatnonzero(known)
        self.place = self.place[np.argsort(ids[self.place], kind="stable")]
        self.sorted = ids[self.place]
        self.ends = np.append(self.offsets[1:], where).astype(np.int64) if n else np.zeros(0, np.int64)

    def document(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.ends[i])
        cells = self.codec.unpack(self.file.read_at(b - a, a), max_output_size=int(self.counts[i]) * self.width + 1)
        return np.frombuffer(cells, f"<u{self.width}")

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of one document (the first of this id), found in the sorted index and read without the others."""
        at = int(np.searchsorted(self.sorted, doc_id))
        return self.document(int(self.place[at])) if at < len(self.sorted) and self.sorted[at] == doc_id else None


def _cells(batches: Iterator[pa.RecordBatch], path: str, keeps_space: bool, end_id: int, width: int) -> Iterator[tuple[int | None, bytes]]:
    coder = encoder(path, keeps_space, end_id)
    for whole in batches:
        for batch in slices(whole, "text"):
            ids, begins = coder.encode(strings(batch.column("text")))
            cells = ids.astype(f"<u{width}")
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                yield doc_id, cells[a:b].tobytes()


def write_token_files(
    docs: DataFrame, tokenizer: str, uri: str, keeps_space: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2, staging: Staging | None = None
) -> DataFrame:
    """Writes the shards of `docs` below `uri` in ascending id order; gives (shard, uri, docs, tokens).

    The dictionary is trained on the ids of at most TRAIN_DOCS documents, those
    first in the order of a hash of their ids and texts; all documents are
    written. The order is made by ranges of ids, then of texts' hashes, then of
    the rows as they are read, before texts are encoded: so each text is encoded
    once, where its shard is written, and null or repeated ids don't meet in one
    shard. Ids beyond `width` bytes are refused. The manifest also has each
    shard's dictionary, its first and last id and its documents without one.
    """
    staging = staging or Staging(docs.sparkSession, "tokens")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    most = max(end_id, *encoder(tokenizer, keeps_space, end_id).tokenizer.get_vocab(with_added_tokens=True).values())
    if most >> (8 * width):
        raise ValueError(f"token ids up to {most} don't fit in {width} bytes")
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    chosen = hashed.select("h").distinct().orderBy("h").limit(TRAIN_DOCS)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cells in _cells(batches, tokenizer, keeps_space, end_id, width):
            yield pa.RecordBatch.from_arrays([pa.array([stretches(cells, TRAIN_BYTES)], pa.binary())], names=["cells"])

    picked = hashed.join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"])  # TRAIN_DOCS rows at most
    samples = [bytes(r.cells) for r in over_texts(picked.select("doc_id", "text"), sample, "cells binary", keep=True).collect()]
    dictionary = train_dictionary(sorted(samples))
    name = f"{uri}/{hashlib.sha256(dictionary).hexdigest()}.dictionary"
    write_whole(name, iter([dictionary]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen = TaskContext.get().partitionId(), {}
        where = f"{uri}/shard-{shard:06d}.tokens"
        write_whole(where, shard_parts(_cells(batches, tokenizer, keeps_space, end_id, width), dictionary, width, seen))
        found = {"shard": shard, "uri": where, "dictionary": name, **seen}
        yield pa.RecordBatch.from_pylist([found], schema=pa.schema([(c, pa.string() if c in ("uri", "dictionary") else pa.int64()) for c in MANIFEST]))

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"{c} {'string' if c in ('uri', 'dictionary') else 'long'}" for c in MANIFEST)
    return staging.write(over_texts(ordered.select("doc_id", "text"), run, schema, keep=True).where("docs > 0"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shards of a manifest."""
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("uri", "dictionary", before.cast("long").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries: dict[str, bytes] = {}
        for batch in batches:
            for uri, name, base in zip(*(batch.column(c).to_pylist() for c in ("uri", "dictionary", "base")), strict=True):
                if name not in dictionaries:
                    at, path = place(name)
                    with at.open_input_file(path) as f:
                        dictionaries[name] = f.read()
                shard = Shard(uri, dictionaries[name])
                starts = base + np.concatenate(([0], np.cumsum(shard.counts.astype(np.int64))))
                for low in range(0, len(shard.ids), 2000):
                    high = min(low + 2000, len(shard.ids))
                    crc = [zlib.crc32(shard.document(i).astype("<u4").tobytes()) for i in range(low, high)]
                    columns = (shard.ids[low:high], starts[low:high], shard.counts[low:high].astype(np.int64), crc)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, keeps_space: bool = False, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", uri: str | None = None) -> DataFrame:
    """Writes token files and reads them back: doc_id, start, n_tokens, ids_crc32 for every row.

    Null texts are empty and give the end id alone; null ids come first and
    stay null; rows of one id follow each other by a hash of their text, and
    repeated rows are documents each; very long texts are encoded whole, a few
    megabytes of other texts at a time; an empty table writes no shards and
    gives no rows; other columns are not read, whatever their names.
    """
    staging = Staging(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer, uri or staging.path("files"), keeps_space, end_id, id_col, text_col, staging=staging))


def read_document(spark: SparkSession, manifest: DataFrame, doc_id: int) -> list[int] | None:
    """The ids of one document (the first of this id); only a shard whose range of ids holds it is opened. None if there is none."""
    for row in manifest.where(F.lit(doc_id).between(F.col("first_id"), F.col("last_id"))).orderBy("shard").toLocalIterator():
        at, path = place(row.dictionary)
        with at.open_input_file(path) as f:
            found = Shard(row.uri, f.read()).find(doc_id)
        if found is not None:
            return found.tolist()
    return None
