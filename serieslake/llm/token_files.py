"""Token ids in seekable files: one zstandard frame per document and a trailing seek table.

A file holds documents in ascending doc_id order, its frames back to back. Each frame is one
document's ids as little-endian unsigned 32-bit integers. Behind them stand a skippable frame with
the doc_ids and, as the last frame, the seek table: for each frame its compressed size, its
decompressed size and the low 32 bits of the XXH64 of its content; then the number of frames, a flag byte
and a magic number. A reader takes the end of the file first and decompresses only the frames it
wants, checking each.

Files are written by the tasks through the folder's own file system, each attempt under a name of its
own; a manifest table names the files that count, so the leavings of a lost or repeated task
are never read. A null doc_id comes first and is kept; rows that repeat are stored each;
an empty or null text is stored as its end id alone. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serieslake.llm import bpe
from serieslake.llm.common import settle, text_of
from serieslake.session import scratch_path, ship

LEVEL = 3
NO_ID = -(1 << 63)  # stands for a null doc_id in a file
# fixed values of the seekable format
_SKIPPABLE_IDS = 0x184D2A50
_SKIPPABLE_TABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1
_WITH_CHECKSUMS = 0x80
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_FOOTER = struct.Struct("<IBI")
_HEADER = struct.Struct("<II")

MANIFEST = "shard int, path string, first_id bigint, last_id bigint, n_docs bigint, n_tokens bigint"


class Writer:
    """Appends documents to one file."""

    def __init__(self, stream):
        self.stream, self.entries, self.ids = stream, [], []
        self._packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        packed = self._packer.compress(ids)
        self.stream.write(packed)
        self.entries.append((len(packed), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(NO_ID if doc_id is None else doc_id)

    def close(self) -> None:
        names = np.array(self.ids, "<i8").tobytes()
        self.stream.write(_HEADER.pack(_SKIPPABLE_IDS, len(names)) + names)
        table = np.array(self.entries, _ENTRY).tobytes()
        self.stream.write(_HEADER.pack(_SKIPPABLE_TABLE, len(table) + _FOOTER.size) + table)
        self.stream.write(_FOOTER.pack(len(self.entries), _WITH_CHECKSUMS, _SEEKABLE))
        self.stream.close()


class Reader:
    """Reads documents of one file by place or by id."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - _FOOTER.size)
        n, flags, magic = _FOOTER.unpack(stream.read(_FOOTER.size))
        if magic != _SEEKABLE or flags != _WITH_CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        tail = n * (_ENTRY.itemsize + 8) + 2 * _HEADER.size + _FOOTER.size
        stream.seek(size - tail)
        head = stream.read(tail)
        at = _HEADER.size
        if _HEADER.unpack_from(head, 0) != (_SKIPPABLE_IDS, 8 * n):
            raise ValueError("the list of documents is damaged")
        self.ids = np.frombuffer(head, "<i8", n, at)
        if _HEADER.unpack_from(head, at + 8 * n)[0] != _SKIPPABLE_TABLE:
            raise ValueError("the seek table is damaged")
        self.entries = np.frombuffer(head, _ENTRY, n, at + 8 * n + _HEADER.size)
        self.offsets = np.concatenate(([0], np.cumsum(self.entries["packed"], dtype=np.int64)))
        self._unpacker = zstandard.ZstdDecompressor()

    def places(self, wanted: Sequence[int] | None) -> np.ndarray:
        """Where the wanted ids stand; all places if none are named."""
        if wanted is None:
            return np.arange(len(self.ids))
        return np.flatnonzero(np.isin(self.ids, np.array(wanted, "<i8")))

    def read(self, place: int) -> bytes:
        entry = self.entries[place]
        self.stream.seek(int(self.offsets[place]))
        data = self._unpacker.decompress(self.stream.read(int(entry["packed"])), max_output_size=int(entry["size"]))
        if len(data) != entry["size"] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != entry["check"]:
            raise ValueError(f"frame {place} does not match its checksum")
        return data


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder as Spark names it, such as file:/..., hdfs://... or s3://..."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def write(documents: DataFrame, end_id: int, folder: str | None = None, vocabulary: str = bpe.VOCABULARY, files: int | None = None) -> DataFrame:
    """Encode and store all documents; returns the manifest, one row per file, itself settled.

    Rows are dealt out by ranges of (doc_id, row), so a doc_id that repeats without end is split, too.
    """
    spark = documents.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "token-files")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = bpe.coder(bpe.vocabulary_path(vocabulary)), np.array([end_id], "<u4").tobytes()
        shard = TaskContext.get().partitionId()
        system, root = _file_system(folder)
        writer, path, tokens = None, f"{root}/{shard:06d}-{uuid.uuid4().hex}.zst", 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if writer is None:
                    system.create_dir(root, recursive=True)
                    writer = Writer(system.open_output_stream(path, compression=None))
                ids = own.encode(text) + end
                tokens += len(ids) // 4
                writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            known = [i for i in writer.ids if i != NO_ID]
            row = (shard, f"{folder}/{path.rpartition('/')[2]}", min(known, default=None), max(known, default=None), len(writer.ids), tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.string(), *[pa.int64()] * 4])],
                names=["shard", "path", "first_id", "last_id", "n_docs", "n_tokens"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange(files, F.asc_nulls_first("doc_id"), "row").sortWithinPartitions(F.asc_nulls_first("doc_id"), "row")
    return settle(dealt.select("doc_id", "text").mapInArrow(stored, MANIFEST), "token-manifest")


def _each(manifest: DataFrame, doc_ids: Sequence[int] | None) -> tuple[DataFrame, list[int] | None]:
    """The files that can hold the wanted ids, one task each, with the tokens stored before them."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before)  # one row per file
    wanted = None if doc_ids is None else sorted(set(doc_ids))
    if wanted is not None:
        files = files.where(F.lit(bool(wanted)) & (F.col("first_id") <= (wanted or [0])[-1]) & (F.col("last_id") >= (wanted or [0])[0]))
    tasks = max(1, manifest.count())
    return files.repartition(tasks, "shard").select("path", "before"), wanted


def _frames(frames: Iterator[pd.DataFrame], wanted) -> Iterator[tuple[list, list, list]]:
    """(doc_ids, token starts, contents) of the wanted documents, a bounded number at a time."""
    for frame in frames:
        for path, before in zip(frame["path"], frame["before"]):
            system, name = _file_system(path)
            size = system.get_file_info(name).size
            with system.open_input_file(name) as stream:
                reader = Reader(stream, size)
                starts = before + np.concatenate(([0], np.cumsum(reader.entries["size"] // 4, dtype=np.int64)))
                places = reader.places(wanted)
                for k in range(0, len(places), 1000):
                    some = places[k : k + 1000]
                    ids = [None if i == NO_ID else int(i) for i in reader.ids[some]]
                    yield ids, starts[some].tolist(), [reader.read(int(p)) for p in some]


def read(manifest: DataFrame, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """(doc_id, start, ids) from the files; only the frames of ``doc_ids`` are read, if named."""
    files, wanted = _each(manifest, doc_ids)

    def loaded(frames):
        for ids, starts, contents in _frames(frames, wanted):
            values = [np.frombuffer(c, "<u4").astype(np.int64) for c in contents]
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "start": starts, "ids": values})

    ship(manifest.sparkSession)
    return files.mapInPandas(loaded, "doc_id bigint, start bigint, ids array<bigint>")


def checksums(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document."""
    files, _ = _each(manifest, None)

    def summed(frames):
        for ids, starts, contents in _frames(frames, None):
            yield pd.DataFrame(
                {
                    "doc_id": pd.array(ids, "Int64"),
                    "start": starts,
                    "n_tokens": [len(c) // 4 for c in contents],
                    "ids_crc32": [zlib.crc32(c) for c in contents],
                }
            )

    ship(manifest.sparkSession)
    return files.mapInPandas(summed, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
