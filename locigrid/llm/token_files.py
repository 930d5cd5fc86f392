"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds, in order of doc_id:

* one frame per document: its ids, little-endian, of the width the index names;
* an index in a skippable frame: byte width of an id, number of documents, then
  per document its id (8 bytes) and whether the id is missing (1 byte);
* a seek table in a skippable frame: per document the compressed and the
  decompressed size of its frame and the low half of the XXH64 of its bytes,
  4 bytes each; then the number of frames, the flag for checksums, and the
  closing mark of the seekable format.

A reader takes the last bytes, the seek table and the index, and then only the
frames it wants.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from locigrid.llm import tokens
from locigrid.llm.common import text_or_empty

# Fixed values of the zstandard and seekable formats.
SKIP_INDEX, SKIP_TABLE, SEEK_END = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
END_ID = 1
LEVEL = 1
# A file is closed at this size or number of documents.
FILE_BYTES = 256 << 20
FILE_DOCS = 1 << 20
MANIFEST = "part int, file int, name string, docs long, tokens long"
READ_BYTES = 8 << 20


def place_of(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class FrameWriter:
    """Writes one file; it appears under its name only when whole."""

    def __init__(self, folder: str, name: str, width: int):
        self.store, root = place_of(folder)
        self.final = f"{root}/{name}"
        self.draft = f"{self.final}.{uuid.uuid4().hex}.draft"
        self.out = self.store.open_output_stream(self.draft)
        self.kind = f"<u{width}"
        self.width = width
        self.coder = zstandard.ZstdCompressor(level=LEVEL)
        self.entries, self.keys, self.missing = bytearray(), [], bytearray()
        self.bytes = self.tokens = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(self.kind).tobytes()
        frame = self.coder.compress(raw)
        self.out.write(frame)
        self.entries += struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
        self.keys.append(key or 0)
        self.missing.append(key is None)
        self.bytes += len(frame)
        self.tokens += len(ids)

    def close(self) -> tuple[int, int]:
        index = struct.pack("<BI", self.width, len(self.keys)) + np.array(self.keys, "<i8").tobytes() + bytes(self.missing)
        table = bytes(self.entries) + struct.pack("<IBI", len(self.keys), CHECKSUMS, SEEK_END)
        self.out.write(struct.pack("<II", SKIP_INDEX, len(index)) + index + struct.pack("<II", SKIP_TABLE, len(table)) + table)
        self.out.close()
        self.store.move(self.draft, self.final)
        return len(self.keys), self.tokens


class FrameReader:
    """Reads chosen documents of one file."""

    def __init__(self, folder: str, name: str):
        store, root = place_of(folder)
        self.file = store.open_input_file(f"{root}/{name}")
        size = self.file.size()
        count, flags, end = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if end != SEEK_END or flags != CHECKSUMS:
            raise ValueError(f"{name} has no seek table")
        table_at = size - 9 - 12 * count
        entries = np.frombuffer(self.file.read_at(12 * count, table_at), "<u4").reshape(-1, 3)
        self.sizes, self.raw, self.sums = entries.T
        index_at = table_at - 8 - (5 + 9 * count)
        index = self.file.read_at(5 + 9 * count, index_at)
        width, _ = struct.unpack("<BI", index[:5])
        self.kind, self.width = f"<u{width}", width
        self.keys = np.frombuffer(index, "<i8", count, 5)
        self.missing = np.frombuffer(index, "u1", count, 5 + 8 * count).astype(bool)
        self.begins = np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64)))
        self.starts = np.concatenate(([0], np.cumsum(self.raw.astype(np.int64) // width)))
        self.coder = zstandard.ZstdDecompressor()

    def ids(self, frame: bytes, k: int) -> np.ndarray:
        raw = self.coder.decompress(frame, max_output_size=int(self.raw[k]) or 1)
        if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, self.kind).astype("<u4")

    def document(self, k: int) -> np.ndarray:
        return self.ids(self.file.read_at(int(self.sizes[k]), int(self.begins[k])), k)

    def all(self) -> Iterator[tuple[int, np.ndarray]]:
        """Every document in order, read in spans of bounded size."""
        low = 0
        while low < len(self.sizes):
            high = max(low + 1, int(np.searchsorted(self.begins, self.begins[low] + READ_BYTES, "right")) - 1)
            span = self.file.read_at(int(self.begins[high] - self.begins[low]), int(self.begins[low]))
            for k in range(low, high):
                at = int(self.begins[k] - self.begins[low])
                yield k, self.ids(span[at : at + int(self.sizes[k])], k)
            low = high

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text of ``docs`` and write the files to ``folder``.

    A missing text is empty and a missing doc_id comes first. Rows are dealt by
    ranges of (doc_id, hash of the text), so that repeated ids share the work. A
    task that is run again writes the same files. What was written is listed in
    ``folder/manifest``, which appears when all is done.
    """
    path = vocabulary or tokens.default_path()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, file, count, listed = tokens.Encoder(path), None, 0, []
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4

        def finish() -> None:
            listed.append((part, count, name, *file.close()))

        for batch in tokens.gathered(batches):
            for key, ids in zip(batch.column(0).to_pylist(), encoder.texts(batch.column(1))):
                if file is None:
                    name = f"tokens-{part:06d}-{count:04d}.zst"
                    file = FrameWriter(folder, name, width)
                file.add(key, np.append(ids, np.uint32(end_id)))
                if file.bytes >= FILE_BYTES or len(file.keys) >= FILE_DOCS:
                    finish()
                    file, count = None, count + 1
        if file is not None:
            finish()
        if listed:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*listed)], names=["part", "file", "name", "docs", "tokens"]).cast(
                pa.schema([("part", pa.int32()), ("file", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
            )

    store, root = place_of(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, doc_ids: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the documents in ``folder``, and the ids if wanted.

    With ``doc_ids`` only the frames of these documents are read and decompressed.
    ``start`` counts the ids of all documents before.
    """
    listed = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # one small row per file: what stands before a file is summed here
    files, before = [], 0
    for r in sorted(listed.collect(), key=lambda r: (r["part"], r["file"])):
        files.append((r["name"], before))
        before += r["tokens"]
    wanted = None if doc_ids is None else np.array(sorted(doc_ids), np.int64)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], names=names)

        for batch in batches:
            for name, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, found = FrameReader(folder, name), []
                if wanted is None:
                    documents = reader.all()
                else:
                    picked = np.flatnonzero(np.isin(reader.keys, wanted) & ~reader.missing)
                    documents = ((int(k), reader.document(k)) for k in picked)
                for k, ids in documents:
                    key = None if reader.missing[k] else int(reader.keys[k])
                    more = (ids.tolist(),) if with_ids else ()
                    found.append((key, begin + int(reader.starts[k]), len(ids), tokens.crc(ids), *more))
                    if len(found) >= (64 if with_ids else 4096):
                        yield rows(found)
                        found = []
                reader.close()
                if found:
                    yield rows(found)

    table = spark.createDataFrame(files, "name string, begin long").repartition(max(1, len(files)))
    return table.mapInArrow(read, schema)
