"""Exact repeats between and inside documents, found by anchors.

Every document is cut into blocks of half a window; a window of twice that size
holds at least one whole block wherever it starts, so a repeated window shows as
a block that is met again. Blocks are the index, and every rolling window of
block size probes it. A block that is hit is extended to both sides: all windows
around a hit, on the side of the block and on that of the probe, are compared by
hash, and those that stand elsewhere too join into maximal exact repeats.

Texts are written once, in batches of bounded size, to a table bucketed by batch.
What travels afterwards are hashes, sorted and packed per batch and part of the
hash range, and one bit per hash on the way back, which joins the batches without
moving a text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from locigrid.llm.common import stored
from locigrid.llm.wordcodes import Words, byte_kinds, runs, sliced, words_of
from locigrid.session import work_path

WINDOW = 20
# Bytes of text whose hashes one task of the index may hold at a time.
PART_BYTES = 24 << 20
# Stands for a missing doc_id and sorts before all others.
NO_ID = np.iinfo(np.int64).min

_KINDS = byte_kinds(b"\x20\x09\x0a\x0b\x0c\x0d")


def _written_batches(docs: DataFrame) -> DataFrame:
    """Documents in batches, one row each: ids, sizes and compressed texts, in a table bucketed by batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in sliced(batches, 1):
            ids = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            texts = batch.column(1).take(pa.array(order)).cast(pa.large_binary())
            sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
            raw = texts.buffers()[2]
            body = memoryview(raw)[: int(sizes.sum())] if raw is not None else b""
            yield pa.RecordBatch.from_pydict(
                {
                    "batch": [number],
                    "bytes": [int(sizes.sum())],
                    "ids": [ids[order].astype("<i8").tobytes()],
                    "sizes": [sizes.astype("<i8").tobytes()],
                    "texts": [zstandard.ZstdCompressor(level=1).compress(body)],
                }
            )
            number += 1

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut = rows.mapInArrow(run, "batch long, bytes long, ids binary, sizes binary, texts binary")
    name = f"anchor_batches_{uuid.uuid4().hex}"
    writer = cut.write.format("parquet").option("compression", "none").option("path", work_path(spark, "batches"))
    writer.bucketBy(max(8, rows.rdd.getNumPartitions()), "batch").saveAsTable(name)
    return spark.table(name)


def _texts(row: dict) -> tuple[np.ndarray, pa.Array]:
    sizes = np.frombuffer(row["sizes"], "<i8")
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    body = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=int(offsets[-1])) if offsets[-1] else b""
    texts = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    return np.frombuffer(row["ids"], "<i8"), texts


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, first all lowest bytes, then the next: sorted values pack well so."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)[:, :width].T.tobytes()


def _values(blob: memoryview, count: int, width: int, kind: str) -> np.ndarray:
    out = np.zeros((count, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, count * width).reshape(width, count).T
    return out.reshape(-1).view(kind)


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which part of the hash range the sorted 64-bit ``hashes`` are in; parts keep the order."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _cuts(sorted_hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts that hold any of the hashes, and where each begins; one more begin at the end."""
    part = _part_of(sorted_hashes, parts).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    return part[begin], np.append(begin, len(part))


class Probes:
    """Different block-size windows of a batch, the low 16 bits of their hashes cleared: sorted, with two marks each."""

    def __init__(self, found: Words, window: int):
        self.found, self.window, block = found, window, window // 2
        self.word = found.hashes()[found.codes]
        self.text = found.text_of()
        self.place = np.arange(len(self.word)) - found.bounds[:-1][self.text]
        left = found.bounds[1:][self.text] - np.arange(len(self.word))
        self.left = left
        at = np.flatnonzero(left >= block)
        self.at, self.hash = at, runs(self.word, block)[at] & ~np.uint64(0xFFFF)
        order = np.argsort(self.hash)
        ranked = self.hash[order]
        begin = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
        self.unique = ranked[begin]
        if len(begin):
            is_block = (self.place[at] % block == 0)[order]
            self.block = np.logical_or.reduceat(is_block, begin)
            self.many = np.diff(np.append(begin, len(ranked))) > 1
        else:
            self.block = self.many = np.zeros(0, bool)

    def packed(self, parts: int) -> Iterator[tuple[int, bytes]]:
        part, begin = _cuts(self.unique, parts)
        for p, a, b in zip(part.tolist(), begin[:-1], begin[1:]):
            marks = np.packbits(np.concatenate((self.block[a:b], self.many[a:b]))).tobytes()
            yield p, np.uint32(b - a).tobytes() + marks + _planes(self.unique[a:b] >> np.uint64(16), 6)

    def windows(self, answers: list | None, parts: int) -> np.ndarray:
        """Places of the windows that hold a block met elsewhere."""
        hit = np.zeros(len(self.unique), bool)
        _answered(hit, self.unique, answers, parts)
        met = self.unique[hit]
        starts = np.zeros(len(self.word) + 1, np.int32)
        if len(met):
            near = np.searchsorted(met, self.hash)
            starts[self.at + 1] = met[np.minimum(near, len(met) - 1)] == self.hash
        sums = np.cumsum(starts)
        place = np.flatnonzero(self.left >= self.window)
        return place[sums[place + self.window // 2] > sums[place]]


def _answered(out: np.ndarray, sorted_hashes: np.ndarray, answers: list | None, parts: int) -> None:
    """Write the bits of each part where its hashes are."""
    if answers:
        part, begin = _cuts(sorted_hashes, parts)
        for answer in answers:
            k = int(np.searchsorted(part, answer["part"]))
            a, b = int(begin[k]), int(begin[k + 1])
            out[a:b] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=b - a).astype(bool)


class Candidates:
    """Windows around hits: equal ones of the batch together, each group with its earliest place."""

    def __init__(self, probes: Probes, ids: np.ndarray, answers: list | None, parts: int):
        found, window = probes.found, probes.window
        self.at = probes.windows(answers, parts)
        low = runs(probes.word, window)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        high = (runs(found.hashes(1)[found.codes], window)[self.at] >> np.uint64(32)) if len(self.at) else np.zeros(0, np.uint64)
        # the order of documents and starts, alike for rows that share an id
        length = np.diff(found.bounds)
        group = np.concatenate(([0], np.cumsum(ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
        longest = np.zeros(int(group[-1]) + 1 if len(ids) else 0, np.int64)
        np.maximum.at(longest, group, length)
        base = np.cumsum(longest) - longest
        when = base[group][probes.text[self.at]] + probes.place[self.at]
        order = np.lexsort((when, high, low))
        low, high, when = low[order], high[order], when[order]
        first = np.ones(len(order), bool)
        first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        begin = np.flatnonzero(first)
        self.order, self.member = order, np.cumsum(first) - 1
        self.low, self.high = low[begin], high[begin]
        self.later = when > when[begin][self.member] if len(begin) else np.zeros(0, bool)
        earliest = self.at[order[begin]]
        self.id, self.start = ids[probes.text[earliest]], probes.place[earliest]

    def packed(self, parts: int) -> Iterator[tuple[int, bytes]]:
        part, begin = _cuts(self.low, parts)
        for p, a, b in zip(part.tolist(), begin[:-1], begin[1:]):
            fields = ((self.low, 8), (self.high, 4), (self.id, 8), (self.start, 8))
            yield p, np.uint32(b - a).tobytes() + b"".join(_planes(x[a:b], w) for x, w in fields)

    def repeated(self, answers: list | None, parts: int) -> np.ndarray:
        """Places of windows that also start earlier, in this batch or in another."""
        elsewhere = np.zeros(len(self.low), bool)
        _answered(elsewhere, self.low, answers, parts)
        again = self.later | elsewhere[self.member] if len(self.low) else self.later
        return self.at[self.order[again]]


def _met(rows: list[dict]) -> Iterator[tuple[int, bytes]]:
    """For each batch a bit per hash: whether it is a block and stands in two places at least."""
    hashes, block, many, sizes = [], [], [], []
    for r in rows:
        blob = memoryview(r["blob"])
        n = int(np.frombuffer(blob, np.uint32, 1)[0])
        width = (2 * n + 7) // 8
        marks = np.unpackbits(np.frombuffer(blob, np.uint8, width, 4), count=2 * n).astype(bool)
        block.append(marks[:n])
        many.append(marks[n:])
        hashes.append(_values(blob[4 + width :], n, 6, "<u8"))
        sizes.append(n)
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    begin = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    size = np.diff(np.append(begin, len(ranked)))
    hit = np.logical_or.reduceat(np.concatenate(block)[order], begin) & ((size > 1) | np.logical_or.reduceat(np.concatenate(many)[order], begin))
    bits = np.empty(len(every), bool)
    bits[order] = np.repeat(hit, size)
    yield from _bits(rows, bits, sizes)


def _earlier(rows: list[dict]) -> Iterator[tuple[int, bytes]]:
    """For each batch a bit per window: whether another batch has it at an earlier place."""
    fields: tuple[list, ...] = ([], [], [], [])
    sizes = []
    for r in rows:
        blob = memoryview(r["blob"])
        n = int(np.frombuffer(blob, np.uint32, 1)[0])
        at = 4
        for out, width, kind in zip(fields, (8, 4, 8, 8), ("<u8", "<u8", "<i8", "<i8")):
            out.append(_values(blob[at:], n, width, kind))
            at += n * width
        sizes.append(n)
    low, high, doc, start = (np.concatenate(x) for x in fields)
    order = np.lexsort((start, doc, high, low))
    low, high, doc, start = low[order], high[order], doc[order], start[order]
    first = np.ones(len(order), bool)
    first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    bits = np.empty(len(order), bool)
    bits[order] = (doc != doc[head]) | (start != start[head])
    yield from _bits(rows, bits, sizes)


def _bits(rows: list[dict], bits: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, bytes]]:
    at = 0
    for r, n in zip(rows, sizes):
        mine = bits[at : at + n]
        at += n
        if mine.any():
            yield r["batch"], np.packbits(mine).tobytes()


def _answers(packed: DataFrame, settle, name: str) -> DataFrame:
    """batch and its answers, a list of (part, bits), from packed hashes (part, batch, blob)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> Iterator[pa.RecordBatch]:
            found = list(settle(held))
            columns = {"batch": pa.array([b for b, _ in found], pa.int64()), "part": pa.array([held[0]["part"]] * len(found), pa.int64()), "bits": pa.array([x for _, x in found], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["part"] != row["part"]:
                    yield from done()
                    held = []
                held.append(row)
        if held:
            yield from done()

    # a part holds the hashes of a bounded share of the texts, and each batch names a hash once
    dealt = packed.repartition("part").sortWithinPartitions("part", "batch")
    bits = stored(dealt.mapInArrow(run, "batch long, part long, bits binary"), name)
    return bits.groupBy("batch").agg(F.collect_list(F.struct("part", "bits")).alias(name))


def _packed(rows: DataFrame, pack) -> DataFrame:
    """part, batch and blob for each batch row, by ``pack``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                for part, blob in pack(row):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "batch": pa.array([row["batch"]], pa.int64()), "blob": pa.array([blob], pa.binary())})

    return rows.mapInArrow(run, "part long, batch long, blob binary")


def _settled(row: dict, window: int, parts: int, texts: bool) -> pa.RecordBatch:
    ids, raw = _texts(row)
    probes = Probes(words_of(raw, _KINDS), window)
    found = probes.found
    again = Candidates(probes, ids, row["met"], parts).repeated(row["earlier"], parts)
    edge = np.zeros(len(probes.word) + 1, np.int32)
    edge[again] += 1
    edge[again + window] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    # kept words and the byte after each as the blank between them
    keep = np.flatnonzero(~gone)
    data = np.append(found.data, np.uint8(0))
    change = np.zeros(len(data) + 1, np.int8)
    change[found.starts[keep]] += 1
    change[found.ends[keep]] -= 1
    solid = np.cumsum(change[:-1], dtype=np.int8) > 0
    last = np.zeros(len(gone), bool)
    text = probes.text[keep]
    last[keep] = np.concatenate((text[1:] != text[:-1], [True])) if len(keep) else False
    blank = found.ends[np.flatnonzero(~gone & ~last)]
    data[blank] = 32
    solid[blank] = True
    size = np.concatenate(([0], np.cumsum(solid)))[np.append(found.offsets[:-1], len(found.data))]
    body = data[solid].tobytes()
    kept = [body[a:b] for a, b in zip(size[:-1].tolist(), size[1:].tolist())]
    removed = np.concatenate(([0], np.cumsum(gone)))[found.bounds]
    turn = np.ones(len(gone), bool)
    turn[1:] = (gone[1:] != gone[:-1]) | (probes.text[1:] != probes.text[:-1])
    begin = np.flatnonzero(turn & gone)
    length = np.diff(np.append(np.flatnonzero(turn), len(gone)))[gone[turn]] if len(gone) else np.zeros(0, np.int64)
    of_text = np.searchsorted(begin, found.bounds)
    spans = pa.StructArray.from_arrays([pa.array(probes.place[begin], pa.int64()), pa.array(length, pa.int64())], ["start", "length"])
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID),
            "n_words": pa.array(np.diff(found.bounds), pa.int64()),
            "n_removed": pa.array(np.diff(removed), pa.int64()),
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
            "kept": pa.array([k.decode("utf-8", "replace") for k in kept] if texts else [None] * len(kept), pa.string()),
            "repeats": pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), spans),
        }
    )


def repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept and repeats of every row of ``docs``.

    ``repeats`` lists the maximal stretches of words (start, length) that windows
    of ``window`` words cover which also start earlier: at a smaller doc_id, or
    in the same document before. ``kept`` holds the other words, joined by one
    blank (null without ``texts``). Rows of one doc_id are one document: of equal
    windows at one start in them none is earlier. A missing doc_id comes before
    all others. Texts that are null, empty or shorter than a window keep all
    their words; an empty table gives an empty result.

    Blocks meet by 48 bits of hash, which only lets in windows without need;
    windows are equal by 96 bits.
    """
    if window % 2:
        raise ValueError("blocks are half a window")
    batches = _written_batches(docs)
    total = batches.agg(F.sum("bytes")).first()[0] or 0
    parts = min(max(16, -(-total // part_bytes)), (1 << 32) - 1)

    def probe(row: dict) -> Iterator[tuple[int, bytes]]:
        return Probes(words_of(_texts(row)[1], _KINDS), window).packed(parts)

    def extend(row: dict) -> Iterator[tuple[int, bytes]]:
        ids, raw = _texts(row)
        return Candidates(Probes(words_of(raw, _KINDS), window), ids, row["met"], parts).packed(parts)

    def settle(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                yield _settled(batch.slice(k, 1).to_pylist()[0], window, parts, texts)

    met = _answers(_packed(batches, probe), _met, "met")
    around = batches.join(met.hint("shuffle_hash"), "batch")
    earlier = _answers(_packed(around, extend), _earlier, "earlier")
    both = batches.join(met.hint("shuffle_hash"), "batch", "left").join(earlier.hint("shuffle_hash"), "batch", "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, repeats array<struct<start: long, length: long>>"
    return both.mapInArrow(settle, schema)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and repeats of every row of ``docs``; see ``repeats``."""
    return repeats(docs, window, texts=False).drop("kept")


SQL = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
  w AS (SELECT doc_id, s, array_to_string(ws[s:s + {WINDOW - 1}], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS s FROM d)),
  f AS (SELECT t, min({{'d': doc_id, 's': s}}) AS first FROM w GROUP BY t HAVING count(*) > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS pos FROM w JOIN f USING (t) WHERE {{'d': doc_id, 's': s}} > first),
  flat AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM flat ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
  n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""
