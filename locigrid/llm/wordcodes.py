"""Words of many texts at once, as codes into their dictionary.

All characters that part words here are ASCII, so bytes of UTF-8 can be told
apart one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

# Bytes of text worked on at a time; a longer text is worked on alone.
CHUNK = 12 << 20

WORD, GAP, BREAK = 0, 1, 2


def byte_kinds(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """What each byte is: part of a word, a gap between words, or a break that no phrase may span."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(gaps)] = GAP
    kinds[list(breaks)] = BREAK
    return kinds


def lowered() -> np.ndarray:
    """Each byte, A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_LOWER = lowered()


@dataclass(frozen=True)
class Words:
    """Words of a batch of texts in reading order."""

    names: pa.Array  # the different words, as binary
    codes: np.ndarray  # of each word, which name it has
    bounds: np.ndarray  # of each text, where its words begin; one more at the end
    piece: np.ndarray | None  # of each word, a number that changes at breaks and texts
    starts: np.ndarray  # of each word, its first byte in ``data``
    ends: np.ndarray
    data: np.ndarray  # all texts in a row
    offsets: np.ndarray  # of each text, its first byte in ``data``

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits of hash for each name."""
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.names.to_pylist()), np.uint64, len(self.names))

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words_of(texts: pa.Array, kinds: np.ndarray, lower: bool = False, pieces: bool = False) -> Words:
    """Words of ``texts``; a missing text has none. Names keep their bytes unless ``lower``."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    kind = kinds[data]
    solid = kind == WORD
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    # a word ends with its text even where the next begins with a word
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = solid[begins]
    finals = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[finals] = solid[finals]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    piece = None
    if pieces:
        # counts the breaks and the text begins before each word
        turn = (kind == BREAK).astype(np.int32)
        turn[begins] += 1
        piece = np.cumsum(turn, dtype=np.int32)[starts]
    place = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=place[1:])
    packed = np.ascontiguousarray(data[solid])
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(place), pa.py_buffer(packed)])
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return Words(coded.dictionary, codes, np.searchsorted(starts, offsets), piece, starts, ends, data, offsets)


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on; the last ``width`` - 1 places have none.

    Word hashes are random, so a sum weighed by powers of an odd number is as
    good a hash; windows of doubled widths are put together.
    """
    step = 0x9E3779B97F4A7C15
    size = len(hashes) - width + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out, done, block, span = np.zeros(size, np.uint64), 0, hashes, 1
    rest = width
    while rest:
        if rest & 1:
            out += np.uint64(pow(step, done, 1 << 64)) * block[done : done + size]
            done += span
        rest >>= 1
        if rest:
            block = block[:-span] + np.uint64(pow(step, span, 1 << 64)) * block[span:]
            span *= 2
    return out


def sliced(batches: Iterable[pa.RecordBatch], column: int, chunk: int = CHUNK, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``chunk`` bytes of text and at most ``rows`` rows."""
    held, size, count = [], 0, 0

    def joined() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from table.to_batches()

    for batch in batches:
        texts = batch.column(column)
        lengths = np.zeros(len(texts), np.int64)
        if len(texts):
            lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = int(np.searchsorted(ends, before + chunk - size, "right"))
            high = min(high, low + rows - count, batch.num_rows)
            if high > low:
                held.append(batch.slice(low, high - low))
                size += int(ends[high - 1] - before)
                count += high - low
                low = high
            if low < batch.num_rows:
                if held:
                    yield from joined()
                    held, size, count = [], 0, 0
                elif high <= low:
                    # one text over the bound
                    yield batch.slice(low, 1)
                    low += 1
    if held:
        yield from joined()
