"""Packing of documents into sequences of fixed length, shortest pack first.

Documents are cut into pieces no longer than a sequence. Only the histogram of
piece lengths is needed to plan: lengths are placed longest first, each into the
packs with the most room, whole groups of equal packs at a time. The plan says
for the pieces of a length, by their rank, which sequence and offset they get.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from locigrid.llm import tokens
from locigrid.llm.common import salts, stored, text_or_empty

SEQUENCE = 2048
END_ID = 1
# Rows one task ranks at a time, about.
RANKED_ROWS = 20_000


@dataclass(frozen=True)
class Plan:
    """Per length, in order of rank: from which rank on a slot serves, its first sequence, its offset."""

    ranks: dict[int, np.ndarray]
    sequences: dict[int, np.ndarray]
    offsets: dict[int, np.ndarray]
    count: int


def plan_packs(histogram: dict[int, int], size: int = SEQUENCE) -> Plan:
    """Place the counted lengths.

    A pattern is a group of sequences filled alike: (first sequence, how many),
    filed under the room they have left. A length goes to the pattern with the
    most room; if that is too little, new sequences are opened. Placing part of
    a pattern's count splits it in two, so patterns stay as few as lengths, and
    the plan does not grow with the corpus.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    most, opened = 0, 0
    slots: dict[int, list[tuple[int, int, int]]] = {}
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left > 0:
            while most and not room.get(most):
                most -= 1
            if most >= length:
                first, count = room[most].pop()
                used = min(left, count)
                if used < count:
                    room[most].append((first + used, count - used))
                free = most
            else:
                first, used, free = opened, left, size
                opened += left
            slots.setdefault(length, []).append((rank, first, size - free))
            if free > length:
                room.setdefault(free - length, []).append((first, used))
                most = max(most, free - length)
            rank += used
            left -= used
    column = lambda k: {length: np.array([s[k] for s in rows], np.int64) for length, rows in slots.items()}
    return Plan(column(0), column(1), column(2), opened)


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece of every document."""
    path = vocabulary or tokens.default_path()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder(path)
        for batch in tokens.gathered(batches):
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), encoder.texts(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id))
                rows += [(key, at, len(ids[at : at + size]), tokens.crc(ids[at : at + size]), len(ids)) for at in range(0, len(ids), size)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def ranked(pieces: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0.

    Pieces are dealt evenly into salts, numbered within salt and length, and
    the counts of the salts before are added: no task holds all pieces of a length.
    """
    n = salts(pieces, RANKED_ROWS)
    dealt = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n)))
    # copies of a row meet in one salt, and so are few beside the others
    within = Window.partitionBy("salt", "length").orderBy("doc_id", "start", "ids_crc32")
    numbered = dealt.repartition(F.col("salt")).withColumn("place", F.row_number().over(within) - 1)
    counts = dealt.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return numbered.join(offsets, ["length", "salt"]).withColumn("rank", F.col("place") + F.col("before")).drop("salt", "place", "before")


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Every piece of ``docs`` with its sequence_id and its offset there.

    A missing or empty text is a document of the end id alone. Repeated rows are
    packed each. Pieces of one length are interchangeable and take their slots in
    order of salt, doc_id and start. An empty table has no pieces.
    """
    pieces = stored(cut_pieces(docs, vocabulary, size, end_id), "pieces")
    # at most one row per length
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = plan_packs(histogram, size)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for each in np.unique(lengths):
            rows = np.flatnonzero(lengths == each)
            at = np.searchsorted(plan.ranks[int(each)], ranks[rows], "right") - 1
            sequence[rows] = plan.sequences[int(each)][at] + ranks[rows] - plan.ranks[int(each)][at]
            offset[rows] = plan.offsets[int(each)][at]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked(pieces).withColumn("slot", slot("length", "rank"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "slot.sequence_id", "slot.offset")
