"""Ranked search for stated queries over all documents.

Documents are dealt into shards. In a shard every term has a posting list with
the exact impact it gives a document, and over each list lies a sparse table of
range maxima. A query searches intervals of documents best first: an interval's
bound is the sum of its terms' range maxima, its document of the greatest impact
is scored exactly, and the interval is split there. What stays below the tenth
best score so far is never opened.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from locigrid.llm.common import stored
from locigrid.llm.wordcodes import byte_kinds, sliced, words_of

TOP = 10
# Documents of a shard; its sparse tables hold a number per posting and level.
SHARD = 4096
# Terms of the queries that are searched in one pass over the documents.
TERMS = 50_000
# Intervals of a query opened together.
WAVE = 16

_KINDS = byte_kinds(bytes(b for b in range(128) if not chr(b).isalnum()))


def terms_of(texts: pa.Array) -> list[set[bytes]]:
    """Different terms of each text."""
    found = words_of(texts, _KINDS, lower=True)
    names = found.names.to_pylist()
    return [{names[c] for c in np.unique(found.codes[a:b])} for a, b in zip(found.bounds[:-1], found.bounds[1:])]


def _shards(docs: DataFrame, terms: list[bytes], shard: int) -> DataFrame:
    """One row per shard: how many documents and terms it has, in how many of its documents each query term is, and its counts."""
    number = {t: k for k, t in enumerate(terms)}
    width = len(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, rows=shard):
            found = words_of(batch.column(1), _KINDS, lower=True)
            length = np.diff(found.bounds)
            known = np.fromiter((number.get(w, -1) for w in found.names.to_pylist()), np.int64, len(found.names))
            term = known[found.codes]
            hit = term >= 0
            pair, count = np.unique(found.text_of()[hit] * width + term[hit], return_counts=True)
            present = np.bincount(pair % width, minlength=width) if width else np.zeros(0, np.int64)
            seen = np.flatnonzero(present)
            doc = batch.column(0)
            yield pa.RecordBatch.from_pydict(
                {
                    "docs": [int((length > 0).sum())],
                    "words": [int(length.sum())],
                    "terms": pa.array([seen.astype(np.int32)], pa.list_(pa.int32())),
                    "held_by": pa.array([present[seen].astype(np.int32)], pa.list_(pa.int32())),
                    "doc_id": [doc.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()],
                    "missing": [doc.is_null().to_numpy(zero_copy_only=False).tobytes()],
                    "length": [length.astype("<i4").tobytes()],
                    "row": [(pair // max(width, 1)).astype("<u4").tobytes()],
                    "term": [(pair % max(width, 1)).astype("<u4").tobytes()],
                    "count": [count.astype("<u4").tobytes()],
                }
            )

    schema = "docs long, words long, terms array<int>, held_by array<int>, doc_id binary, missing binary, length binary, row binary, term binary, count binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


class Postings:
    """Posting lists of a shard, sorted by term and document, with range maxima over impacts."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int):
        order = np.argsort(term * docs + doc)
        self.docs = docs
        self.key = (term * docs + doc)[order]
        self.impact = np.append(impact[order], 0)
        top = int(np.bincount(term).max()) if len(term) else 1
        level = np.arange(len(order), dtype=np.int32)
        self.levels, span = [level], 1
        while 2 * span <= top:
            a, b = level[:-span], level[span:]
            level = np.where(self.impact[a] >= self.impact[b], a, b).astype(np.int32)
            self.levels.append(level)
            span *= 2
        # one flat table, with where each level begins
        self.begin = np.concatenate(([0], np.cumsum([len(x) for x in self.levels])))[:-1]
        self.table = np.append(np.concatenate(self.levels), np.int32(0))

    def bounds(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.key, term * self.docs), np.searchsorted(self.key, (term + 1) * self.docs)

    def best(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the greatest impact in each range and that impact, 0 in an empty range."""
        size = high - low
        some = size > 0
        level = np.frexp(np.maximum(size, 1))[1] - 1
        base = self.begin[level]
        a = self.table[np.where(some, base + low, 0)]
        b = self.table[np.where(some, base + high - (1 << level), 0)]
        at = np.where(self.impact[a] >= self.impact[b], a, b)
        return at, np.where(some, self.impact[at], 0)

    def search(self, term: np.ndarray, top: list[tuple[int, int]], offer, least) -> int:
        """Open intervals until none can reach ``least()``; ``offer(score, doc)`` takes what is scored. Returns how many it scored."""
        low, high = self.bounds(term)
        term, low, high = term[high > low], low[high > low], high[high > low]
        if not len(term):
            return 0
        base = term * self.docs
        opened, heap, serial = 0, [], 0

        def push(low: np.ndarray, high: np.ndarray) -> None:
            nonlocal serial
            at, greatest = self.best(low, high)
            bound = greatest.sum(axis=1)
            split = self.key[at[np.arange(len(at)), greatest.argmax(axis=1)]] % self.docs
            limit = max(least(), 1)
            for k in np.flatnonzero(bound >= limit).tolist():
                heapq.heappush(heap, (-int(bound[k]), serial, int(split[k]), low[k], high[k]))
                serial += 1

        push(low[None], high[None])
        while heap and -heap[0][0] >= least():
            wave = []
            limit = least()
            while heap and len(wave) < WAVE and -heap[0][0] >= limit:
                wave.append(heapq.heappop(heap))
            split = np.array([w[2] for w in wave])
            low, high = np.stack([w[3] for w in wave]), np.stack([w[4] for w in wave])
            want = base[None, :] + split[:, None]
            mid = np.clip(np.searchsorted(self.key, want), low, high)
            hit = (mid < high) & (self.key[np.minimum(mid, len(self.key) - 1)] == want)
            score = (self.impact[mid] * hit).sum(axis=1)
            opened += len(wave)
            for s, d in zip(score.tolist(), split.tolist()):
                offer(s, d)
            push(np.concatenate((low, mid + hit)), np.concatenate((mid, high)))
        return opened


def _impacts(weight: np.ndarray, count: np.ndarray, length: np.ndarray, docs: int, words: int) -> np.ndarray:
    norm = 100 - 90 + (90 * length * docs) // words
    return weight * ((1_000_000_000 * count) // (1000 * count + 8 * norm))


def _found(shards: DataFrame, items: list[np.ndarray], weights: np.ndarray, docs: int, words: int, top: int) -> DataFrame:
    """The best documents of each item that each task finds in its shards."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        for batch in batches:
            for r in batch.to_pylist():
                length = np.frombuffer(r["length"], "<i4").astype(np.int64)
                row = np.frombuffer(r["row"], "<u4").astype(np.int64)
                term = np.frombuffer(r["term"], "<u4").astype(np.int64)
                if not len(row):
                    continue
                count = np.frombuffer(r["count"], "<u4").astype(np.int64)
                # neighbours in an interval are alike in length, so that its maxima are near its scores
                order = np.argsort(length, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                doc = np.frombuffer(r["doc_id"], "<i8")[order].tolist()
                none = np.frombuffer(r["missing"], bool)[order].tolist()
                lists = Postings(term, place[row], _impacts(weights[term], count, length[row], docs, words), len(order))
                for mine, wanted in zip(best, items):

                    def offer(score: int, d: int, mine=mine) -> None:
                        # smaller ids first, rows without id last
                        entry = (score, not none[d], -doc[d])
                        if score > 0:
                            (heapq.heappush if len(mine) < top else heapq.heappushpop)(mine, entry)

                    lists.search(wanted, mine, offer, lambda mine=mine: mine[0][0] if len(mine) == top else 1)
        found = [(k, None if not known else -minus, score) for k, mine in enumerate(best) for score, known, minus in mine]
        item, doc_id, score = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return shards.select("doc_id", "missing", "length", "row", "term", "count").mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, terms_each: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of each item of ``items`` (item_id, text).

    Items are taken in blocks of about ``terms_each`` terms, each one pass over
    ``docs``, so what tasks get is bounded. A block's shards are written once.
    Repeated rows of ``docs`` are documents each; rows of one item_id are one
    item with the terms of all. Rows without doc_id rank after others of their
    score, rows without item_id are one item. Texts that are null or hold no
    term match nothing, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    out: DataFrame | None = None
    for block in _blocks(items, terms_each):
        terms = sorted(set().union(*(t for _, t in block)))
        number = {t: k for k, t in enumerate(terms)}
        shards = stored(_shards(docs, terms, SHARD), "shards")
        docs_, words_ = shards.agg(F.sum("docs"), F.sum("words")).first()
        if not words_:
            continue
        seen = shards.select(F.explode(F.arrays_zip("terms", "held_by")).alias("x")).groupBy("x.terms").agg(F.sum("x.held_by").alias("n")).collect()
        weights = np.zeros(len(terms), np.int64)
        for term, n in seen:
            weights[term] = int(np.floor(1000 * np.log((2 * docs_ + 2) / (2 * n + 1))))
        wanted = [np.array(sorted(number[t] for t in ts), np.int64) for _, ts in block]
        found = _found(shards, wanted, weights, docs_, words_, top)
        ids = spark.createDataFrame(pd.DataFrame({"item": np.arange(len(block), dtype=np.int32), "key": [k for k, _ in block]}), "item int, key string")
        part = found.join(F.broadcast(ids), "item").select(F.col("key").cast(items.schema["item_id"].dataType).alias("item_id"), "doc_id", "score")
        out = part if out is None else out.union(part)
    if out is None:
        out = items.limit(0).select("item_id", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", place).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _blocks(items: DataFrame, terms_each: int) -> Iterator[list[tuple[str | None, set[bytes]]]]:
    """Items with their terms, read one partition at a time, in blocks of about ``terms_each`` terms."""
    rows = items.select(F.col("item_id").cast("string").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held: list[tuple[str | None, set[bytes]]] = []
    count = 0
    for key, ts in _items(rows):
        if held and count + len(ts) > terms_each:
            yield held
            held, count = [], 0
        held.append((key, ts))
        count += len(ts)
    if held:
        yield held


def _items(rows: DataFrame) -> Iterator[tuple[str | None, set[bytes]]]:
    now, held = None, None
    for r in rows.orderBy("key").toLocalIterator():
        (ts,) = terms_of(pa.array([r["text"]], pa.large_string()))
        if held is not None and r["key"] == now:
            held |= ts
            continue
        if held is not None:
            yield now, held
        now, held = r["key"], ts
    if held is not None:
        yield now, held


SQL = f"""WITH t AS (SELECT row_number() OVER () AS row, doc_id,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
  s AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM t),
  i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
  p AS (SELECT row, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM t) GROUP BY ALL),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM s) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p WHERE term IN (SELECT term FROM i) GROUP BY term),
  c AS (SELECT i.item_id, p.row, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + (90 * p.n * s.docs) // s.words)))) AS BIGINT) AS score
      FROM i JOIN p USING (term) JOIN w USING (term) CROSS JOIN s GROUP BY i.item_id, p.row, p.doc_id),
  r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0)
  SELECT * FROM r WHERE rank <= {TOP}"""
