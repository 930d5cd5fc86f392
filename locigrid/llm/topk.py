"""Exact search for the largest inner products.

Vectors are processed by descending length, in blocks. A bounded head of the
longest gives every query a first lower limit for its k-th score, and every wave
of blocks raises it; a block whose longest vector cannot reach the limit of a
query is never sent to it. Inside a
block, vectors and queries are turned so that the leading coordinates hold most
of the mass; the product of these and the Cauchy-Schwarz bound on the rest show
which pairs can still reach the limit, and only those are multiplied in full.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from locigrid.llm.common import stored

SCALE = 64
TOP = 20
# Longest vectors that give the first limits; broadcast, so bounded.
HEAD = 2048
# Vectors of a block: as many as make about BLOCKS of them, within limits.
BLOCKS, LEAST_ROWS, MOST_ROWS = 64, 1024, 32_768
QUERY_ROWS = 4096
# Coordinates of the partial sums, and vectors taken at a time.
LEADING = 16
STEP = 512
# Score of a place not yet taken; its negative is a number too.
EMPTY = -np.iinfo(np.int64).max
# Blocks searched before the limits are raised for the first time; then twice as many each time.
FIRST_WAVE = 4
CHOSEN = "query_id long, query_mark long, vec_id long, score long"


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, mark, norm and v: vectors of whole numbers, floor(scale * x).

    Vectors that are missing, or hold a missing or non-finite component, and
    rows without vec_id take no part. Rows repeated whole count once. ``mark``
    tells vectors of one vec_id apart. Components are taken to be below 2^24 in
    size, so that products are exact.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e * scale))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)
    return rows.distinct().select("vec_id", F.xxhash64("v").alias("mark"), F.sqrt(norm).alias("norm"), F.size("v").alias("width"), "v")


def _matrix(column: pa.Array | pd.Series, width: int) -> np.ndarray:
    return np.array(list(column), np.float64).reshape(-1, width)


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors of a width, strongest first.

    Tasks sum outer products; the driver gets one small matrix per task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = _matrix(batch.column(0).to_pylist(), width)
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["sums"])

    summed = vectors.filter(F.col("width") == width).select("v").mapInArrow(run, "sums array<double>")
    cells = summed.select(F.posexplode("sums").alias("cell", "x")).groupBy("cell").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(width * width)
    for r in cells:
        total[r["cell"]] = r["x"]
    return np.linalg.eigh(total.reshape(width, width))[1][:, ::-1]


class Best:
    """The best of each query so far, ties to the smaller vec_id, and the score a newcomer must reach."""

    def __init__(self, ids: np.ndarray, top: int, limit: np.ndarray):
        self.ids, self.top = ids, top
        self.scores = np.full((len(ids), top), EMPTY)
        self.found = np.full((len(ids), top), np.iinfo(np.int64).max)
        self.limit = limit.astype(float)

    def offer(self, query: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> None:
        own = vec_id == self.ids[query]
        query, vec_id, score = query[~own], vec_id[~own], score[~own]
        if not len(query):
            return
        touched, query = np.unique(query, return_inverse=True)
        count = np.repeat(np.arange(len(touched)), self.top)
        query = np.concatenate((count, query))
        score = np.concatenate((self.scores[touched].ravel(), score))
        vec_id = np.concatenate((self.found[touched].ravel(), vec_id))
        order = np.lexsort((vec_id, -score, query))
        query, score, vec_id = query[order], score[order], vec_id[order]
        begin = np.searchsorted(query, np.arange(len(touched)))
        place = begin[:, None] + np.arange(self.top)
        self.scores[touched], self.found[touched] = score[place], vec_id[place]
        last = self.scores[touched, -1]
        full = last > EMPTY
        self.limit[touched[full]] = np.maximum(self.limit[touched[full]], last[full])


def scan(queries: np.ndarray, vectors: np.ndarray, vec_ids: np.ndarray, turn: np.ndarray, best: Best) -> int:
    """Offer ``best`` every vector that can be among the top of a query. Returns the products made in full."""
    order = np.argsort(-(vectors * vectors).sum(1), kind="stable")
    vectors, vec_ids = vectors[order], vec_ids[order]
    turned_q, turned_v = queries @ turn, vectors @ turn
    m = min(LEADING, turn.shape[1])
    rest_q, rest_v = (np.sqrt((x[:, m:] ** 2).sum(1)) for x in (turned_q, turned_v))
    length_q, length_v = (np.sqrt((x * x).sum(1)) for x in (queries, vectors))
    made = 0
    for low in range(0, len(vectors), STEP):
        part = slice(low, low + STEP)
        slack = 1e-9 * length_q * length_v[low] + 1e-6
        # vectors come by falling length: a query out of reach here stays so
        alive = np.flatnonzero(length_q * length_v[low] + slack >= best.limit)
        if not len(alive):
            break
        bound = turned_q[alive, :m] @ turned_v[part, :m].T + np.outer(rest_q[alive], rest_v[part])
        row, column = np.nonzero(bound + slack[alive][:, None] >= best.limit[alive][:, None])
        made += len(row)
        if len(row) > bound.size // 4:
            exact = (queries[alive] @ vectors[part].T)[row, column]
        else:
            exact = np.empty(len(row))
            for a in range(0, len(row), 1 << 16):
                cut = slice(a, a + (1 << 16))
                exact[cut] = np.einsum("ij,ij->i", queries[alive[row[cut]]], vectors[part][column[cut]])
        row = alive[row]
        good = exact >= best.limit[row]
        best.offer(row[good], vec_ids[part][column[good]], np.rint(exact[good]).astype(np.int64))
    return made


def _search_width(vectors: DataFrame, queries: DataFrame, width: int, top: int) -> DataFrame:
    vectors, queries = (x.filter(F.col("width") == width) for x in (vectors, queries))
    turn = rotation(vectors, width)
    # the head: at most HEAD vectors
    head = vectors.orderBy(F.desc("norm"), "vec_id", "mark").limit(HEAD).select("vec_id", "v").collect()
    head_ids = np.array([r["vec_id"] for r in head], np.int64)
    head_rows = _matrix([r["v"] for r in head], width)

    @F.pandas_udf("double")
    def first_limit(ids: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for low in range(0, len(ids), 256):
            q, own = _matrix(rows.iloc[low : low + 256], width), ids.iloc[low : low + 256].to_numpy()
            scores = q @ head_rows.T
            scores[own[:, None] == head_ids[None, :]] = -np.inf
            out.append(np.sort(scores, axis=1)[:, -top] if scores.shape[1] >= top else np.full(len(q), -np.inf))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    count = vectors.count()
    rows = min(MOST_ROWS, max(LEAST_ROWS, count // BLOCKS))
    asked = stored(queries.withColumn("limit", first_limit("vec_id", "v")), "queries")
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    # ranges of length; vectors of one length may be many, so ranges are counted and cut by hash
    shares = [k * rows / max(count, 1) for k in range(1, -(-count // rows))]
    edges = sorted({e for e in vectors.approxQuantile("norm", shares, 0.2 * rows / max(count, 1))}) if shares else []
    band = sum(((F.col("norm") < e).cast("int") for e in edges), F.lit(0))
    banded = vectors.withColumn("band", band)
    # one row per range; blocks are numbered from the longest vectors on
    bands = sorted(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).collect())
    reach, parts, firsts, blocks = [], {}, {}, 0
    for band, n, longest in bands:
        parts[band], firsts[band] = max(1, -(-n // rows)), blocks
        reach.append(F.struct(*[F.lit(x).alias(c) for x, c in ((longest, "longest"), (blocks, "first"), (blocks + parts[band] - 1, "last"))]))
        blocks += parts[band]
    by_band = lambda numbers: F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])[F.col("band")]
    key = F.xxhash64("vec_id", "mark")
    held = banded.withColumn("block", (by_band(firsts) + F.pmod(key, by_band(parts))).cast("int")) if blocks else banded.withColumn("block", F.lit(0))
    held = stored(held.select("block", "vec_id", "v"), "blocks")
    asked = asked.withColumn("group", F.pmod(key, F.lit(groups)).cast("int"))

    def run(query: pa.Table, block: pa.Table) -> pa.Table:
        names = ["query_id", "query_mark", "vec_id", "score"]
        if not query.num_rows or not block.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        ids, marks = (query.column(c).to_numpy() for c in ("vec_id", "mark"))
        best = Best(ids, top, query.column("limit").to_numpy())
        scan(_matrix(query.column("v").to_pylist(), width), _matrix(block.column("v").to_pylist(), width), block.column("vec_id").to_numpy(), turn, best)
        row, place = np.nonzero(best.scores > EMPTY)
        return pa.table([pa.array(x) for x in (ids[row], marks[row], best.found[row, place], best.scores[row, place])], names=names)

    found, low, wave = queries.sparkSession.createDataFrame([], CHOSEN), 0, FIRST_WAVE
    while low < blocks:
        high = min(blocks, low + wave)
        near = F.filter(F.array(*reach), lambda b: (F.col("norm") * b["longest"] * (1 + 1e-9) + 1e-6 >= F.col("limit")) & (b["first"] < high) & (b["last"] >= low))
        sent = asked.withColumn("near", F.explode(near)).select(
            "group", F.explode(F.sequence(F.greatest("near.first", F.lit(low)), F.least("near.last", F.lit(high - 1)))).alias("block"), "vec_id", "mark", "limit", "v"
        )
        part = held.filter((F.col("block") >= low) & (F.col("block") < high))
        part = part.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "block", "vec_id", "v")
        met = sent.groupBy("group", "block").cogroup(part.groupBy("group", "block")).applyInArrow(run, CHOSEN)
        found = stored(_leading(found.union(met), top), "found")
        low, wave = high, 2 * wave
        if low < blocks:
            # what is found raises the limits for the shorter vectors
            least = found.groupBy(F.col("query_id").alias("vec_id"), F.col("query_mark").alias("mark")).agg(
                F.when(F.count(F.lit(1)) >= top, F.min("score")).cast("double").alias("least")
            )
            raised = asked.join(least, ["vec_id", "mark"], "left").withColumn("limit", F.greatest("limit", "least"))
            asked = stored(raised.select(*asked.columns), "queries")
    return found


def _leading(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query_mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).drop("rank")


def top_inner_products(embeddings: DataFrame, queries: DataFrame, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``top`` largest inner products.

    ``queries`` are rows like those of ``embeddings``, against all of which they
    are compared except rows of their own vec_id. Ties go to the smaller vec_id;
    fewer rows are returned where there are fewer. Vectors of different widths
    have no product. Repeated rows count once. No two blocks larger than stated
    above meet in a task, whatever vectors are copies of each other.
    """
    vectors = stored(quantised(embeddings, scale), "vectors")
    asked = quantised(queries, scale)
    # widths are few; each has blocks of its own
    widths = [r["width"] for r in asked.select("width").distinct().collect()]
    found = None
    for width in sorted(w for w in widths if w > 0):
        part = _search_width(vectors, asked, width, top)
        found = part if found is None else found.union(part)
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], CHOSEN)
    order = Window.partitionBy("query_id", "query_mark").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
