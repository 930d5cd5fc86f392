"""Near neighbours by inverted lists with residual codes, and exact re-ranking.

Every row is in the list of its nearest centre and leaves there a code of one
byte for every two numbers of its difference from the centre. A query reads the
codes of the lists it probes, estimates distances by the vectors the codes stand
for, and only a short list of rows is compared exactly. Centres and codes are
fitted on a bounded sample; the index covers all rows. ``neighbours.nearest``
stays the exact way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locigrid.operators import tiles
from locigrid.operators.neighbours import Cells, _matrix
from locigrid.operators.scans import seeded_hash
from locigrid.session import written

# Rows the centres and codes are fitted on, and the most centres.
SAMPLE = 8_192
MAX_LISTS = 1_024
# Numbers that share one byte of code.
PER_CODE = 2
# Rows of near lists compared as one block, and queries that meet it at a time.
BLOCK = 32_768
# Distances worked out at a time.
TABLE = 1 << 16
# Share of the true neighbours of sampled rows that the probed lists must hold.
HELD = 0.97


def _powers(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Sums of the p-th powers of the differences of all rows of ``a`` from all rows of ``b``."""
    out = np.zeros((len(a), len(b)))
    # as many rows at a time as stay at hand
    lot = max(1, TABLE // max(len(b), 1))
    for low in range(0, len(a), lot):
        part = a[low : low + lot]
        for j in range(a.shape[1]):
            step = np.abs(part[:, j, None] - b[None, :, j])
            out[low : low + lot] += step * step if p == 2 else step * step * step if p == 3 else step**p
    return out


def _homes(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row by Euclid, the first of equal ones. Products choose, and what they leave open is measured."""
    out = np.zeros(len(x), np.int64)
    lot = max(1, 4 * TABLE // max(len(centres), 1))
    for low in range(0, len(x), lot):
        part = x[low : low + lot]
        product = tiles.Products(part, centres)
        if product.finite:
            squares = product.squares(slice(None), slice(None))
            home = squares.argmin(axis=1)
            most = squares[np.arange(len(part)), home] + 2 * product.error
            open_ = np.flatnonzero((squares <= most[:, None]).sum(axis=1) > 1)
        else:
            home, open_ = np.zeros(len(part), np.int64), np.arange(len(part))
        if len(open_):
            home[open_] = _powers(part[open_], centres, 2).argmin(axis=1)
        out[low : low + lot] = home
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centres of at most ``k`` different rows of a sample, from evenly spaced ones."""
    centres = np.unique(x, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(k, len(centres))).astype(int)]
    for _ in range(rounds):
        at = _homes(x, centres)
        size = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Codes:
    """Centres of the lists, codebooks of the residuals, and how many lists a query probes. All bounded by the sample."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int
    p: float

    @classmethod
    def fit(cls, base: DataFrame, k: int, p: float = 2.0, seed: int = 11) -> Codes:
        """``base`` holds id and features. Probes are as many as the neighbours of sampled rows need."""
        n = base.count()
        order = seeded_hash(seed, F.col("id"))
        picked = base.select("features").orderBy(order).limit(SAMPLE).collect()
        x = np.array([r[0] for r in picked], float).reshape(len(picked), -1)
        centres = _kmeans(x, max(1, min(MAX_LISTS, math.isqrt(max(n, 1)))))
        home = _homes(x, centres)
        rest = x - centres[home]
        books = [_kmeans(rest[:, j : j + PER_CODE], 256) for j in range(0, x.shape[1], PER_CODE)]
        # where, in the order of a query's lists, its true neighbours in the sample are
        asked = x[:256]
        near = np.argsort(_powers(asked, x, p), axis=1)[:, : k + 1]
        place = np.argsort(np.argsort(_powers(asked, centres, p), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
        probes = int(needed[min(len(needed) - 1, math.ceil(HELD * len(needed)))]) + 1 if len(needed) else 1
        return cls(centres, books, probes, p)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of each row."""
        home = _homes(x, self.centres)
        rest = x - self.centres[home]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for j, book in enumerate(self.books):
            codes[:, j] = _homes(rest[:, PER_CODE * j : PER_CODE * (j + 1)], book)
        return home, codes

    def decode(self, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that lists and codes stand for."""
        out = self.centres[home]
        for j, book in enumerate(self.books):
            out[:, PER_CODE * j : PER_CODE * (j + 1)] += book[codes[:, j]]
        return out


def indexed(base: DataFrame, codes: Codes) -> DataFrame:
    """id, list and code of every row, written once."""
    id_type = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                home, code = codes.encode(_matrix(pdf["features"]))
                yield pd.DataFrame({"id": pdf["id"], "list": home.astype("int32"), "code": [c.tobytes() for c in code]})

    return written(base.select("id", "features").mapInPandas(run, f"id {id_type}, list int, code binary"), "codes")


def nearest_by_codes(base: DataFrame, queries: DataFrame, k: int, p: float = 2.0, shortlist: int | None = None, codes: Codes | None = None) -> DataFrame:
    """``id, neighbour, distance, rank``: for each query the ``k`` nearest of its short list, ties by id.

    ``shortlist`` rows per query, ten times ``k`` unless given, are compared
    exactly. Near lists are met together in blocks, a list of many rows in
    several, and queries are dealt to parts; a block returns a short list per
    query, never its pairs.
    """
    most = shortlist or 10 * k
    base = written(base.select("id", F.col("features").cast("array<double>").alias("features")), "base")
    queries = written(queries.select(F.col("id").alias("query"), F.col("features").cast("array<double>").alias("features")), "asked")
    if base.isEmpty():
        return queries.select(F.col("query").alias("id"), F.lit(None).cast(base.schema["id"].dataType).alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    codes = codes or Codes.fit(base, k, p)
    index = indexed(base, codes).withColumnRenamed("list", "cell")
    lists = len(codes.centres)
    cells = Cells(codes.centres, 2.0, BLOCK)
    cells.count = np.zeros(lists, int)
    for r in index.groupBy("cell").count().collect():  # one row per list
        cells.count[r[0]] = r[1]
    cells.pack()

    @F.pandas_udf("struct<lists array<int>, reached array<int>>")
    def probed(asked: pd.Series) -> pd.DataFrame:
        d = _powers(_matrix(asked), codes.centres, p)
        near = np.argsort(d, axis=1, kind="stable")[:, : codes.probes]
        reached = [np.unique(np.concatenate([np.arange(cells.first[c], cells.first[c] + cells.split[c]) for c in some if cells.count[c]] or [np.zeros(0, int)])) for some in near]
        return pd.DataFrame({"lists": list(near.astype("int32")), "reached": [r.astype("int32") for r in reached]})

    wanted = written(queries.withColumn("__p", probed("features")).select("query", "features", "__p.*"), "probed")
    query_type, id_type = (t.dataType.simpleString() for t in (queries.schema["query"], base.schema["id"]))
    left, right = cells.blocks(index, wanted, "id", "query")

    def scan(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame({"query": [], "neighbour": [], "guess": [], "block": []})
        rows = rows.sort_values("id", ignore_index=True)
        home = rows["cell"].to_numpy()
        coded = codes.decode(home, np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1))
        looks = np.zeros((len(asked), lists), bool)
        some = asked["lists"].to_numpy()
        looks[np.repeat(np.arange(len(asked)), [len(x) for x in some]), np.concatenate(some)] = True
        place, guess = tiles.closest(_matrix(asked["features"]), coded, most, p, probed=(looks, home))
        i, n = np.nonzero(place < len(rows))
        ids, query = rows["id"].to_numpy()[place[i, n]], asked["query"].to_numpy()[i]
        return pd.DataFrame({"query": query, "neighbour": ids, "guess": guess[i, n], "block": asked["block"].iloc[0]})

    found = left.cogroup(right).applyInPandas(scan, f"query {query_type}, neighbour {id_type}, guess double, block int")
    # the short lists of a query's blocks
    by_guess = Window.partitionBy("query").orderBy("guess", "neighbour")
    few = found.withColumn("n", F.row_number().over(by_guess)).filter(F.col("n") <= most)
    # ``most`` rows per query
    few = few.groupBy("query").agg(F.collect_list("neighbour").alias("few"), F.collect_set("block").alias("reached"))
    few = written(few.join(queries, "query"), "few")
    left, right = cells.blocks(index.select("id", "cell").join(base, "id"), few, "id", "query")

    def measure(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame({"query": [], "neighbour": [], "distance": []})
        rows = rows.sort_values("id", ignore_index=True)
        ids, some = rows["id"].to_numpy(), asked["few"].to_numpy()
        i, names = np.repeat(np.arange(len(asked)), [len(x) for x in some]), np.concatenate(some)
        j = np.minimum(np.searchsorted(ids, names), len(ids) - 1)
        here = ids[j] == names
        i, j = i[here], j[here]
        distance = tiles.pair_distances(_matrix(asked["features"]), _matrix(rows["features"]), i, j, p)
        return pd.DataFrame({"query": asked["query"].to_numpy()[i], "neighbour": ids[j], "distance": distance})

    measured = left.cogroup(right).applyInPandas(measure, f"query {query_type}, neighbour {id_type}, distance double")
    nearest_first = Window.partitionBy("query").orderBy("distance", "neighbour")
    ranked = measured.withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("id"), "neighbour", "distance", "rank")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (id, neighbour) that were found."""
    both = exact.join(found.select("id", "neighbour").withColumn("hit", F.lit(1)), ["id", "neighbour"], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]
