"""Near-duplicates by SimHash, found in BK-trees.

Fingerprints at most four bits apart agree on two of six bands of bits, so every
pair meets in one of fifteen buckets keyed by two bands. In a bucket the
fingerprints form a BK-tree: children hang under their parent by their Hamming
distance to it, and a search follows only edges within the radius of its own
distance. A bucket is a shard; shards travel to tasks by the shuffle, since all
of them together have no size bound that would let them be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame

from locigrid.llm.common import binary_or_empty, stored
from locigrid.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
# Bits of the bands, from the lowest.
BANDS = (11, 11, 11, 11, 10, 10)
# Rows of a bucket searched as one tree; larger ones are cut into shards.
SHARD = 4096
# Rows handled, and steps of searches held, at a time.
ROWS = 1 << 18
STEPS = 1 << 21


def fingerprint(text: bytes) -> int:
    """SimHash of a text over shingles of four words, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    count = len(words) - SHINGLE + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, count)
    votes = np.zeros(64, np.int64)
    for low in range(0, count, 1 << 16):
        part = hashes[low : low + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp (64 bits as a long) of every row; a missing text is empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    text = binary_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def bucket_keys(fp: Column) -> Column:
    """The fifteen buckets of a fingerprint: two bands and which they are."""
    starts = np.cumsum((0, *BANDS)).tolist()
    band = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, BANDS)]
    keys = []
    for k, (i, j) in enumerate(combinations(range(len(BANDS)), 2)):
        keys.append(F.shiftleft(F.shiftleft(F.lit(k).cast("long"), 11).bitwiseOR(band[i]), 11).bitwiseOR(band[j]))
    return F.array(*keys)


def grow_trees(codes: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent and edge of every item in the tree of its bucket; a root is its own parent.

    All trees grow at once. An item descends along the edge of its distance; of
    those that find no child there, the first takes the place.
    """
    parent, edge = root.copy(), np.zeros(len(codes), np.int64)
    active = np.flatnonzero(root != np.arange(len(codes)))
    at = root[active]
    while len(active):
        distance = np.bitwise_count(codes[active] ^ codes[at]).astype(np.int64)
        place = at * 128 + distance
        _, first, group = np.unique(place, return_index=True, return_inverse=True)
        won = active[first]
        parent[won], edge[won] = at[first], distance[first]
        rest = np.ones(len(active), bool)
        rest[first] = False
        active, at = active[rest], won[group[rest]]
    return parent, edge


def search_trees(codes: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of items of one tree within ``radius``, the later item first."""
    parent, edge = grow_trees(codes, root)
    child = np.flatnonzero(parent != np.arange(len(codes)))
    place = parent[child] * 128 + edge[child]
    order = np.argsort(place, kind="stable")
    child, place = child[order], place[order]
    sizes = np.bincount(root, minlength=len(codes))
    load = np.cumsum(sizes[root])
    found, low = [], 0
    while low < len(codes):
        done = load[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(load, done + STEPS, "right")))
        query = np.arange(low, high)
        query = query[root[query] != query]
        node = root[query]
        while len(query):
            distance = np.bitwise_count(codes[query] ^ codes[node]).astype(np.int64)
            hit = distance <= radius
            found.append((query[hit], node[hit]))
            begin = np.searchsorted(place, node * 128 + np.maximum(distance - radius, 0), "left")
            end = np.searchsorted(place, node * 128 + distance + radius, "right")
            width = end - begin
            step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            query, node = np.repeat(query, width), child[np.repeat(begin, width) + step]
            # what hangs under a later item is later too, and asks for itself
            earlier = node < query
            query, node = query[earlier], node[earlier]
        low = high
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([q for q, _ in found]), np.concatenate([n for _, n in found])


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least item each item is linked with, directly or by way of others."""
    label = np.arange(n)
    while len(left):
        # labels are roots here: lowering a root takes its whole tree along, and a link inside one tree has done its part
        a, b = label[left], label[right]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        above = label[label]
        while (above != label).any():
            label, above = above, above[above]
        differ = label[left] != label[right]
        left, right = left[differ], right[differ]
    return label


def _links(keys: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what belongs together in each bucket, at most one per row. Keys come sorted."""
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    begin = np.flatnonzero(first)
    sizes = np.diff(np.append(begin, len(keys)))
    alone = np.repeat(sizes == 1, sizes)
    codes, sizes = codes[~alone], sizes[sizes > 1]
    root = np.repeat(np.cumsum(sizes) - sizes, sizes)
    label = spanning(len(codes), *search_trees(codes, root, radius))
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return codes[moved], codes[label[moved]]


def _batch(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "a", "b"])


def search_buckets(rows: DataFrame, radius: int, limit: int | None) -> DataFrame:
    """kind 0: links (a, b) found in the buckets of ``rows`` (key, fp). kind 1: rows (key, fp) of buckets over ``limit``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            keys = np.concatenate([k for k, _ in held])
            codes = np.concatenate([c for _, c in held])
            # the last bucket may go on in the next batch, unless it is passed on anyway
            upto = len(keys) if last else int(np.searchsorted(keys, keys[-1], "left"))
            if limit is not None and len(keys) - upto > limit:
                upto = len(keys)
                late.add(int(keys[-1]))
            held = [(keys[upto:], codes[upto:])] if upto < len(keys) else []
            size = len(keys) - upto
            keys, codes = keys[:upto], codes[:upto]
            if not len(keys):
                return
            if limit is not None:
                different, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
                large = (count > limit) | np.isin(different, list(late))
                big = large[inverse]
                if big.any():
                    yield _batch(1, keys[big].view(np.uint64), codes[big])
                    keys, codes = keys[~big], codes[~big]
            if len(keys):
                yield _batch(0, *_links(keys, codes, radius))

        late: set[int] = set()
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            size += batch.num_rows
            if size >= ROWS:
                yield from settle(False)
        if size:
            yield from settle(True)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "kind int, a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between the different fingerprints in ``fps`` that connect all within ``radius`` bits.

    Buckets of more rows than a shard are cut into shards of about that size,
    and every two shards, and each with itself, are searched as one tree; all
    links of the bucket are so found while no task holds more than two shards.
    """
    if radius > RADIUS:
        raise ValueError("two of six bands agree only up to four differing bits")
    rows = fps.select(F.explode(bucket_keys(F.col("fp"))).alias("key"), "fp")
    found = stored(search_buckets(rows, radius, shard), "buckets")
    out = found.filter("kind = 0").select("a", "b")
    large = found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if not large.isEmpty():
        parts = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("parts"))
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
        cells = large.join(parts, "key").select("key", "fp", own.alias("own"), other)
        cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        # two cells of one hash would only be searched together
        out = out.union(stored(search_buckets(cells.select(cell.alias("key"), "fp"), radius, None), "shards").select("a", "b"))
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id and text_hash of every row of ``docs``.

    The component is the smallest doc_id reachable over fingerprints at most
    ``radius`` bits apart. Copies share a fingerprint and are searched once. Texts
    without words have fingerprint zero and are linked like others. Rows without
    doc_id belong to components and name none; a component of such rows alone is
    null. Repeated rows are returned each.
    """
    marked = stored(fingerprints(docs), "fingerprints")
    different = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "different")
    label = components(links(different.select("fp"), radius))
    linked = different.join(label, different["fp"] == label["node"]).select("fp", "label", "least")
    group = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    of_linked = linked.join(group, "label").select("fp", "component_id")
    of_fp = different.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # written, so that the join deals both sides out itself and can split a fingerprint of very many rows
    of_fp = stored(of_fp, "labels")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(of_fp, "fp").select("doc_id", digits, "component_id", "text_hash")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with all columns of ``docs``.

    Of several texts under that doc_id one stays. Rows without doc_id stay once
    per fingerprint in components that have no doc_id at all.
    """
    found = stored(near_duplicates(docs), "components")
    alone = F.when(F.col("component_id").isNull(), F.col("fingerprint"))
    heads = found.filter("doc_id <=> component_id").groupBy(F.col("component_id").alias("__doc"), alone.alias("__alone"))
    keep = heads.agg(F.min(F.struct("text_hash", "fingerprint")).alias("__pick"), F.count(F.lit(1)).alias("__rows")).select(
        "__doc", "__rows", F.col("__pick.text_hash").alias("__hash")
    )
    same = docs["doc_id"].cast("long").eqNullSafe(keep["__doc"]) & (F.xxhash64(binary_or_empty()) == keep["__hash"])
    kept = docs.join(keep.hint("shuffle_hash"), same, "left_semi")
    return kept if keep.filter("__rows > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])
