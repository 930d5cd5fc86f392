"""Feature vectors, imputation, scaling, components and axis order."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locigrid.operators.clustering import kmeans_by_key
from locigrid.operators.joins import join_null_safe
from locigrid.operators.linkage import TAIL, average_cost, followed, merge_tree
from locigrid.operators.scans import ordered_index
from locigrid.operators.shape import min_evidence
from locigrid.session import cut_lineage, sized


def feature_index(df: DataFrame, feature: str) -> DataFrame:
    """Distinct features numbered from 0 in sorted order."""
    return ordered_index(df.select(feature).distinct(), [feature], "feature_id")


def dense_array(ids: Column, values: Column, size: int) -> Column:
    """Array of ``size`` values with NULL where an id is missing; ``ids`` are
    sorted. Built from the gaps between ids, in time linear in ``size``."""
    missing = F.lit(None).cast("double")
    # ids before position i, -1 before the first
    before = F.concat(F.array(F.lit(-1).cast("long")), ids)
    filled = F.transform(
        F.arrays_zip(ids.alias("id"), F.slice(before, F.lit(1), F.size(ids)).alias("prev"), values.alias("v")),
        lambda x: F.concat(
            F.array_repeat(missing, (x["id"] - x["prev"] - 1).cast("int")), F.array(x["v"].cast("double"))
        ),
    )
    tail = F.array_repeat(missing, (F.lit(size - 1) - F.element_at(ids, -1)).cast("int"))
    return F.concat(F.flatten(filled), tail)


def feature_vectors(
    df: DataFrame, rows: Sequence[str], feature: str, value: str, index: DataFrame
) -> DataFrame:
    """One dense array per row key, NULL for missing cells.

    ``df`` holds one value per row key and feature, so a collected list is never
    longer than the feature index.
    """
    size = index.count()
    entries = F.sort_array(F.collect_list(F.struct("feature_id", F.col(value).alias("v"))))
    packed = df.join(index, feature).groupBy(*rows).agg(entries.alias("e"))
    dense = dense_array(F.col("e.feature_id"), F.col("e.v"), size)
    return packed.select(*rows, dense.alias("features"))


def vectors_to_long(
    vectors: DataFrame, rows: Sequence[str], index: DataFrame, value: str
) -> DataFrame:
    long = vectors.select(*rows, F.posexplode("features").alias("feature_id", value))
    return long.join(index, "feature_id").drop("feature_id")


def impute_within(
    df: DataFrame, feature: str, value: str, index: DataFrame, row: str = "contig", group: str = "bin"
) -> DataFrame:
    """Row vectors in which a missing cell takes the mean of its group, or 0 if
    the group has no value.

    Only one packed row per key is shuffled, never the row by feature grid.
    """
    rows = feature_vectors(df, [row, group], feature, value, index)
    means = df.groupBy(group, feature).agg(F.avg(value).alias("__mean"))
    groups = feature_vectors(means, [group], feature, "__mean", index)
    filled = F.zip_with("features", "__means", lambda x, m: F.coalesce(x, m, F.lit(0.0)))
    joined = rows.join(groups.withColumnRenamed("features", "__means"), group)
    return joined.select(row, group, filled.alias("features"))


def impute_unbinned(
    df: DataFrame, feature: str, value: str, index: DataFrame, row: str = "contig"
) -> DataFrame:
    """Row vectors over the indexed features, missing cells 0."""
    rows = feature_vectors(df, [row], feature, value, index)
    zero = F.transform("features", lambda x: F.coalesce(x, F.lit(0.0)))
    return rows.select(row, zero.alias("features"))


class Standardiser:
    """Zero mean and unit population deviation, learned from one table and
    applied to others. A constant column becomes 0 where it was learned."""

    def __init__(self, mean: Sequence[float], scale: Sequence[float]) -> None:
        self.mean, self.scale = list(mean), list(scale)

    @classmethod
    def fit(cls, vectors: DataFrame, column: str = "features") -> Standardiser:
        if vectors.isEmpty():
            raise ValueError("nothing to learn a scale from")
        # One row whose size is the number of features.
        stats = vectors.select(
            Summarizer.metrics("mean", "variance", "count")
            .summary(array_to_vector(F.col(column)))
            .alias("s")
        ).first()["s"]
        n = stats["count"]
        population = np.asarray(stats["variance"].toArray()) * ((n - 1) / n if n > 1 else 0.0)
        scale = np.sqrt(population)
        scale[scale < 1e-12] = 1.0
        return cls(stats["mean"].toArray().tolist(), scale.tolist())

    def apply(self, vectors: DataFrame, column: str = "features") -> DataFrame:
        centre, scale = F.lit(self.mean), F.lit(self.scale)
        shifted = F.zip_with(F.col(column), centre, lambda x, m: x - m)
        return vectors.withColumn(column, F.zip_with(shifted, scale, lambda x, s: x / s))


class Components:
    """Principal components of centred vectors, kept up to a variance share or a
    fixed number."""

    def __init__(self, model, k: int) -> None:
        self.model, self.k = model, k

    @classmethod
    def fit(
        cls, vectors: DataFrame, share: float | None = 0.90, k: int | None = None, column: str = "features"
    ) -> Components:
        width = len(vectors.select(column).first()[0])
        frame = vectors.select(array_to_vector(F.col(column)).alias("__v"))
        model = PCA(k=k or width, inputCol="__v", outputCol="__p").fit(frame)
        if k is None:
            cumulative = np.cumsum(model.explainedVariance.toArray())
            # the fewest components whose cumulative share is over the limit
            k = min(width, int(np.searchsorted(cumulative, share, side="right")) + 1)
        return cls(model, k)

    def apply(self, vectors: DataFrame, column: str = "features") -> DataFrame:
        frame = vectors.withColumn("__v", array_to_vector(F.col(column)))
        projected = self.model.transform(frame)
        kept = F.slice(vector_to_array("__p"), 1, self.k)
        return projected.withColumn(column, kept).drop("__v", "__p")


def evidence_sweep(df: DataFrame, limits: Sequence[float], min_cov: float = 0.0) -> DataFrame:
    """The table once per evidence limit, each copy filtered by its own limit and
    tagged with it. Copies and filter stay in one narrow stage."""
    levels = F.explode(F.array(*[F.lit(float(x)) for x in sorted(limits)]))
    passed = min_evidence(df, min(limits), min_cov, strict=False)
    weight = F.col("n_motif_obs").cast("double") * F.col("mean_read_cov")
    return passed.withColumn("limit", levels).filter(weight >= F.col("limit"))


def clustered_per_limit(swept: DataFrame, feature: str, value: str, k: int, single: bool = False) -> DataFrame:
    """limit, bin, contig and cluster: rows of each limit imputed within their bins and clustered.

    ``swept`` has limit, bin, contig, feature and value. Bins left with one
    contig at a limit are not clustered there, unless ``single``. Limits are keys
    of one job, so a cell of one limit never fills a gap of another.
    """
    cells = swept.groupBy("limit", "bin", "contig", feature).agg(F.avg(value).alias("x"))
    if not single:
        alone = cells.groupBy("limit", "bin").agg(F.count_distinct("contig").alias("n")).filter("n > 1").drop("n")
        cells = cells.join(sized(alone), ["limit", "bin"])
    key = lambda name: F.to_json(F.struct("limit", name))
    cells = cut_lineage(cells.select(key("contig").alias("contig"), key("bin").alias("bin"), feature, "x"))
    index = cut_lineage(feature_index(cells, feature))
    vectors = cut_lineage(impute_within(cells, feature, "x", index))
    limit = F.get_json_object("contig", "$.limit")
    points = vectors.select(limit.alias("key"), F.col("contig").alias("id"), "features")
    labels = kmeans_by_key(points, k).select(F.col("id").alias("contig"), "cluster")
    named = vectors.join(labels, "contig")
    return named.select(
        limit.cast("double").alias("limit"), F.get_json_object("bin", "$.bin").alias("bin"), F.get_json_object("contig", "$.contig").alias("contig"), "cluster"
    )


def leaf_order(vectors: DataFrame, group: Sequence[str], row: str, tail: int = TAIL) -> DataFrame:
    """Axis order of the rows of each group: ``leaf`` then key.

    The order of the leaves under average linkage on squared Euclidean distance;
    the cluster with the smaller first key stands first. Rows with equal vectors
    share a leaf, the number of rows that stand before them.
    """
    rows = vectors.withColumn("__f", F.col("features").cast("array<double>"))
    groups = cut_lineage(ordered_index(rows.select(*group).distinct(), list(group), "__g"))
    rows = cut_lineage(join_null_safe(rows, groups, group))
    leaves = rows.groupBy("__g", "__f").agg(F.count("*").alias("__w"), F.min(row).alias("__first"))
    leaves = cut_lineage(ordered_index(leaves, ["__g", "__first"], "__id"))
    merges = merge_tree(leaves.select(*[F.col(f"__{c}").alias(n) for c, n in zip("g id f w".split(), "g id c w".split())]), average_cost, tail)
    places = followed(merges).select(F.col("g").alias("__g"), F.col("id").alias("__id"), "ahead")
    placed = leaves.join(places, ["__g", "__id"], "left").select("__g", "__f", F.coalesce("ahead", F.lit(0).cast("long")).alias("leaf"))
    return rows.join(sized(placed), ["__g", "__f"]).select(*group, row, "leaf")
