"""Depth and coverage over genomic intervals (0-based, half-open).

Depth is a prefix sum of +1 at each start and -1 at each end. Equal positions
are summed before the shuffle, and the prefix sum runs per tile of the
coordinate, so neither a deep spot nor a long contig ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locigrid.operators.scans import OrderedScan

TILE = 65_536


def _tile(tile: int):
    return F.floor(F.col("pos") / F.lit(tile))


def _steps(intervals: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Net change of depth at each position; ``ask`` marks the extra points."""
    change = F.explode(
        F.array(
            F.struct(F.col("start").cast("long").alias("pos"), F.lit(1).cast("long").alias("delta")),
            F.struct(F.col("end").cast("long").alias("pos"), F.lit(-1).cast("long").alias("delta")),
        )
    )
    rows = intervals.filter(F.col("start") < F.col("end")).select("contig", change.alias("c"))
    rows = rows.select("contig", "c.pos", "c.delta", F.lit(0).alias("ask"))
    if points is not None:
        rows = rows.unionByName(
            points.select("contig", "pos", F.lit(0).cast("long").alias("delta"), F.lit(1).alias("ask"))
        )
    return rows.groupBy("contig", "pos").agg(F.sum("delta").alias("delta"), F.max("ask").alias("ask"))


def depth_segments(
    intervals: DataFrame, lengths: DataFrame | None = None, tile: int = TILE
) -> DataFrame:
    """Maximal segments of constant depth. With ``lengths`` the segments cover
    each contig whole, zero depth included; without, only covered ones are given."""
    points = None
    if lengths is not None:
        edges = F.explode(F.array(F.lit(0).cast("long"), F.col("length").cast("long")))
        points = lengths.select("contig", edges.alias("pos"))
    steps = _steps(intervals, points).filter((F.col("delta") != 0) | (F.col("ask") == 1))
    scan = (
        OrderedScan(steps, ["contig"], ["pos"], _tile(tile))
        .running_sum(F.col("delta"), "depth")
        .lead(F.col("pos"), "end")
    )
    rows = scan.result().filter(F.col("end").isNotNull())
    if lengths is None:
        rows = rows.filter(F.col("depth") > 0)
    return rows.select("contig", F.col("pos").alias("start"), "end", "depth")


def mean_depth(intervals: DataFrame, reads: DataFrame, tile: int = TILE) -> DataFrame:
    """Mean depth of each interval: overlapped bases over length.

    The bases covered up to a position form a curve, and an interval needs its
    value at two points. So reads and interval ends are merged in one ordered
    scan, and no pair of an interval and a read is ever built.
    """
    spans = intervals.select("contig", F.col("start").cast("long"), F.col("end").cast("long")).distinct()
    ends = F.array(
        F.struct(F.col("start").alias("pos"), F.lit(-1).alias("side")),
        F.struct(F.col("end").alias("pos"), F.lit(1).alias("side")),
    )
    ends = spans.select("*", F.inline(ends))
    # covered(x) = sum of delta * (x - pos) over pos <= x
    scan = (
        OrderedScan(_steps(reads, ends), ["contig"], ["pos"], _tile(tile))
        .running_sum(F.col("delta"), "__n")
        .running_sum(F.col("delta") * F.col("pos"), "__weighted")
    )
    curve = scan.result().filter(F.col("ask") == 1).select(
        "contig", "pos", (F.col("__n") * F.col("pos") - F.col("__weighted")).alias("covered")
    )
    bases = (
        ends.join(curve, ["contig", "pos"])
        .groupBy("contig", "start", "end")
        .agg(F.sum(F.col("side") * F.col("covered")).alias("__bases"))
    )
    share = F.try_divide(F.col("__bases").cast("double"), F.col("end") - F.col("start"))
    means = bases.select("contig", "start", "end", share.alias("mean_depth"))
    return intervals.join(means, ["contig", "start", "end"]).select(*intervals.columns, "mean_depth")


def coverage_fraction(
    segments: DataFrame, lengths: DataFrame, min_fraction: float = 0.7
) -> DataFrame:
    """Covered bases over length per contig and sample, at or over a minimum."""
    keys = [c for c in ("contig", "sample") if c in segments.columns]
    covered = (
        segments.filter(F.col("depth") > 0)
        .groupBy(*keys)
        .agg(F.sum(F.col("end") - F.col("start")).alias("__bases"))
    )
    share = F.try_divide(F.col("__bases").cast("double"), F.col("length"))
    return (
        covered.join(lengths, "contig")
        .withColumn("coverage", share)
        .filter(F.col("coverage") >= min_fraction)
        .select(*keys, "coverage")
    )


def unique_mapping(coverage: DataFrame, minimum: float = 0.9) -> DataFrame:
    """Contigs that map well to exactly one sample, which becomes their bin."""
    good = coverage.filter(F.col("coverage") > minimum)
    return (
        good.groupBy("contig")
        .agg(F.count("*").alias("__n"), F.min("sample").alias("bin"))
        .filter(F.col("__n") == 1)
        .drop("__n")
        .orderBy("bin", "contig")
    )


def depth_summary(segments: DataFrame) -> DataFrame:
    """Mean and sample deviation of the depth over the segments of a contig."""
    return segments.groupBy("contig").agg(
        F.avg("depth").alias("mean_depth"), F.stddev_samp("depth").alias("sd_depth")
    )
