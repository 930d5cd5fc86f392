"""Joins. Which side is broadcast is left to the planner, which checks sizes;
a hint appears only where the size is bounded by construction."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locigrid.session import sized

# Values of a dimension that fit into one broadcast array.
DIMENSION_BLOCK = 50_000


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi join in which a missing key matches a missing key; keys come once,
    from the left side."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = F.lit(True)
    for i, key in enumerate(keys):
        term = left[key].eqNullSafe(renamed[f"__r_{key}"])
        condition = term if i == 0 else condition & term
    joined = left.join(renamed, condition, how)
    if how in ("right", "full"):
        joined = joined.withColumns(
            {k: F.coalesce(F.col(k), F.col(f"__r_{k}")) for k in keys}
        )
    return joined.drop(*[f"__r_{k}" for k in keys])


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def natural_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every shared column name; missing matches missing."""
    keys = shared_columns(left, right)
    if not keys:
        raise ValueError("no shared columns")
    return join_null_safe(left, right, keys, "left")


def keyed_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left")


def inner(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "inner")


def complete_to(
    df: DataFrame, template: DataFrame, keys: Sequence[str], fill: dict[str, object]
) -> DataFrame:
    """Every template row appears; columns without data take ``fill``."""
    return template.join(df, list(keys), "left").fillna(fill)


def semi(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(ids, list(keys), "left_semi")


def anti(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a match; a missing key never matches, so it is kept."""
    return df.join(ids, list(keys), "left_anti")


def pair_with_values(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Every row of ``df`` with every row of the distinct ``dimension``.

    The grid is the result asked for, so its size is fixed by the inputs. The
    dimension is packed into arrays that are unpacked next to each row. One
    array is sent to every task when its row count, which is checked, allows;
    beyond that the arrays are matched by block number, with the rows salted so
    that the work spreads evenly.
    """
    values = dimension.distinct()
    blocks = max(1, math.ceil(values.count() / DIMENSION_BLOCK))
    if blocks == 1:
        packed = values.agg(F.collect_list(F.struct("*")).alias("__values"))
        return df.select(*df.columns, F.inline(packed.scalar()))
    number = F.pmod(F.xxhash64(*values.columns), F.lit(blocks)).cast("int").alias("__block")
    packed = values.groupBy(number).agg(F.collect_list(F.struct("*")).alias("__values"))
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
    tagged = df.withColumn("__salt", salt).withColumn(
        "__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    copies = packed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return tagged.join(copies, ["__salt", "__block"]).select(*df.columns, F.inline("__values"))


def densify(
    data: DataFrame, dimensions: Sequence[DataFrame], fill: dict[str, object]
) -> DataFrame:
    """All combinations of the dimension tables with the data attached, and
    ``fill`` where there is none. Put the largest dimension first."""
    grid = dimensions[0].distinct()
    for dimension in dimensions[1:]:
        grid = pair_with_values(grid, dimension)
    return natural_left(grid, data).fillna(fill)


def grid_summary(data: DataFrame, dimensions: dict[str, DataFrame], by: str, value: str, fill: float = 0.0) -> DataFrame:
    """What ``densify`` and an aggregate by one dimension give, without the grid.

    A grid is its filled cells, the sizes of its dimensions and a default value:
    cells nobody filled are counted by arithmetic. ``data`` has one row per cell
    (the dimensions and ``value``); rows beyond the dimensions take no part.
    Returns ``by, cells, filled, total, mean, least, most`` for every value of
    the dimension ``by``. A missing key is a value of its dimension.
    """
    names = list(dimensions)
    values = {name: dimensions[name].select(F.col(dimensions[name].columns[0]).alias(name)).distinct() for name in names}
    others = math.prod(values[name].count() for name in names if name != by)
    seen = data.select(*names, F.col(value).cast("double").alias("__v"))
    for name in names:
        seen = join_null_safe(seen, sized(values[name]), [name], "left_semi")
    sums = seen.groupBy(by).agg(F.count("*").alias("filled"), F.sum("__v").alias("__sum"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    whole = natural_left(values[by], sums).fillna({"filled": 0, "__sum": 0.0})
    empty = F.lit(others) - F.col("filled")
    default = F.when(empty > 0, F.lit(float(fill)))
    total = F.col("__sum") + empty * F.lit(float(fill))
    return whole.select(
        by, F.lit(others).cast("long").alias("cells"), "filled", total.alias("total"), F.try_divide(total, F.lit(float(others))).alias("mean"),
        F.least("__min", default).alias("least"), F.greatest("__max", default).alias("most"),
    )


def is_best(df: DataFrame, value: str, best: Column) -> Column:
    """Whether the value is the maximum ``best``.

    A sum of floating numbers may differ in its last digits from one evaluation
    to the next, so those count as equal within one part in 10^12.
    """
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        return F.col(value) >= best - F.abs(best) * F.lit(1e-12)
    return F.col(value) == best


def argmax_join(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows that hold the maximum of ``value`` in their group; ties are kept.

    The maximum is an aggregate with a map-side combine joined back, so a large
    group is never sorted in one task.
    """
    best = df.groupBy(*keys).agg(F.max(value).alias("__best"))
    joined = join_null_safe(df, sized(best), keys)
    return joined.filter(is_best(df, value, F.col("__best"))).drop("__best")


def zip_by_rank(
    left: DataFrame, left_order: Sequence, right: DataFrame, right_order: Sequence, rank: str
) -> DataFrame:
    """The i-th row of one order beside the i-th row of another."""
    from locigrid.operators.scans import ordered_index

    a = ordered_index(left, left_order, rank)
    b = ordered_index(right, right_order, rank)
    return a.join(b, rank).withColumn(rank, F.col(rank) + 1)


def lookup(column: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, NULL for an unknown key."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), column)


def unmatched_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, with the side that holds them."""
    a = left.select(*keys).distinct().withColumn("__a", F.lit(True))
    b = right.select(*keys).distinct().withColumn("__b", F.lit(True))
    both = join_null_safe(a, b, keys, "full")
    side = F.when(F.col("__b").isNull(), "left").otherwise("right")
    return both.filter(F.col("__a").isNull() | F.col("__b").isNull()).select(
        *keys, side.alias("side")
    )


def assert_same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left``, failing at run time when the two sides hold different keys."""
    check = unmatched_keys(left, right, keys).agg(F.count("*").alias("__n"))
    ok = F.assert_true(F.col("__n") == 0, F.lit("key sets differ"))
    # One row; the check rides along as a scalar subquery.
    checked = check.select(F.coalesce(ok.cast("int"), F.lit(0)).alias("x"))
    return left.withColumn("__ok", checked.scalar()).filter("__ok = 0").drop("__ok")


def motif_pileup(occurrences: DataFrame, pileup: DataFrame) -> DataFrame:
    """Pileup rows that lie on the modified base of a motif occurrence.

    Occurrences carry (contig, start, strand, motif, mod_type, mod_position and
    the motif length); on the reverse strand the base is counted from the end.
    """
    forward = F.col("start") + F.col("mod_position")
    backward = F.col("start") + F.length("motif") - 1 - F.col("mod_position")
    placed = occurrences.withColumn(
        "pos", F.when(F.col("strand") == "+", forward).otherwise(backward).cast(T.LongType())
    ).drop("start")
    return placed.join(pileup, ["contig", "pos", "strand", "mod_type"])
