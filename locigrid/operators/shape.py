"""Projections, filters, unions and reshaping."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locigrid.operators.joins import anti, join_null_safe, semi
from locigrid.operators.scans import OrderedScan


def rename_positions(df: DataFrame, names: dict[int, str]) -> DataFrame:
    """Rename by 1-based position, whatever the source names are."""
    return df.toDF(*[names.get(i, c) for i, c in enumerate(df.columns, start=1)])


def select_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """All columns between two names, both included."""
    lo, hi = df.columns.index(first), df.columns.index(last)
    return df.select(*df.columns[lo : hi + 1])


def clean_names(df: DataFrame) -> DataFrame:
    """Column names in snake case."""

    def snake(name: str) -> str:
        parted = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
        return re.sub(r"[^A-Za-z0-9]+", "_", parted).strip("_").lower()

    return df.toDF(*[snake(c) for c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL are one missing value in all operators; scans call this."""
    floats = (T.DoubleType, T.FloatType)
    fixed = {
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, floats)
    }
    return df.withColumns(fixed) if fixed else df


def present(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is neither NULL nor NaN."""
    keep = F.col(column).isNotNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        keep = keep & ~F.isnan(column)
    return df.filter(keep)


def fill_missing(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.fillna(values)


def min_evidence(
    df: DataFrame,
    at_least: float,
    min_cov: float,
    strict: bool = True,
    observations: str = "n_motif_obs",
    coverage: str = "mean_read_cov",
) -> DataFrame:
    """Rows with enough observations times coverage and a coverage floor."""
    floor = F.col(coverage) > min_cov if strict else F.col(coverage) >= min_cov
    weight = F.col(observations).cast("double") * F.col(coverage)
    return df.filter(floor & (weight >= at_least))


def where_in(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def with_order(df: DataFrame, column: str, levels: Sequence[str], name: str) -> DataFrame:
    """Place of the value among ordered levels; unlisted values become NULL."""
    place = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(column))
    return df.withColumn(name, F.when(place > 0, place.cast("int")))


def sort_by_levels(
    df: DataFrame, column: str, levels: Sequence[str], reverse: bool = False
) -> DataFrame:
    placed = with_order(df, column, levels, "__level")
    order = F.desc_nulls_last("__level") if reverse else F.asc_nulls_last("__level")
    return placed.orderBy(order, column).drop("__level")


def flag_members(df: DataFrame, ids: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """TRUE where the key occurs in the other table."""
    marks = ids.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(marks, list(keys), "left").fillna({name: False})


def filter_alignments(df: DataFrame, min_mapq: int = 30, exclude_flags: int = 2308) -> DataFrame:
    """Drop rows with any excluded flag bit or a low mapping quality."""
    return df.filter(
        (F.col("flag").bitwiseAND(exclude_flags) == 0) & (F.col("mapq") >= min_mapq)
    )


def keep_labels(df: DataFrame, columns: Sequence[str], patterns: Sequence[str]) -> DataFrame:
    """Rows in which any of the columns matches any of the patterns."""
    pattern = "|".join(patterns)
    keep = F.lit(False)
    for column in columns:
        keep = keep | F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    return df.filter(keep)


def repair_scale(df: DataFrame, scale: str = "scale", digitisation: str = "digitisation") -> DataFrame:
    """Scales of 1 or more were stored before division by the digitisation."""
    fixed = F.when(F.col(scale) < 1, F.col(scale)).otherwise(
        F.try_divide(F.col(scale), F.col(digitisation))
    )
    return df.withColumn(scale, fixed)


def files_needing_repair(
    df: DataFrame, file: str, read_number: str, scale: str = "scale", deep: bool = False
) -> DataFrame:
    """Files to repair: all of them if ``deep``, else those whose first read
    still has a raw scale. A file without reads never appears."""
    first = df.groupBy(file).agg(F.min_by(scale, read_number).alias("first_scale"))
    return first if deep else first.filter(~(F.col("first_scale") < 1))


def filter_reads(df: DataFrame, quality: Column, min_len: int = 200, min_q: float = 10) -> DataFrame:
    """Reads at or over both limits."""
    return df.filter((F.length("seq") >= min_len) & (quality >= min_q))


def size_window(
    df: DataFrame, length: str, cov: str, min_length: float, min_cov: float
) -> DataFrame:
    """Rows over a length and a coverage limit (both strict)."""
    return df.filter((F.col(length) > min_length) & (F.col(cov) > min_cov))


def union_loose(*frames: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side becomes NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def union_strict(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def union_variants(frames: Sequence[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Union of tables that name the same columns differently."""
    return union_strict(*[df.withColumnsRenamed(names) for df, names in frames])


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of the left side that the right side lacks."""
    return left.select(*keys).subtract(right.select(*keys))


def mix_by_key(
    a: DataFrame, b: DataFrame, keys_from_b: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Rows of ``b`` for the chosen keys and of ``a`` for all others."""
    return anti(a, keys_from_b, keys).unionByName(semi(b, keys_from_b, keys))


def with_shadow_copy(df: DataFrame, column: str, prefix: str = "contamination_") -> DataFrame:
    """Each row twice: as it is, and under a prefixed id. One scan."""
    both = F.explode(F.array(F.col(column), F.concat(F.lit(prefix), F.col(column))))
    return df.select(*[both.alias(c) if c == column else F.col(c) for c in df.columns])


def unique_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def pivot_wide(
    df: DataFrame,
    index: Sequence[str],
    names: str,
    values: str,
    name_list: Sequence[str],
    fill: object | None = None,
) -> DataFrame:
    """Long to wide for a given list of names. The list is explicit, so the data
    is read once; beyond a few thousand names use ``feature_vectors``."""
    wide = df.groupBy(*index).pivot(names, list(name_list)).agg(F.first(values))
    return wide if fill is None else wide.fillna(fill, subset=list(name_list))


def unpivot(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str, value: str
) -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


def nest(df: DataFrame, by: Sequence[str], order: Sequence[str], rows_per_cell: int = 10_000) -> DataFrame:
    """One nested table per key and part.

    A key with many rows gets several parts of about ``rows_per_cell`` rows, so
    no cell grows with the data. Rows are spread over the parts by a hash of the
    ``order`` columns and sorted by them inside a part.
    """
    rest = [c for c in df.columns if c not in by]
    counts = df.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(rows_per_cell)).alias("__parts"))
    part = F.pmod(F.xxhash64(*order), F.col("__parts")).cast("int")
    tagged = join_null_safe(df, counts, by).withColumn("part", part)
    row = F.struct(*order, *[c for c in rest if c not in order])
    return tagged.groupBy(*by, "part").agg(F.sort_array(F.collect_list(row)).alias("rows"))


def unnest(df: DataFrame, column: str) -> DataFrame:
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.inline(column))


def nested_size(df: DataFrame, column: str, name: str) -> DataFrame:
    """Size of the nested table; rows with an empty one are dropped."""
    return df.withColumn(name, F.size(column).cast("long")).filter(F.col(name) > 0)


def coordinate_sort(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in total order across partitions, without a gather."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def ordered_text(df: DataFrame, group: Sequence[str], order: Sequence[str], text: str, part_chars: int = 1 << 20) -> DataFrame:
    """group, ``part`` and ``joined``: the texts of a group joined in order, in numbered parts.

    A text belongs to the part in which it starts; a part holds about
    ``part_chars`` characters, so a group of any size passes in bounded memory,
    and the parts of a group in a row are its text. Groups that fit have the one
    part 0. ``order`` must be unique in the group; missing texts join as nothing.
    """
    rows = df.select(*group, *order, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    placed = OrderedScan(rows, group, order).running_sum(F.length("__text").cast("long"), "__end").result()
    start = F.col("__end") - F.length("__text")
    placed = placed.withColumn("part", F.floor(start / F.lit(part_chars)).cast("long"))
    in_order = F.sort_array(F.collect_list(F.struct(*order, "__text")))
    joined = F.array_join(F.transform(in_order, lambda x: x["__text"]), "")
    return placed.groupBy(*group, "part").agg(joined.alias("joined"))
