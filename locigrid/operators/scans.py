"""Prefix operators over ordered data: ranks, running totals, fill-down, lag.

A window partitioned by a group sends the whole group through one task, which
fails when one group holds a large part of the rows. Here the order is cut into
buckets. Windows run inside (group, bucket), and a second, much smaller window
runs over one summary row per bucket to carry the state across buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from locigrid.operators.joins import join_null_safe
from locigrid.session import BROADCAST_ROWS, cut_lineage, sized

BUCKET = "__bucket"
GROUP = "__group"
KEYS = [GROUP, BUCKET]


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def place_in_order(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range-partition and sort by ``order``; adds the partition as ``__bucket``
    and the place inside it as ``__place`` (0-based).

    The sorted rows are written once, because two evaluations of a range
    partitioning may choose different boundaries.
    """
    cols = _cols(order)
    mid = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__mid", mid)
    placed = cut_lineage(placed)
    return (
        placed.withColumn(BUCKET, F.shiftright("__mid", 33).cast("long"))
        .withColumn("__place", F.col("__mid").bitwiseAND((1 << 33) - 1))
        .drop("__mid")
    )


def ordered_index(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """0-based position of each row in the total order, without a
    single-partition window over the rows."""
    placed = place_in_order(df, order)
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, so the window and the broadcast stay small.
    starts = (
        placed.groupBy(BUCKET)
        .agg(F.count("*").alias("__n"))
        .select(BUCKET, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    return (
        placed.join(F.broadcast(starts), BUCKET)
        .withColumn(name, F.col("__start") + F.col("__place"))
        .drop(BUCKET, "__place", "__start")
    )


def rank_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str
) -> DataFrame:
    """1-based position inside the group; ``order`` must be unique in it."""
    indexed = ordered_index(df, [*group, *order], "__index")
    if not group:
        return indexed.withColumn(name, F.col("__index") + 1).drop("__index")
    firsts = indexed.groupBy(*group).agg(F.min("__index").alias("__first"))
    return (
        join_null_safe(indexed, sized(firsts), group)
        .withColumn(name, F.col("__index") - F.col("__first") + 1)
        .drop("__index", "__first")
    )


def _bucketed(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], bucket: Column | None
) -> DataFrame:
    """``df`` with its group as one struct key and the bucket of each row.

    The struct is never NULL itself, so missing group values match, and windows,
    summaries and joins all share one partitioning.
    """
    if bucket is None:
        df = place_in_order(df, [*group, *order]).drop("__place")
    else:
        df = df.withColumn(BUCKET, bucket)
    return df.withColumn(GROUP, F.struct(*group) if group else F.lit(0))


class OrderedScan:
    """Windows over (group, order) in two levels.

    ``bucket`` is an expression that never decreases along ``order`` and keeps
    the rows of one (group, bucket) few, such as a tile of a coordinate or the
    leading digits of a hash. Without it the rows are range-partitioned.

    Steps are collected and run together by ``result``: one shuffle of the rows,
    one summary row per bucket, one join. Their values may use the columns of
    ``df`` only, and ``order`` must be ascending.
    """

    def __init__(
        self,
        df: DataFrame,
        group: Sequence[str],
        order: Sequence[str | Column],
        bucket: Column | None = None,
    ) -> None:
        self.order = _cols(order)
        self.df = _bucketed(df, list(group), self.order, bucket)
        self.inner_cols: dict[str, Column] = {}
        self.summaries: dict[str, Column] = {}
        self.carried: dict[str, Callable[[WindowSpec], Column]] = {}
        self.outputs: dict[str, Column] = {}

    def _window(self) -> WindowSpec:
        return Window.partitionBy(*KEYS).orderBy(*self.order)

    def _add(
        self,
        name: str,
        inner: Column,
        summary: Column,
        carry: Callable[[Column, WindowSpec], Column],
        combine: Callable[[Column, Column], Column],
    ) -> OrderedScan:
        n = len(self.outputs)
        self.inner_cols[f"__in{n}"] = inner
        self.summaries[f"__sum{n}"] = summary
        self.carried[f"__carry{n}"] = lambda w: carry(F.col(f"__sum{n}"), w)
        self.outputs[name] = combine(F.col(f"__in{n}"), F.col(f"__carry{n}"))
        return self

    def running_sum(self, value: Column, name: str) -> OrderedScan:
        """Prefix sum of ``value`` in order, the row itself included."""
        rows = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self._add(
            name,
            F.sum(value).over(rows),
            F.sum(value),
            lambda total, w: F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            lambda inner, base: F.coalesce(inner, F.lit(0)) + F.coalesce(base, F.lit(0)),
        )

    def lag(self, value: Column, name: str) -> OrderedScan:
        """Value of the row before, NULL on the first row of the group."""
        # Structs keep "no row before" apart from "NULL in the row before".
        boxed = F.struct(value.alias("v"))
        return self._add(
            name,
            F.lag(boxed).over(self._window()),
            F.max_by(boxed, F.struct(*self.order)),
            lambda last, w: F.lag(last).over(w),
            lambda inner, before: F.coalesce(inner, before)["v"],
        )

    def lead(self, value: Column, name: str) -> OrderedScan:
        """Value of the row after, NULL on the last row of the group."""
        boxed = F.struct(value.alias("v"))
        return self._add(
            name,
            F.lead(boxed).over(self._window()),
            F.min_by(boxed, F.struct(*self.order)),
            lambda first, w: F.lead(first).over(w),
            lambda inner, after: F.coalesce(inner, after)["v"],
        )

    def fill_down(self, value: Column, name: str) -> OrderedScan:
        """Last non-NULL value up to and including the row."""
        rows = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self._add(
            name,
            F.last(value, ignorenulls=True).over(rows),
            F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order))),
            lambda last, w: F.last(last, ignorenulls=True).over(
                w.rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.coalesce,
        )

    def result(self) -> DataFrame:
        per_bucket = self.df.groupBy(*KEYS).agg(*[c.alias(n) for n, c in self.summaries.items()])
        outer = Window.partitionBy(GROUP).orderBy(BUCKET)
        state = per_bucket.select(*KEYS, *[make(outer).alias(n) for n, make in self.carried.items()])
        joined = self.df.withColumns(self.inner_cols).join(state, KEYS)
        return joined.withColumns(self.outputs).drop(*KEYS, *self.inner_cols, *self.carried)


def seeded_hash(*parts: Column | str | int) -> Column:
    """32 hex digits that depend only on the values, not on the data layout.

    Strings and numbers are literals; pass columns as ``Column``.
    """
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))


def hash_bucket(hash_col: Column) -> Column:
    """Leading three hex digits of the hash: 4096 buckets in hash order."""
    return F.substring(hash_col, 1, 3)


def hash_digits(hash_col: Column, step: int = 3) -> Callable[[int], Column]:
    """Buckets of a hash, finer with every level; as many digits more as ``step`` says."""
    return lambda level: F.substring(hash_col, 1, step * level)


def hash_fraction(hash_col: Column) -> Column:
    """The hash as a number in [0, 1)."""
    return F.conv(F.substring(hash_col, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


# Rows of the bucket in which a budget ends that are put in order by one task, and how often a bucket is made finer.
CUT_ROWS = 200_000
LEVELS = 10


def _cuts(rows: DataFrame) -> DataFrame:
    """Per group the bucket in which the budget ends, null if none, what was spent before it, and its rows."""
    totals = rows.groupBy(*KEYS).agg(
        F.sum("__value").alias("__total"), F.max("__budget").alias("__limit"), F.max("__base").alias("__spent"), F.count("*").alias("__rows")
    )
    upto = F.sum("__total").over(
        Window.partitionBy(GROUP).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = totals.withColumn("__upto", F.col("__spent") + upto)
    full = F.when(F.col("__upto") >= F.col("__limit"), F.struct(BUCKET, (F.col("__upto") - F.col("__total")).cast("double").alias("before"), "__rows"))
    cuts = totals.groupBy(GROUP).agg(F.min(full).alias("__c"))
    return cuts.select(GROUP, F.col("__c")[BUCKET].alias("__cut"), F.col("__c.before").alias("__before"), F.col("__c.__rows").alias("__rows"))


def take_until(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    value: Column,
    budget: Column,
    bucket: Column | Callable[[int], Column],
) -> DataFrame:
    """Smallest prefix of each group, in order, whose sum of ``value`` reaches
    ``budget`` (a column that is constant in the group); all rows if it never does.

    Bucket totals name, per group, the bucket in which the budget runs out. Rows
    before it are kept as they are. If more rows than a task may sort are in it,
    only that bucket is cut again by the next level of ``bucket``, and so on; what
    is left is put in order. ``bucket`` is a column, or a function of the level.
    """
    at = bucket if callable(bucket) else lambda level: bucket
    most = LEVELS if callable(bucket) else 1
    inside = df.withColumns(
        {
            GROUP: F.struct(*group) if group else F.struct(F.lit(0)),
            "__value": value,
            "__budget": budget,
            "__base": F.lit(0.0),
        }
    )
    kept, level = [], 1
    while True:
        placed = inside.withColumn(BUCKET, at(level))
        cuts = cut_lineage(_cuts(placed))
        found = cuts.agg(F.count("*").alias("groups"), F.max("__rows").alias("rows")).first()
        marked = placed.join(F.broadcast(cuts) if found["groups"] <= BROADCAST_ROWS else cuts, GROUP)
        kept.append(marked.filter(F.col("__cut").isNull() | (F.col(BUCKET) < F.col("__cut"))).select(*df.columns))
        last = marked.filter(F.col(BUCKET) == F.col("__cut")).withColumn("__base", F.col("__before"))
        last = last.select(*df.columns, GROUP, "__value", "__budget", "__base", "__rows")
        if level == most or (found["rows"] or 0) <= CUT_ROWS:
            kept.append(_sorted_cut(last, order).select(*df.columns))
            break
        last = cut_lineage(last)
        kept.append(_sorted_cut(last.filter(F.col("__rows") <= CUT_ROWS), order).select(*df.columns))
        inside = last.filter(F.col("__rows") > CUT_ROWS).drop("__rows")
        level += 1
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def _sorted_cut(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows of one bucket per group up to the one that reaches the budget."""
    before = F.sum("__value").over(
        Window.partitionBy(GROUP).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumn("__spent", before)
    return placed.filter(F.col("__base") + F.coalesce("__spent", F.lit(0)) < F.col("__budget"))


def fill_down(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], column: str, name: str
) -> DataFrame:
    """Carry the last non-NULL value of ``column`` forward."""
    return OrderedScan(df, group, order).fill_down(F.col(column), name).result()


def consecutive_runs(
    df: DataFrame,
    group: Sequence[str],
    start: str,
    end: str,
    run: str = "run",
    place: str = "place",
    bucket: Column | None = None,
) -> DataFrame:
    """Number the runs of rows in which each row starts right after the end of
    the row before it, and the place of each row in its run (both 1-based).

    Inside a bucket the first row is left open. The bucket summaries decide
    whether it continues a run and how many runs and rows came before.
    """
    rows = _bucketed(df, group, _cols([start, end]), bucket)
    window = Window.partitionBy(*KEYS).orderBy(start, end)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    breaks = F.coalesce((F.lag(end).over(window) + 1 != F.col(start)).cast("long"), F.lit(0))
    rows = rows.withColumns({"__n": F.row_number().over(window).cast("long"), "__break": breaks})
    rows = rows.withColumns(
        {
            "__runs": F.sum("__break").over(upto),
            "__at": F.max(F.when(F.col("__break") == 1, F.col("__n"))).over(upto),
        }
    )
    per_bucket = rows.groupBy(*KEYS).agg(
        F.min(F.struct(start, end))[start].alias("__first"),
        F.max(F.struct(start, end))[end].alias("__last"),
        F.count("*").alias("__size"),
        F.sum("__break").alias("__inner"),
        F.max("__at").alias("__last_at"),
    )
    outer = Window.partitionBy(GROUP).orderBy(BUCKET)
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce((F.lag("__last").over(outer) + 1 != F.col("__first")).cast("long"), F.lit(1))
    state = per_bucket.withColumn("__opens", opens).withColumns(
        {
            "__rows_before": F.coalesce(F.sum("__size").over(before), F.lit(0)),
            "__runs_before": F.coalesce(F.sum(F.col("__opens") + F.col("__inner")).over(before), F.lit(0)),
        }
    )
    # Row number, in the group, of the latest run start up to the bucket's first row.
    own = F.when(F.col("__opens") == 1, F.col("__rows_before") + 1)
    latest = F.coalesce(F.col("__rows_before") + F.col("__last_at"), own)
    state = state.withColumn("__from", F.coalesce(own, F.last(latest, ignorenulls=True).over(before)))
    state = state.select(*KEYS, "__opens", "__rows_before", "__runs_before", "__from")
    joined = rows.join(state, KEYS)
    started = F.coalesce(F.col("__rows_before") + F.col("__at"), F.col("__from"))
    return joined.withColumns(
        {
            run: F.col("__runs_before") + F.col("__opens") + F.col("__runs"),
            place: F.col("__rows_before") + F.col("__n") - started + 1,
        }
    ).select(*df.columns, run, place)


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group. An aggregate with a map-side combine, so
    one row per group and map task is shuffled."""
    rest = [c for c in df.columns if c not in group]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*group).agg(first).select(*group, "__row.*").select(*df.columns)


def nth_row(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The ``n``-th row of each group. Spark prunes to ``n`` rows per group and
    map task before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn("__n", F.row_number().over(window))
    return ranked.filter(F.col("__n") <= n).filter(F.col("__n") == n).drop("__n")


def top_k(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], k: int
) -> DataFrame:
    """The first ``k`` rows of each group in order (rows pruned before the shuffle)."""
    window = Window.partitionBy(*group).orderBy(*_cols(order))
    return df.withColumn("__n", F.row_number().over(window)).filter(F.col("__n") <= k).drop("__n")
