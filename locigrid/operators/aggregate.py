"""Group aggregates, shares, distribution summaries and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locigrid.functions.numeric import gc_fraction
from locigrid.operators.joins import argmax_join, join_null_safe
from locigrid.session import sized

# Rows of a group whose values may be held in memory by one task.
GROUP_ROWS = 1 << 20
# Accuracy of the quantile sketch: its rank error is one in this many.
SKETCH = 10_000


def with_group_stats(df: DataFrame, group: Sequence[str], **stats: Column) -> DataFrame:
    """Attach aggregates of the group to each row.

    The aggregate is combined on the map side and joined back; a window would
    sort each whole group in one task.
    """
    summary = df.groupBy(*group).agg(*[col.alias(name) for name, col in stats.items()])
    return join_null_safe(df, sized(summary), group)


def share_of_group(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Value of the row over the total of its group."""
    totals = with_group_stats(df, group, __total=F.sum(value))
    return totals.withColumn(name, F.try_divide(F.col(value), F.col("__total"))).drop("__total")


def groups_with_n(df: DataFrame, group: Sequence[str], n: int) -> DataFrame:
    """Rows of the groups that hold exactly ``n`` rows."""
    kept = df.groupBy(*group).agg(F.count("*").alias("__n")).filter(F.col("__n") == n)
    return join_null_safe(df, sized(kept.drop("__n")), group, "left_semi")


def groups_with_n_distinct(df: DataFrame, group: Sequence[str], column: str, n: int) -> DataFrame:
    """Rows of the groups with exactly ``n`` distinct values."""
    kept = df.groupBy(*group).agg(F.count_distinct(column).alias("__n")).filter(F.col("__n") == n)
    return join_null_safe(df, sized(kept.drop("__n")), group, "left_semi")


def keep_max(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Rows that hold the maximum of their group, ties kept."""
    return argmax_join(df, group, value)


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbours.

    ``percentile`` holds the distinct values of a group in memory, which serves
    groups up to ``GROUP_ROWS`` rows. Larger groups are counted first; their
    quantiles come from ``_large_quantiles``.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*group, value)
    sizes = rows.groupBy(*group).agg(F.count("*").alias("__size"))
    large = sizes.filter(F.col("__size") > GROUP_ROWS)
    small = rows
    if any_large := not large.isEmpty():
        small = join_null_safe(rows, large.drop("__size"), group, "left_anti")
    wanted = [F.percentile(value, F.lit(float(p))).alias(name) for name, p in probs.items()]
    grouped = small.groupBy(*group) if group else small.groupBy(F.lit(0).alias("__all"))
    out = grouped.agg(*wanted).select(*group, *probs)
    if any_large:
        out = out.unionByName(_large_quantiles(rows, large, group, value, probs))
    return out


def _large_quantiles(
    rows: DataFrame, large: DataFrame, group: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles of a few large groups.

    A sketch brackets each quantile between two values whose ranks are known to
    lie on either side. One pass counts the rows under each bracket, and only
    the values inside it are ranked; a bracket holds a few rows in ten thousand.
    """
    margin = 4.0 / SKETCH
    edges = [min(max(p + side * margin, 0.0), 1.0) for p in probs.values() for side in (-1, 1)]
    mine = join_null_safe(rows, sized(large), group)
    sketch = F.percentile_approx(value, F.array(*[F.lit(e) for e in edges]), F.lit(SKETCH))
    # One row per large group.
    brackets = mine.groupBy(*group, "__size").agg(sketch.alias("__b"))
    placed = join_null_safe(rows, sized(brackets), group)
    spots = [
        F.struct(
            F.lit(i).alias("spot"),
            F.get("__b", F.lit(2 * i)).alias("low"),
            F.get("__b", F.lit(2 * i + 1)).alias("high"),
        )
        for i in range(len(probs))
    ]
    asked = placed.select(*group, "__size", value, F.inline(F.array(*spots)))
    asked = asked.filter(F.col(value) <= F.col("high"))
    inside = F.when(F.col(value) >= F.col("low"), F.col(value))
    # Rows under a bracket share one NULL entry, which sorts first.
    counts = asked.groupBy(*group, "__size", "spot", inside.alias("__v")).agg(F.count("*").alias("__n"))
    window = Window.partitionBy(*group, "spot").orderBy(F.asc_nulls_first("__v"))
    upto = F.sum("__n").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("__upto", upto)
    share = F.element_at(F.lit([float(p) for p in probs.values()]), F.col("spot") + 1)
    at = (F.col("__size") - 1) * share
    first, last = F.col("__upto") - F.col("__n"), F.col("__upto") - 1
    low, high = (
        F.max(F.when((first <= spot) & (spot <= last), F.col("__v"))) for spot in (F.floor(at), F.ceil(at))
    )
    found = ranked.groupBy(*group, "__size", "spot").agg(low.alias("lo"), high.alias("hi"))
    known = F.assert_true(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.lit("quantile out of bracket"))
    found = found.filter(known.isNull())
    quantile = F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.floor(at))
    picks = [F.max(F.when(F.col("spot") == i, quantile)).alias(name) for i, name in enumerate(probs)]
    return found.groupBy(*group, "__size").agg(*picks).select(*group, *probs)


def boxplot_stats(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Quartiles, median and the outermost values within 1.5 IQR of the box."""
    box = exact_quantiles(df, group, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    marked = join_null_safe(df, sized(box), group)
    low = F.when(F.col(value) >= F.col("q1") - reach, F.col(value))
    high = F.when(F.col(value) <= F.col("q3") + reach, F.col(value))
    return marked.groupBy(*group, "q1", "median", "q3").agg(
        F.min(low).alias("whisker_low"), F.max(high).alias("whisker_high")
    )


def histogram(df: DataFrame, value: str, width: float = 10.0) -> DataFrame:
    """Counts in right-closed bins centred on multiples of ``width``."""
    centre = F.ceil((F.col(value) - width / 2) / width) * width
    return df.groupBy(centre.alias("centre")).agg(F.count("*").alias("n"))


def accuracy_by(df: DataFrame, group: Sequence[str], correct: Column) -> DataFrame:
    """Correct rows, rows with a known outcome, and their ratio."""
    hits = F.sum(correct.cast("long")).alias("n_correct")
    summary = df.groupBy(*group).agg(hits, F.count(correct).alias("n_total"))
    return summary.withColumn(
        "accuracy", F.try_divide(F.col("n_correct").cast("double"), F.col("n_total"))
    )


def sequence_stats(seqs: DataFrame) -> DataFrame:
    return seqs.select(
        "contig", F.length("seq").cast("long").alias("length"), gc_fraction(F.col("seq")).alias("gc")
    )


def reads_summary(reads: DataFrame, group: Sequence[str], quality: Column) -> DataFrame:
    """Reads, bases, mean and median length, mean quality per group."""
    sized = reads.select(*group, F.length("seq").cast("long").alias("length"), quality.alias("q"))
    summary = sized.groupBy(*group).agg(
        F.count("*").alias("reads"),
        F.sum("length").alias("bases"),
        F.avg("length").alias("mean_length"),
        F.avg("q").alias("mean_quality"),
    )
    return join_null_safe(
        summary, exact_quantiles(sized, group, "length", {"median_length": 0.5}), group
    )


def mod_pileup(calls: DataFrame) -> DataFrame:
    """Valid coverage, modified count and fraction per position, strand and code.

    Calls with an unknown state (NULL ``is_mod``) do not count as coverage.
    """
    return (
        calls.filter(F.col("is_mod").isNotNull())
        .groupBy("contig", "pos", "strand", "mod_type")
        .agg(F.count("*").alias("coverage"), F.sum(F.col("is_mod").cast("long")).alias("n_mod"))
        .withColumn("fraction", F.col("n_mod").cast("double") / F.col("coverage"))
    )


def score_motifs(joined: DataFrame, min_cov: int = 3) -> DataFrame:
    """Median modified fraction, mean coverage and positions per contig and motif,
    over positions with at least ``min_cov`` valid reads."""
    keys = ["contig", "motif", "mod_type", "mod_position"]
    kept = joined.filter(F.col("coverage") >= min_cov)
    means = kept.groupBy(*keys).agg(
        F.avg("coverage").alias("mean_read_cov"), F.count("*").alias("n_motif_obs")
    )
    return join_null_safe(means, exact_quantiles(kept, keys, "fraction", {"median": 0.5}), keys)


def bin_sizes(contig_bin: DataFrame, lengths: DataFrame, drop: str | None = None) -> DataFrame:
    """Total length and number of contigs per bin."""
    rows = contig_bin if drop is None else contig_bin.filter(F.col("bin") != drop)
    return (
        rows.join(lengths, "contig")
        .groupBy("bin")
        .agg(F.sum("length").alias("bin_length"), F.count("contig").alias("n_contigs_bin"))
    )


def cluster_sizes(
    results: DataFrame, lengths: DataFrame, sizes: DataFrame, extra: Sequence[str] = ()
) -> DataFrame:
    """Contigs and bases of each bin in each cluster, and their shares of the bin."""
    counts = (
        results.join(lengths, "contig")
        .groupBy(*extra, "bin", "method", "cluster")
        .agg(F.count("contig").alias("n_contigs"), F.sum("length").alias("cluster_length"))
    )
    return counts.join(sizes, [*extra, "bin"]).withColumns(
        {
            "fraction_contigs": F.try_divide(
                F.col("n_contigs").cast("double"), F.col("n_contigs_bin")
            ),
            "fraction_length": F.try_divide(
                F.col("cluster_length").cast("double"), F.col("bin_length")
            ),
        }
    )


def label_counts(df: DataFrame, group: Sequence[str], parts: dict[str, Column]) -> DataFrame:
    """One label per group, a ``title: number`` line for each aggregate."""
    lines = [F.concat(F.lit(f"{title}: "), col.cast("string")) for title, col in parts.items()]
    return df.groupBy(*group).agg(F.concat_ws("\n", *lines).alias("label"))


def uniqueness(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, and whether they agree."""
    per_key = df.groupBy(*key).agg(F.count("*").alias("__n"))
    return per_key.agg(
        F.sum("__n").alias("n_rows"),
        F.count("*").alias("n_keys"),
        F.coalesce(F.max("__n") <= 1, F.lit(True)).alias("is_unique"),
    )


def assert_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``df``, failing at run time when a key occurs twice."""
    check = uniqueness(df, key).select(
        F.coalesce(F.assert_true(F.col("is_unique"), F.lit("key is not unique")).cast("int"), F.lit(0))
    )
    return df.withColumn("__ok", check.scalar()).filter("__ok = 0").drop("__ok")
