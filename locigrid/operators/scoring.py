"""Benchmark scoring: confusion cells, metrics, consensus and confidence tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locigrid.functions.text import remove_first
from locigrid.operators.joins import argmax_join, natural_left
from locigrid.operators.scans import top_k
from locigrid.operators.shape import union_loose

# Confusion cells, and the metrics in report order.
CELLS = ["true_positive", "false_negative", "false_positive", "true_negative"]
METRICS = ["sensitivity", "specificity", "precision", "accuracy", "F1"]


def measure(actual: Column, predicted: Column) -> Column:
    """Name of the confusion cell; both inputs are booleans."""
    return (
        F.when(~predicted & ~actual, "true negative")
        .when(~predicted & actual, "false negative")
        .when(predicted & ~actual, "false positive")
        .when(predicted & actual, "true positive")
    )


def confusion(df: DataFrame, group: Sequence[str], actual: Column, predicted: Column) -> DataFrame:
    """The four cell counts per group in one pass; unseen cells are 0."""
    return df.groupBy(*group).agg(
        F.count_if(actual & predicted).alias("true_positive"),
        F.count_if(actual & ~predicted).alias("false_negative"),
        F.count_if(~actual & predicted).alias("false_positive"),
        F.count_if(~actual & ~predicted).alias("true_negative"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def binary_metrics(cells: DataFrame) -> DataFrame:
    """Metrics of the cell counts; an undefined one is NULL and drops out of means."""
    tp, fn, fp, tn = (F.col(c) for c in CELLS)
    base = cells.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
            "sensitivity": _ratio(tp, tp + fn),
            "specificity": _ratio(tn, tn + fp),
            "precision": _ratio(tp, tp + fp),
        }
    )
    p, r = F.col("precision"), F.col("sensitivity")
    return base.withColumns(
        {
            "F1": F.try_divide(2 * p * r, p + r),
            "F0_5": F.try_divide((1 + 0.25) * p * r, 0.25 * p + r),
        }
    )


def metrics_long(metrics: DataFrame, ids: Sequence[str], names: Sequence[str] = METRICS) -> DataFrame:
    return metrics.unpivot(list(ids), list(names), "metric", "value")


def mean_metrics(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """Mean over replicates with its rounded text (halves to even)."""
    means = long.groupBy(*group, "metric").agg(F.avg("value").alias("value"))
    return means.withColumn("label", F.bround("value", 2).cast("string"))


def assignment_outcome(truth: Column, assigned: Column) -> Column:
    return (
        F.when(truth == assigned, "correct")
        .when(truth != assigned, "incorrect")
        .when(assigned.isNull(), "unassigned")
        .otherwise("unknown")
    )


def assignment_metrics(df: DataFrame, group: Sequence[str], outcome: str = "measure") -> DataFrame:
    """Precision, misclassification and recall of assignments per group.

    ``recall`` counts unassigned rows once; ``recall_compat`` counts them twice,
    as one published table does.
    """
    counts = df.groupBy(*group).agg(
        *[F.count_if(F.col(outcome) == name).alias(name) for name in ("correct", "incorrect", "unassigned")]
    )
    right, wrong, none = F.col("correct"), F.col("incorrect"), F.col("unassigned")
    return counts.withColumns(
        {
            "misclassification_rate": _ratio(wrong, right + wrong),
            "precision": _ratio(right, right + wrong),
            "recall": _ratio(right, right + none),
            "recall_compat": _ratio(right, right + none + none),
        }
    )


def bin_truth(contig_bin: DataFrame) -> DataFrame:
    """True bin of each contig of a replicate table.

    A moved contig belongs to the bin in its name; names end in ``_contig...``.
    """
    contig = F.col("contig")
    own = remove_first(contig, "contamination_")
    source = F.when(contig.contains("contamination"), own).otherwise(F.col("bin"))
    return contig_bin.withColumns({"bin_truth": remove_first(source, "_contig.*"), "contig": own})


def score_contamination(replicates: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows of all replicates with actual and predicted contamination.

    ``replicates``: sample, benchmark, contig, bin with prefixed contigs;
    ``predicted``: sample, benchmark, contig, bin; ``truth``: sample, contig, bin_truth.
    """
    contig = remove_first(F.col("contig"), "contamination_")
    rows = replicates.withColumns(
        {"actual": F.col("contig").contains("contamination_"), "contig": contig}
    )
    hits = (
        predicted.select("sample", "benchmark", contig.alias("contig"), "bin")
        .distinct()
        .withColumn("predicted", F.lit(True))
    )
    joined = natural_left(natural_left(rows, truth), hits).fillna({"predicted": False})
    return joined.withColumn("measure", measure(F.col("actual"), F.col("predicted")))


def home_cluster(sizes: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Per method and bin the cluster with most bases; ties are kept."""
    best = argmax_join(sizes, [*extra, "method", "bin"], "cluster_length")
    return best.withColumnRenamed("cluster", "bin_cluster").drop("cluster_length", "n_contigs")


def flag_foreign(results: DataFrame, homes: DataFrame, n: int = 3, at_least: bool = False) -> DataFrame:
    """Contigs that ``n`` methods place outside the home cluster of their bin."""
    rows = results.join(homes.select("bin", "method", "bin_cluster"), ["bin", "method"])
    votes = rows.groupBy("contig").agg(
        F.sum((F.col("bin_cluster") != F.col("cluster")).cast("long")).alias("sum_predictions")
    )
    return votes.filter(F.col("sum_predictions") >= n if at_least else F.col("sum_predictions") == n)


def assign_unbinned(
    results: DataFrame, homes: DataFrame, n_methods: int = 3, unbinned: str = "unbinned"
) -> DataFrame:
    """Unbinned contigs with the bins whose home cluster they share.

    An assignment is unique when in each of ``n_methods`` methods exactly one
    bin shares the cluster.
    """
    targets = homes.select(F.col("bin").alias("assigned_bin"), "method", F.col("bin_cluster").alias("cluster"))
    joined = results.filter(F.col("bin") == unbinned).join(targets, ["cluster", "method"])
    per_method = joined.groupBy("contig", "method").agg(F.count("*").alias("__n")).filter("__n = 1")
    unique = (
        per_method.groupBy("contig")
        .agg(F.count("*").alias("__m"))
        .filter(F.col("__m") == n_methods)
        .select("contig", F.lit(True).alias("assignment_is_unique"))
    )
    return joined.join(unique, "contig", "left").fillna({"assignment_is_unique": False})


def confidence_tiers(
    votes: DataFrame, methods: Sequence[str] = ("svm", "knn", "rf"), high: float = 0.8
) -> DataFrame:
    """Votes with their mean probability and confidence tier.

    Expects ``contig, method, assigned_bin, prob`` (one row per contig and
    method). All methods agreeing gives high or medium confidence by the mean
    probability; two bins give low confidence for the bin that two methods
    share, with the mean over these two; three bins are dropped.
    """
    used = votes.filter(F.col("method").isin(list(methods)))
    per_bin = used.groupBy("contig", "assigned_bin").agg(
        F.count("*").alias("__votes"), F.avg("prob").alias("mean_prob")
    )
    per_contig = per_bin.groupBy("contig").agg(F.count("*").alias("__bins"))
    kept = per_bin.join(per_contig, "contig").filter(
        (F.col("__bins") == 1) | ((F.col("__bins") == 2) & (F.col("__votes") == 2))
    )
    tier = (
        F.when(F.col("__bins") == 2, "low_confidence")
        .when(F.col("mean_prob") > high, "high_confidence")
        .otherwise("medium_confidence")
    )
    tiers = kept.select("contig", "assigned_bin", "mean_prob", tier.alias("confidence"))
    return used.join(tiers, ["contig", "assigned_bin"])


def soft_vote(probabilities: DataFrame, methods: Sequence[str] = ("lda", "knn", "rf")) -> DataFrame:
    """Mean class probability over the methods and the class with the largest one.

    Expects ``contig, method, class, prob``; a class a method does not name has
    probability 0. Equal means go to the class that sorts first.
    """
    used = probabilities.filter(F.col("method").isin(list(methods)))
    means = used.groupBy("contig", "class").agg(
        (F.sum("prob") / F.lit(float(len(methods)))).alias("prob")
    )
    # Rounded, so that equal means tie whatever the order of summation.
    rank = F.struct((-F.round("prob", 12)).alias("p"), F.col("class"))
    best = means.groupBy("contig").agg(F.min(rank).alias("b"))
    return best.select(
        "contig", (-F.col("b.p")).alias("confidence"), F.col("b.class").alias("classification")
    )


def apply_assignments(contig_bin: DataFrame, assignments: DataFrame) -> DataFrame:
    """Old pairs plus the contigs assigned with high confidence, flagged."""
    new = (
        assignments.filter(F.col("confidence") == "high_confidence")
        .select("contig", F.col("assigned_bin").alias("bin"))
        .distinct()
        .withColumn("included", F.lit(True))
    )
    return contig_bin.select("contig", "bin").withColumn("included", F.lit(False)).unionByName(new)


def contrast_features(
    df: DataFrame, group: Sequence[str], feature: str, value: str, hi: float, lo: float, n_low: int
) -> DataFrame:
    """Features that reach ``hi`` anywhere in the group, plus the ``n_low``
    highest of those whose group mean is under ``lo``.

    Means are rounded to nine digits, so that equal ones tie whatever the order
    of summation, and ties go by name.
    """
    mean = F.round(F.avg(value), 9).alias("mean")
    means = df.groupBy(*group, feature).agg(mean, F.max(value).alias("__top"))
    high = means.filter(F.col("__top") >= hi).withColumn("side", F.lit("high"))
    low = top_k(means.filter(F.col("mean") < lo), group, [F.desc("mean"), feature], n_low)
    return high.unionByName(low.withColumn("side", F.lit("low"))).drop("__top")


def stack_grid(methylation: DataFrame, metrics: DataFrame) -> DataFrame:
    """Feature means and metric means in one long table with a group label."""
    left = methylation.withColumn("group", F.lit("methylation"))
    right = metrics.withColumn("group", F.lit("metric"))
    return union_loose(left, right)


def home_shares(labels: DataFrame) -> DataFrame:
    """``labels`` (limit, bin, contig, cluster) with the home cluster of the bin and the share of its contigs there.

    The home cluster holds most contigs of a bin; of equal ones the first.
    """
    sizes = labels.groupBy("limit", "bin", "cluster").agg(F.count("*").alias("n"))
    most = F.min(F.struct((-F.col("n")).alias("less"), "cluster")).alias("best")
    homes = sizes.groupBy("limit", "bin").agg(most, F.sum("n").alias("all"))
    homes = homes.select("limit", "bin", F.col("best.cluster").alias("home"), (-F.col("best.less") / F.col("all")).alias("home_share"))
    return labels.join(homes, ["limit", "bin"]).select("limit", "bin", "contig", "cluster", "home", "home_share")
