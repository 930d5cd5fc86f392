"""Seeded sampling and benchmark replicates.

Order comes from a hash of seed, replicate and key, so results do not depend on
the number of partitions. Replicates are a key column, not a loop.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locigrid.operators.aggregate import share_of_group
from locigrid.operators.joins import anti
from locigrid.operators.scans import (
    OrderedScan,
    hash_bucket,
    hash_digits,
    hash_fraction,
    seeded_hash,
    take_until,
)
from locigrid.operators.shape import min_evidence
from locigrid.session import cut_lineage, sized


def sample_fraction(df: DataFrame, key: Column, share: Column | float, seed: int) -> DataFrame:
    """About a share of the rows, decided row by row: no shuffle."""
    limit = F.lit(float(share)) if not isinstance(share, Column) else share
    return df.filter(hash_fraction(seeded_hash(seed, key)) < limit)


def sample_n(
    df: DataFrame, key: str, n: Column | int, seed: int, group: Sequence[str] = ()
) -> DataFrame:
    """Exactly ``n`` rows (all if there are fewer) per group, lowest hashes first."""
    size = F.lit(n) if isinstance(n, int) else n
    hashed = df.withColumn("__h", seeded_hash(seed, F.col(key)))
    kept = take_until(
        hashed, list(group), ["__h", key], F.lit(1), size, hash_digits(F.col("__h"))
    )
    return kept.drop("__h")


def with_replicates(df: DataFrame, n: int) -> DataFrame:
    """Each row once per replicate 0..n-1."""
    return df.withColumn("benchmark", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def eligible_small(
    scored: DataFrame,
    contig_bin: DataFrame,
    motif: str = "GATC",
    mod_type: str = "a",
    max_share: float = 0.2,
    min_cov: float = 2,
    evidence: float = 40,
) -> DataFrame:
    """(contig, bin) of contigs that hold a small share of the observations of
    one motif in their bin."""
    rows = min_evidence(scored, evidence, min_cov).filter(
        (F.col("motif") == motif) & (F.col("mod_type") == mod_type)
    )
    rows = rows.select("contig", "n_motif_obs").join(contig_bin, "contig")
    shares = share_of_group(rows, ["bin"], "n_motif_obs", "obs_percentage")
    return shares.filter(F.col("obs_percentage") < max_share).select("contig", "bin").distinct()


def holdout_one(
    contig_bin: DataFrame, eligible: DataFrame, replicates: int, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Per replicate each bin with eligible contigs loses one of them.

    Returns the replicate tables and the removed (benchmark, bin, contig) rows.
    """
    drawn = with_replicates(eligible.select("bin", "contig"), replicates)
    chosen = F.min_by("contig", F.struct(seeded_hash(seed, F.col("benchmark"), F.col("contig")), "contig"))
    removed = drawn.groupBy("benchmark", "bin").agg(chosen.alias("contig"))
    kept = anti(with_replicates(contig_bin, replicates), removed, ["benchmark", "bin", "contig"])
    return kept.select("benchmark", "contig", "bin"), removed


def inject_foreign(
    contig_bin: DataFrame, eligible: DataFrame, replicates: int, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Per replicate every bin receives one contig of another bin.

    Each contig moves at most once and leaves its donor, and every donor gives
    once before any gives twice. Bins with eligible contigs are ranked by hash
    and give their first contig to the bin of the next rank. The other bins take
    the further contigs, all second ones in rank order, then all third ones, so
    a donor that has none left is passed over. The job fails only where the
    eligible contigs are fewer than the bins, or all belong to one bin.

    Returns the replicate tables, with ``contamination_`` before moved contigs,
    and the moves (benchmark, contig, donor, bin).
    """
    bins = contig_bin.select("bin").distinct()
    donors = eligible.select("bin").distinct().withColumn("__donor", F.lit(True))
    tagged = with_replicates(bins.join(donors, "bin", "left").fillna({"__donor": False}), replicates)
    tagged = tagged.withColumn("__h", seeded_hash(seed, F.col("benchmark"), F.col("bin")))
    ranked = (
        OrderedScan(
            tagged, ["benchmark", "__donor"], ["__h", "bin"], hash_bucket(F.col("__h"))
        )
        .running_sum(F.lit(1), "__r")
        .result()
        .withColumn("__r", F.col("__r") - 1)
    )
    ranked = cut_lineage(ranked)
    n_donors = ranked.filter("__donor").groupBy("benchmark").agg(F.count("*").alias("__d"))
    givers = ranked.filter("__donor").select("benchmark", F.col("bin").alias("donor"), F.col("__r").alias("__from"))
    picks = _first_picks(contig_bin, eligible, replicates, seed)
    picks = (
        OrderedScan(picks, ["benchmark", "donor"], ["__h", "contig"], hash_bucket(F.col("__h")))
        .running_sum(F.lit(1), "__pick")
        .result()
        .drop("__h")
    )
    # a round holds at most one contig per donor
    owned = picks.join(givers, ["benchmark", "donor"])
    spare = (
        OrderedScan(owned.filter("__pick > 1"), ["benchmark"], ["__pick", "__from"], F.col("__pick"))
        .running_sum(F.lit(1), "__place")
        .result()
        .select("benchmark", "donor", "contig", "__place")
    )
    next_rank = F.pmod(F.col("__r") + 1, F.col("__d")).alias("__from")
    swaps = ranked.filter("__donor").join(n_donors, "benchmark").select("benchmark", "bin", next_rank)
    swaps = swaps.join(owned.filter("__pick = 1").drop("__pick"), ["benchmark", "__from"], "left").drop("__from")
    gifts = ranked.filter("NOT __donor").select("benchmark", "bin", (F.col("__r") + 1).alias("__place"))
    gifts = gifts.join(spare, ["benchmark", "__place"], "left").drop("__place")
    moves = swaps.unionByName(gifts)
    usable = F.col("contig").isNotNull() & (F.col("donor") != F.col("bin"))
    failed = F.assert_true(usable, F.lit("no contig left to give"))
    # Bins times replicates rows; both results read them.
    moves = sized(moves.filter(failed.isNull()).select("benchmark", "contig", "donor", "bin"))
    # a row becomes one per replicate, so few rows are dealt to all tasks first
    dealt = contig_bin.repartition(4 * contig_bin.sparkSession.sparkContext.defaultParallelism)
    kept = anti(with_replicates(dealt, replicates), moves, ["benchmark", "contig"])
    moved = moves.select(
        "benchmark", F.concat(F.lit("contamination_"), F.col("contig")).alias("contig"), "bin"
    )
    return kept.select("benchmark", "contig", "bin").unionByName(moved), moves


def _first_picks(contig_bin: DataFrame, eligible: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Per replicate and donor the eligible contigs of least hash, at least as many as it can have to give.

    Givers take turns, so a donor gives no contig beyond the round in which all
    bins are served; the sizes of the donors name that round for all replicates.
    """
    bins = contig_bin.select("bin").distinct()
    owned = eligible.select(F.col("bin").alias("donor"), "contig").distinct()
    owned = owned.join(bins.select(F.col("bin").alias("donor")), "donor", "left_semi")
    sizes = cut_lineage(owned.groupBy("donor").agg(F.count("*").alias("__n")))
    # One row per size: far fewer than contigs.
    alike = sizes.groupBy("__n").agg(F.count("*")).collect()
    wanted, most = bins.count(), max((n for n, _ in alike), default=1)
    turns = bisect_left(range(most), wanted, lo=1, key=lambda k: sum(min(n, k) * d for n, d in alike))
    # about twice as many as needed have a hash below this share of all; leading hex digits of one hash
    share = F.least(F.lit(1.0), (2.0 * turns + 40) / F.col("__n"))
    limit = F.when(share < 1, F.lpad(F.lower(F.hex((share * 4294967296).cast("long"))), 8, "0")).otherwise("g")
    limits = sizes.select("donor", limit.alias("__limit"))
    hashed = with_replicates(owned.join(sized(limits), "donor"), replicates).withColumn(
        "__h", seeded_hash(seed, "pick", F.col("benchmark"), F.col("contig"))
    )
    picks = cut_lineage(hashed.filter(F.col("__h") < F.col("__limit")).drop("__limit"))
    found = picks.groupBy("donor", "benchmark").agg(F.count("*").alias("__found"))
    short = with_replicates(sizes, replicates).join(found, ["donor", "benchmark"], "left")
    short = short.filter(F.coalesce("__found", F.lit(0)) < F.least(F.col("__n"), F.lit(turns)))
    return picks if short.isEmpty() else hashed.drop("__limit")


def choose_keys(
    df: DataFrame, key: str, seed: int, exclude: Sequence[str] = (), share: float = 0.5
) -> DataFrame:
    """A share of the distinct keys, counted before ``exclude`` is taken out."""
    keys = df.select(key).distinct()
    wanted = keys.agg(F.floor(F.count("*") * F.lit(share)).alias("n"))
    candidates = keys.filter(~F.col(key).isin(list(exclude))) if exclude else keys
    sized = candidates.withColumn("__n", wanted.scalar())
    return sample_n(sized, key, F.col("__n"), seed).select(key)


def downsample_to_coverage(
    reads: DataFrame, targets: DataFrame, seed: int = 1236, group: str = "sample"
) -> DataFrame:
    """Shuffled reads of each sample until the required bases are reached.

    ``targets`` holds ``group`` and ``bases_required``; a sample whose total is
    not above its target keeps all reads.
    """
    tagged = reads.join(targets, group).withColumn("__h", seeded_hash(seed, F.col("read_id")))
    kept = take_until(
        tagged, [group], ["__h", "read_id"], F.col("length"), F.col("bases_required"),
        hash_digits(F.col("__h")),
    )
    return kept.select(*reads.columns)


def downsample_report(reads: DataFrame, sampled: DataFrame, targets: DataFrame, group: str = "sample") -> DataFrame:
    """Reads and bases kept per sample, with the enough-bases flag."""
    total = reads.groupBy(group).agg(F.sum("length").alias("total_bp"), F.count("*").alias("num_reads"))
    kept = sampled.groupBy(group).agg(
        F.count("*").alias("num_reads_required"), F.sum("length").alias("sampled_length_sum")
    )
    return (
        total.join(targets, group)
        .join(kept, group, "left")
        .withColumn("enough_bases", F.col("bases_required") < F.col("total_bp"))
        .drop("bases_required")
    )


def check_counts(counts: DataFrame, expected: DataFrame, key: str, tolerance: int = 10) -> DataFrame:
    """Observed against expected numbers; ``ok`` is FALSE when reads are missing."""
    joined = expected.join(counts, key, "left").fillna({"observed": 0})
    return joined.withColumn("ok", F.col("observed") >= F.col("expected") - tolerance)


def require_counts(checked: DataFrame) -> DataFrame:
    """Fail at run time on the first row that is not ``ok``."""
    return checked.filter(F.assert_true(F.col("ok"), F.lit("too few reads")).isNull())


