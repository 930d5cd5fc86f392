import random
import re

import pytest
from pyspark.sql import functions as F

from locigrid.operators import intervals as iv
from locigrid.operators import sequences as sq
from locigrid.operators.aggregate import mod_pileup, score_motifs
from locigrid.operators.joins import motif_pileup


def random_sequences(n=12, longest=900, seed=5):
    rng = random.Random(seed)
    return {f"c{i}": "".join(rng.choices("ACGT", k=rng.randint(0, longest))) for i in range(n)}


def frame(spark, seqs):
    return spark.createDataFrame(list(seqs.items()), "contig string, seq string")


@pytest.mark.parametrize("size, step", [(100, 100), (100, 30), (50, 120)])
def test_windows(spark, size, step):
    seqs = random_sequences()
    df = frame(spark, seqs).withColumn("sample", F.lit("s"))
    got = {(r["contig"], r["start"]): (r["end"], r["seq"], r["header"]) for r in sq.sliding_fragments(df, size, step).collect()}
    wanted = {
        (c, i + 1): (i + size, s[i : i + size], f"s_{c}_sliding_{i + 1}-{i + size}")
        for c, s in seqs.items()
        for i in range(0, len(s) - size + 1, step)
    }
    assert got == wanted


def test_windows_rebuild_the_sequence(spark):
    seqs = {"c": "".join(random.Random(1).choices("ACGT", k=1_000))}
    df = frame(spark, seqs).withColumn("sample", F.lit("s"))
    parts = sq.sliding_fragments(df, 100, 100).orderBy("start").collect()
    assert "".join(p["seq"] for p in parts) == seqs["c"]


def test_motifs_on_both_strands_across_chunks(spark):
    seqs = random_sequences()
    motifs = [("GATC", "a", 1), ("RGATCY", "a", 2), ("CCWGG", "m", 1), ("GANNNTC", "a", 1), ("AA", "a", 0)]
    got = {
        (r["contig"], r["start"], r["strand"], r["motif"])
        for r in sq.find_motifs(frame(spark, seqs), motifs, chunk=37).collect()
    }
    wanted = set()
    for contig, seq in seqs.items():
        for motif, _, _ in motifs:
            for strand, text in (("+", motif), ("-", sq.reverse_complement(motif))):
                pattern = re.compile(f"(?=({sq.motif_pattern(text)}))")
                wanted |= {(contig, m.start(), strand, motif) for m in pattern.finditer(seq)}
    assert got == wanted
    assert sq.reverse_complement("RGATCY") == "RGATCY"


def test_modified_base_position_on_the_reverse_strand(spark, rows):
    occurrences = spark.createDataFrame(
        [("c", 10, "+", "GATC", "a", 0), ("c", 10, "-", "GATC", "a", 0)],
        "contig string, start long, strand string, motif string, mod_type string, mod_position int",
    )
    calls = spark.createDataFrame(
        [("c", 10, "+", "a", True), ("c", 10, "+", "a", False), ("c", 13, "-", "a", True), ("c", 13, "-", "a", None)],
        "contig string, pos long, strand string, mod_type string, is_mod boolean",
    )
    joined = motif_pileup(occurrences, mod_pileup(calls))
    assert rows(joined, "pos", "strand", "coverage", "fraction") == [(10, "+", 2, 0.5), (13, "-", 1, 1.0)]
    scores = score_motifs(joined, 1)
    assert rows(scores, "mean_read_cov", "n_motif_obs", "median") == [(1.5, 2, 0.75)]
    assert score_motifs(joined, 3).count() == 0


def windows(sample, contig, starts, size=10):
    return [(f"{sample}_contig_{contig}_sliding_{s}-{s + size - 1}", f"{contig}{s:03d}") for s in starts]


def test_first_run_is_merged(spark):
    records = (
        windows("s1", "1", [1, 11, 31])          # too short a run
        + windows("s1", "2", [51, 1, 11, 41, 31])  # 1-20 then 31-60, unsorted
        + windows("s1", "3", [1, 11, 21])          # also long enough, but later
        + windows("s2", "1", [1, 11])
        + [("plain", "x"), ("s3_contig_9", "y"), ("s3_contig_9_sliding_a-b", "z")]
    )
    df = spark.createDataFrame([(h, s, i) for i, (h, s) in enumerate(records)], "header string, seq string, row_order int")
    out = {r["header"]: r["seq"] for r in sq.concat_first_run(df, 3).collect()}
    assert out["s1_contig_2_concatenated_31-60"] == "203120412051"
    assert len(out) == len(records) - 3 + 1
    assert "s1_contig_2_sliding_1-10" in out and "plain" in out and "s3_contig_9" in out
    missing = sq.samples_without_run(df, sq.concat_first_run(df, 3))
    assert {r["sample"] for r in missing.collect()} == {"s2", "s3", "plain"}


def naive_depth(reads, length):
    depth = [0] * length
    for s, e in reads:
        for p in range(s, min(e, length)):
            depth[p] += 1
    return depth


@pytest.mark.parametrize("tile", [7, 1000])
def test_depth_and_means(spark, tile):
    rng = random.Random(2)
    length = 300
    reads = {c: [(s, s + rng.randint(1, 60)) for s in (rng.randint(0, 200) for _ in range(40))] for c in "ab"}
    reads["b"] += [(50, 60)] * 200  # a deep spot
    table = [(c, s, e) for c, rs in reads.items() for s, e in rs]
    df = spark.createDataFrame(table, "contig string, start long, `end` long").repartition(6)
    lengths = spark.createDataFrame([("a", length), ("b", length), ("none", 5)], "contig string, length long")
    whole = iv.depth_segments(df, lengths, tile).collect()
    covered = iv.depth_segments(df, tile=tile).collect()
    for c in "ab":
        wanted = naive_depth(reads[c], length)
        got = [None] * length
        parts = sorted((r["start"], r["end"], r["depth"]) for r in whole if r["contig"] == c)
        for s, e, d in parts:
            got[s:e] = [d] * (e - s)
        assert got == wanted
        assert all(a[2] != b[2] for a, b in zip(parts, parts[1:]))  # maximal
        assert sum((r["end"] - r["start"]) for r in covered if r["contig"] == c) == sum(d > 0 for d in wanted)
    assert [(r["start"], r["end"], r["depth"]) for r in whole if r["contig"] == "none"] == [(0, 5, 0)]
    asked = [(c, s, s + w) for c in ("a", "b", "none") for s, w in ((0, 5), (3, 100), (55, 1), (299, 1), (10, 0))]
    windows_ = spark.createDataFrame(asked, "contig string, start long, `end` long")
    for r in iv.mean_depth(windows_, df, tile).collect():
        wanted = naive_depth(reads.get(r["contig"], []), length)[r["start"] : r["end"]]
        assert r["mean_depth"] == (pytest.approx(sum(wanted) / len(wanted)) if wanted else None)


def test_breadth_and_unique_mapping(spark, rows):
    segments = spark.createDataFrame(
        [("c", "s1", 0, 95, 2), ("c", "s2", 0, 80, 1), ("c", "s2", 80, 100, 0), ("d", "s1", 0, 100, 1), ("d", "s2", 0, 100, 9)],
        "contig string, sample string, start long, `end` long, depth long",
    )
    lengths = spark.createDataFrame([("c", 100), ("d", 100)], "contig string, length long")
    coverage = iv.coverage_fraction(segments, lengths, 0.7)
    assert rows(coverage) == [("c", "s1", 0.95), ("c", "s2", 0.8), ("d", "s1", 1.0), ("d", "s2", 1.0)]
    assert rows(iv.unique_mapping(coverage, 0.9)) == [("c", "s1")]


def test_reads_of_alignments_keep_tags(spark, rows):
    df = spark.createDataFrame(
        [("r1", 0, "NM:i:1\tMM:Z:C+m\tML:B:C,1", "AC", "II"), ("r1", 256, "", "AC", "II"), ("r2", 2048, "", "A", "I"), ("r3", 16, "", "A", "I")],
        "read_id string, flag int, tags string, seq string, qual string",
    )
    assert rows(sq.reads_from_alignments(df), "read_id", "tags") == [("r1", "MM:Z:C+m\tML:B:C,1"), ("r3", "")]
