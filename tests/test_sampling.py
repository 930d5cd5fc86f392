from hashlib import md5

import pytest
from pyspark.sql import functions as F

from locigrid.operators import sampling


def bins(spark, parts=4):
    rows = [(f"{b}_contig_{i}", b) for b, n in {"a": 6, "b": 4, "c": 5, "d": 1, "e": 2}.items() for i in range(n)]
    return spark.createDataFrame(rows, "contig string, bin string").repartition(parts)


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_injection_keeps_its_rules(spark, parts):
    table = bins(spark, parts)
    eligible = table.filter("bin IN ('a', 'b', 'c')")
    replicates, moves = sampling.inject_foreign(table, eligible, 5)
    assert moves.count() == 5 * 5  # every bin, every replicate
    first_gifts = {}
    for r in moves.collect():
        assert r["donor"] != r["bin"] and r["contig"].startswith(r["donor"])
        first_gifts.setdefault(r["benchmark"], []).append(r["donor"])
    for donors in first_gifts.values():
        counts = sorted(donors.count(d) for d in "abc")
        assert counts == [1, 2, 2]  # nobody gives twice before all gave once
    assert moves.select("benchmark", "contig").distinct().count() == 25
    for rep in range(5):
        rows = replicates.filter(F.col("benchmark") == rep).collect()
        assert len(rows) == 18
        moved = [r for r in rows if r["contig"].startswith("contamination_")]
        assert sorted(r["bin"] for r in moved) == list("abcde")
        kept = {r["contig"] for r in rows}
        assert all(r["contig"].replace("contamination_", "") not in kept for r in moved)


def test_layout_does_not_change_replicates(spark, rows):
    out = []
    for parts in (1, 4, 50):
        table = bins(spark, parts)
        eligible = table.filter("bin IN ('a', 'b', 'c')")
        out.append((rows(sampling.inject_foreign(table, eligible, 3)[0]), rows(sampling.holdout_one(table, eligible, 3)[0])))
    assert out[0] == out[1] == out[2]
    assert len(set(map(str, out[0][0]))) == 3 * 18


def test_injection_fails_when_a_donor_runs_out(spark):
    table = bins(spark)
    with pytest.raises(Exception, match="no contig left"):
        sampling.inject_foreign(table, table.filter("bin IN ('d')"), 1)[0].count()


def test_injection_passes_over_a_donor_with_nothing_left(spark):
    pairs = [("a1", "a")] + [(f"b{k}", "b") for k in range(4)] + [("c1", "c"), ("d1", "d")]
    table = spark.createDataFrame(pairs, "contig string, bin string")
    replicates, moves = sampling.inject_foreign(table, table.filter("bin IN ('a', 'b')"), 6)
    found = moves.collect()
    assert len(found) == 6 * 4 and all(r["donor"] != r["bin"] for r in found)
    assert {r["donor"] for r in found if r["bin"] in "cd"} == {"b"}
    assert moves.select("benchmark", "contig").distinct().count() == 24
    assert replicates.count() == 6 * 7


def test_holdout_removes_one_per_eligible_bin(spark, rows):
    table = bins(spark)
    eligible = table.filter("bin IN ('a', 'd')")
    kept, removed = sampling.holdout_one(table, eligible, 4)
    assert removed.count() == 8 and kept.count() == 4 * 18 - 8
    assert rows(removed.filter("bin = 'd'"), "contig") == [("d_contig_0",)] * 4
    assert removed.filter("bin = 'a'").select("contig").distinct().count() > 1


def test_eligible_needs_a_small_share(spark, rows):
    scored = spark.createDataFrame(
        [("a1", "GATC", "a", 100, 3.0), ("a2", "GATC", "a", 15, 3.0), ("a3", "GATC", "a", 10, 3.0), ("a4", "GATC", "a", 90, 2.0),
         ("b1", "GATC", "a", 50, 3.0), ("a5", "GATC", "m", 20, 3.0), ("zz", "GATC", "a", 50, 3.0)],
        "contig string, motif string, mod_type string, n_motif_obs long, mean_read_cov double",
    )
    pairs = spark.createDataFrame([(f"a{i}", "a") for i in range(1, 6)] + [("b1", "b")], "contig string, bin string")
    assert rows(sampling.eligible_small(scored, pairs)) == [("a2", "a")]


def test_samples(spark):
    df = spark.range(2_000).withColumn("g", F.col("id") % 2)
    share = sampling.sample_fraction(df, F.col("id"), 0.25, 11).count()
    assert 400 < share < 600
    assert sampling.sample_n(df, "id", 77, 1).count() == 77
    assert sampling.sample_n(df, "id", 5_000, 1).count() == 2_000
    per = sampling.sample_n(df, "id", 30, 1, ["g"]).groupBy("g").count().collect()
    assert [r["count"] for r in per] == [30, 30]


def test_half_of_the_keys_after_exclusion(spark):
    df = spark.createDataFrame([(c, i) for c in "abcdefg" for i in range(3)], "k string, i int")
    chosen = [r["k"] for r in sampling.choose_keys(df, "k", 1, ["a"]).collect()]
    assert len(chosen) == 3 and "a" not in chosen


def test_downsampling_and_published_formulas(spark):
    reads = spark.createDataFrame(
        [("big", f"r{i}", 10 + i % 7) for i in range(300)] + [("small", f"s{i}", 5) for i in range(4)],
        "sample string, read_id string, length long",
    )
    targets = spark.createDataFrame([("big", 500.0), ("small", 500.0)], "sample string, bases_required double")
    kept = sampling.downsample_to_coverage(reads, targets)
    report = {r["sample"]: r for r in sampling.downsample_report(reads, kept, targets).collect()}
    assert report["small"]["num_reads_required"] == 4 and not report["small"]["enough_bases"]
    assert report["big"]["enough_bases"] and 500 <= report["big"]["sampled_length_sum"] < 517


def test_count_check(spark):
    counts = spark.createDataFrame([("a", 95), ("b", 80)], "s string, observed long")
    expected = spark.createDataFrame([("a", 100), ("b", 100), ("c", 5)], "s string, expected long")
    checked = sampling.check_counts(counts, expected, "s", 10)
    assert {r["s"]: r["ok"] for r in checked.collect()} == {"a": True, "b": False, "c": True}
    with pytest.raises(Exception, match="too few reads"):
        sampling.require_counts(checked).collect()


def test_only_picks_that_can_be_given_are_ranked(spark, rows):
    sizes = {"a": 900, "b": 700, "c": 2, "d": 30, "e": 30, "f": 30, "g": 30}
    pairs = [(f"{b}{i}", b) for b, n in sizes.items() for i in range(n)]
    table = spark.createDataFrame(pairs, "contig string, bin string")
    donors = "abc"
    few = sampling._first_picks(table, table.filter(F.col("bin").isin(*donors)), 4, 42)
    assert few.count() < 4 * 200
    digest = lambda *parts: md5("|".join(map(str, parts)).encode()).hexdigest()
    expected = set()
    for r in range(4):
        ranked = sorted(donors, key=lambda b: digest(42, r, b))
        picks = {d: sorted((c for c, b in pairs if b == d), key=lambda c: digest(42, "pick", r, c)) for d in donors}
        expected |= {(r, picks[ranked[(k + 1) % 3]][0], ranked[(k + 1) % 3], b) for k, b in enumerate(ranked)}
        spare = [(picks[d][turn], d) for turn in range(1, 900) for d in ranked if turn < len(picks[d])]
        others = sorted("defg", key=lambda b: digest(42, r, b))
        expected |= {(r, *given, b) for given, b in zip(spare, others)}
    moves = sampling.inject_foreign(table, table.filter(F.col("bin").isin(*donors)), 4)[1]
    assert {tuple(m) for m in moves.select("benchmark", "contig", "donor", "bin").collect()} == expected
