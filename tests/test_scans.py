import pytest
from pyspark.sql import functions as F

from locigrid.operators import aggregate, scans


def numbers(spark, n=500, parts=8):
    return spark.range(n, numPartitions=parts).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"),
        ((F.col("id") * 37) % 101).alias("v"),
    )


def by_group(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["g"], []).append(r)
    return out


@pytest.mark.parametrize("bucket", [None, "floor(id / 50)"])
def test_scan_steps_match_plain_loops(spark, bucket):
    df = numbers(spark)
    sparse = F.when(F.col("v") % 4 == 0, F.col("v"))
    out = (
        scans.OrderedScan(df, ["g"], ["id"], bucket and F.expr(bucket))
        .running_sum(F.col("v"), "total")
        .lag(F.col("v"), "prev")
        .lead(F.col("v"), "next")
        .fill_down(sparse, "known")
        .result()
    )
    assert out.columns == ["id", "g", "v", "total", "prev", "next", "known"]
    assert out.count() == 500
    for group in by_group(out).values():
        group.sort(key=lambda r: r["id"])
        total, known = 0, None
        for i, r in enumerate(group):
            total += r["v"]
            known = r["v"] if r["v"] % 4 == 0 else known
            assert (r["total"], r["known"]) == (total, known)
            assert r["prev"] == (group[i - 1]["v"] if i else None)
            assert r["next"] == (group[i + 1]["v"] if i + 1 < len(group) else None)


def test_global_and_group_rank(spark):
    df = numbers(spark)
    ranked = scans.rank_in_group(df, [], [F.desc("v"), "id"], "r").orderBy("r").collect()
    assert [r["r"] for r in ranked] == list(range(1, 501))
    assert [(-r["v"], r["id"]) for r in ranked] == sorted((-r["v"], r["id"]) for r in ranked)
    for group in by_group(scans.rank_in_group(df, ["g"], ["v", "id"], "r")).values():
        group.sort(key=lambda r: r["r"])
        assert [r["r"] for r in group] == list(range(1, len(group) + 1))
        assert [(r["v"], r["id"]) for r in group] == sorted((r["v"], r["id"]) for r in group)


@pytest.mark.parametrize("levels", [False, True])
@pytest.mark.parametrize("budget", [0, 1, 100, 10_000_000])
def test_take_until_is_the_smallest_prefix(spark, budget, levels, monkeypatch):
    monkeypatch.setattr(scans, "CUT_ROWS", 4)
    df = numbers(spark).withColumn("h", scans.seeded_hash(9, F.col("id")))
    bucket = scans.hash_digits(F.col("h"), 1) if levels else scans.hash_bucket(F.col("h"))
    kept = scans.take_until(df, ["g"], ["h", "id"], F.col("v"), F.lit(budget), bucket)
    kept = {g: {r["id"] for r in rows} for g, rows in by_group(kept).items()}
    for g, rows in by_group(df).items():
        wanted, total = set(), 0
        for r in sorted(rows, key=lambda r: (r["h"], r["id"])):
            if total >= budget:
                break
            wanted.add(r["id"])
            total += r["v"]
        assert kept.get(g, set()) == wanted


@pytest.mark.parametrize("bucket", [None, "floor(s / 7)"])
def test_runs_cross_buckets(spark, bucket):
    taken = [s for s in range(100) if s not in (0, 13, 14, 50)]
    df = spark.createDataFrame([(g, s, s) for g in ("a", "b") for s in taken], "g string, s long, e long")
    out = scans.consecutive_runs(df.repartition(5), ["g"], "s", "e", bucket=bucket and F.expr(bucket))
    for group in by_group(out).values():
        group.sort(key=lambda r: r["s"])
        run, place, last = 0, 0, None
        for r in group:
            run, place = (run, place + 1) if last == r["s"] - 1 else (run + 1, 1)
            assert (r["run"], r["place"]) == (run, place), r
            last = r["s"]


@pytest.mark.parametrize("limit, sketch", [(1 << 20, 10_000), (60, 10_000), (60, 50), (0, 20)])
@pytest.mark.parametrize("group", [["g"], []])
def test_quantiles_of_large_groups(spark, monkeypatch, limit, sketch, group):
    import numpy as np

    monkeypatch.setattr(aggregate, "GROUP_ROWS", limit)
    monkeypatch.setattr(aggregate, "SKETCH", sketch)
    df = numbers(spark)
    out = aggregate.exact_quantiles(df, group, "v", {"q0": 0.0, "q1": 0.25, "m": 0.5, "q9": 0.9, "q100": 1.0})
    found = {tuple(r[c] for c in group): (r["q0"], r["q1"], r["m"], r["q9"], r["q100"]) for r in out.collect()}
    everything = by_group(df)
    if not group:
        everything = {None: [r for rows in everything.values() for r in rows]}
    assert len(found) == len(everything)
    for g, rows in everything.items():
        wanted = np.quantile([r["v"] for r in rows], [0, 0.25, 0.5, 0.9, 1])
        assert found[(g,) if group else ()] == pytest.approx(tuple(wanted))


def test_empty_and_single_row(spark):
    empty = numbers(spark).filter("id < 0")
    assert scans.ordered_index(empty, ["id"], "i").count() == 0
    assert aggregate.exact_quantiles(empty, ["g"], "v", {"m": 0.5}).count() == 0
    one = numbers(spark).filter("id = 7")
    assert scans.OrderedScan(one, ["g"], ["id"]).lag(F.col("v"), "p").result().first()["p"] is None


def test_first_and_nth_rows(spark, rows):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "g string, o int, v string")
    assert rows(scans.first_per_group(df, ["g"], ["o"])) == [("a", 1, "y"), ("b", 5, "z")]
    assert rows(scans.nth_row(df, ["g"], ["o"], 2)) == [("a", 2, "x")]


def test_a_budget_in_one_large_group_sorts_few_rows(spark, monkeypatch):
    monkeypatch.setattr(scans, "CUT_ROWS", 50)
    sorted_rows = []
    plain = scans._sorted_cut
    monkeypatch.setattr(scans, "_sorted_cut", lambda rows, order: sorted_rows.append(rows.count()) or plain(rows, order))
    df = spark.range(60_000).withColumn("h", scans.seeded_hash(1, F.col("id")))
    # one digit a level: the first bucket that is cut holds a sixteenth of the rows
    kept = scans.take_until(df, [], ["h", "id"], F.lit(1), F.lit(31_234), scans.hash_digits(F.col("h"), 1))
    assert kept.count() == 31_234
    assert len(sorted_rows) == 3 and sum(sorted_rows) <= 50
    last = df.orderBy("h").limit(31_234).agg(F.max("h")).first()[0]
    assert kept.agg(F.max("h")).first()[0] == last
