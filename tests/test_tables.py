"""Joins, shapes, text, numbers, files."""

import random

import pytest
from pyspark.sql import functions as F

from locigrid.functions import numeric as num
from locigrid.functions import text as txt
from locigrid.operators import aggregate as agg
from locigrid.operators import joins, shape
from locigrid.operators import sequences as sequence_operators
from locigrid.session import work_path
from locigrid.sources import sequences as seq_io
from locigrid.sources import sinks
from locigrid.sources import tables as tab


def one(spark, column, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"{column} {kind}").select(expr).first()[0]


def test_null_keys_match(spark, rows):
    a = spark.createDataFrame([(None, 1), ("x", 2), ("y", 3)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("x", 20), ("z", 30)], "k string, w int")
    assert rows(joins.natural_left(a, b)) == [("x", 2, 20), ("y", 3, None), (None, 1, 10)]
    assert rows(joins.unmatched_keys(a, b, ["k"])) == [("y", "left"), ("z", "right")]
    assert rows(joins.anti(a, b, ["k"]), "v") == [(1,), (3,)]
    stats = agg.with_group_stats(a.unionByName(a), ["k"], n=F.count("*"))
    assert {r["n"] for r in stats.collect()} == {2}


@pytest.mark.parametrize("block", [50_000, 3])
def test_grid(spark, rows, monkeypatch, block):
    monkeypatch.setattr(joins, "DIMENSION_BLOCK", block)
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    b = spark.createDataFrame([(i,) for i in range(10)] * 2, "n int")
    assert rows(joins.pair_with_values(a, b)) == sorted([(k, i) for k in "xy" for i in range(10)], key=str)
    assert joins.pair_with_values(a, b.filter("n < 0")).count() == 0
    data = spark.createDataFrame([("x", 3, 1.5)], "k string, n int, v double")
    dense = joins.densify(data, [a, b], {"v": 0.0})
    assert dense.count() == 20 and dense.agg(F.sum("v")).first()[0] == 1.5


def test_ties_and_templates(spark, rows):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 1.0), ("b", 4, None)], "k string, i int, v double")
    assert rows(joins.argmax_join(df, ["k"], "v"), "i") == [(1,), (2,)]
    assert rows(agg.keep_max(df, ["k"], "v"), "i") == [(1,), (2,)]
    template = spark.createDataFrame([("a",), ("z",)], "k string")
    counts = df.groupBy("k").agg(F.count("*").alias("n"))
    assert rows(joins.complete_to(counts, template, ["k"], {"n": 0})) == [("a", 3), ("z", 0)]


def test_assertions(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, i int")
    other = spark.createDataFrame([("a",), ("b",)], "k string")
    assert joins.assert_same_keys(df, other.filter("k = 'a'"), ["k"]).count() == 2
    with pytest.raises(Exception, match="key sets differ"):
        joins.assert_same_keys(df, other, ["k"]).collect()
    assert agg.assert_unique(df, ["i"]).count() == 2
    with pytest.raises(Exception, match="not unique"):
        agg.assert_unique(df, ["k"]).collect()


def test_missing_values(spark, rows):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 0.5)], "i int, v double")
    assert rows(shape.present(df, "v"), "i") == [(3,)]
    assert shape.nan_to_null(df).filter("v IS NULL").count() == 2
    ordered = shape.with_order(spark.createDataFrame([("b",), ("q",), (None,)], "x string"), "x", ["a", "b"], "o")
    assert rows(ordered, "o") == [(2,), (None,), (None,)]


def test_nest_splits_large_keys(spark):
    df = spark.range(1_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("b").alias("k"), "id")
    cells = shape.nest(df, ["k"], ["id"], rows_per_cell=50)
    assert cells.agg(F.max(F.size("rows"))).first()[0] < 150
    assert shape.unnest(cells, "rows").select("k", "id").exceptAll(df).count() == 0


def test_repair_and_first_reads(spark, rows):
    df = spark.createDataFrame(
        [("f1", 2, 0.1, 8.0), ("f1", 1, 4.0, 8.0), ("f2", 1, 0.2, 8.0), ("f3", 1, 3.0, 0.0)],
        "file string, n long, scale double, digitisation double",
    )
    assert rows(shape.files_needing_repair(df, "file", "n"), "file") == [("f1",), ("f3",)]
    assert shape.files_needing_repair(df, "file", "n", deep=True).count() == 3
    assert rows(shape.repair_scale(df), "scale") == [(0.1,), (0.2,), (0.5,), (None,)]


@pytest.mark.parametrize(
    "text, pattern, new, wanted",
    [
        ("s_contig_1_contig_2", "_contig.*", "", "s"), ("aXbX", "X", "-", "a-bX"), ("abc", "X", "-", "abc"),
        (None, "X", "-", None), ("contamination_contamination_x", "contamination_", "", "contamination_x"),
        ("a$1", "a", "$0\\", "$0\\$1"),
    ],
)
def test_first_match_only(spark, text, pattern, new, wanted):
    assert one(spark, "t", text, txt.replace_first(F.col("t"), pattern, new)) == wanted


@pytest.mark.parametrize(
    "motif, position, code, wanted",
    [
        ("GATC", 1, "a", "G<strong>A<sub>m6</sup></strong>TC"),
        ("CCWGG", 0, "m", "<strong>C<sub>m5</sup></strong>CWGG"),
        ("CATNNNNTTC", 1, "a", "C<strong>A<sub>m6</sup></strong>T(N)<sub>4</sub>TTC"),
        ("GANTC", 1, "zz", "G<strong>A<sub>NA</sup></strong>NTC"),
    ],
)
def test_motif_label(spark, motif, position, code, wanted):
    df = spark.createDataFrame([(motif, position, code)], "m string, p int, c string")
    assert df.select(txt.motif_label(F.col("m"), F.col("p"), F.col("c"))).first()[0] == wanted


@pytest.mark.parametrize(
    "header, wanted",
    [
        ("s_contig_1_sliding_1-20", ("s", "1", "1-20")), ("s", ("s", None, None)), ("s_contig_1", ("s", "1", None)),
        ("s_sliding_5-6", ("s", None, "5-6")), ("a_contig_b_contig_1_sliding_x_sliding_1-2", ("a_contig_b", "1_sliding_x", "1-2")),
    ],
)
def test_headers(spark, header, wanted):
    df = spark.createDataFrame([(header,)], "h string").select(*txt.header_parts(F.col("h")))
    assert tuple(df.first()) == wanted
    parts = spark.createDataFrame([(wanted[2],)], "w string").select(*txt.parse_range(F.col("w"))).first()
    assert tuple(parts) == (tuple(int(x) for x in wanted[2].split("-")) if wanted[2] else (None, None))


def test_labels_and_rounding(spark):
    df = spark.createDataFrame([(None, 2_500), ("x", 3_500)], "t string, n long")
    got = df.select(txt.paste("a ", F.col("t")), txt.kbp_label(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("a NA", "2 kbp"), ("a x", "4 kbp")]
    values = spark.createDataFrame([(0.125,), (0.5,), (1.0,), (None,)], "v double")
    assert [r[0] for r in values.select(txt.number_label(F.col("v"))).collect()] == ["0.12", "0.5", "1", None]


def test_numbers(spark):
    assert one(spark, "q", "I" * 10, num.mean_quality(F.col("q"))) == pytest.approx(40.0)
    mixed = one(spark, "q", "!I", num.mean_quality(F.col("q")))
    assert mixed == pytest.approx(3.0099, abs=1e-3)
    assert one(spark, "q", "", num.mean_quality(F.col("q"))) is None
    assert one(spark, "s", "acgtNNGG", num.gc_fraction(F.col("s"))) == pytest.approx(4 / 6)
    assert one(spark, "s", "NN", num.gc_fraction(F.col("s"))) is None
    assert one(spark, "x", 3.0, num.capped_share(F.lit(40.0), F.col("x")), "double") == 1.0
    assert one(spark, "x", 90.0, num.capped_share(F.lit(40.0), F.col("x")), "double") == 0.44
    tiers = spark.createDataFrame([(90.0, 4.9), (90.0, 5.0), (50.0, 9.0), (49.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in tiers.select(num.quality_tier(F.col("a"), F.col("b"))).collect()] == ["HQ", "MQ", "MQ", "LQ", "LQ"]


def test_histogram_bins_are_right_closed(spark, rows):
    df = spark.createDataFrame([(5.0,), (5.1,), (15.0,), (-5.0,), (0.0,)], "x double")
    assert rows(agg.histogram(df, "x")) == [(-10.0, 1), (0.0, 2), (10.0, 2)]


def write_text(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_fasta_file(spark, rows, tmp_path):
    write_text(tmp_path / "a.fa", ">c1 first one\r\nACGT\r\nAC\n\n>c2\n>c3 empty before\nGG GG\n")
    write_text(tmp_path / "b.fa", ">d1\nTTTT")
    got = rows(seq_io.read_fasta(spark, str(tmp_path)))
    assert got == [("c1", "c1 first one", "ACGTAC"), ("c2", "c2", ""), ("c3", "c3 empty before", "GGGG"), ("d1", "d1", "TTTT")]


def test_files_are_split_and_still_parsed(spark, tmp_path):
    records = [(f"r{i}", f"MM:Z:{i}", "ACGT" * (1 + i % 9), "@@@@" * (1 + i % 9)) for i in range(3_000)]
    write_text(tmp_path / "x.fq", "".join(f"@{r}\t{t}\n{s}\n+\n{q}\n" for r, t, s, q in records))
    write_text(tmp_path / "x.fa", "".join(f">{r} {t}\n{s}\n" for r, t, s, _ in records))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        reads = seq_io.read_fastq(spark, str(tmp_path / "x.fq"))
        seqs = seq_io.read_fasta(spark, str(tmp_path / "x.fa"))
        assert seqs.rdd.getNumPartitions() > 4
        assert sorted(tuple(r) for r in reads.collect()) == sorted(records)
        assert sorted((r["contig"], r["seq"]) for r in seqs.collect()) == sorted((r, s) for r, _, s, _ in records)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_header_must_agree(spark, tmp_path):
    write_text(tmp_path / "t.tsv", "b\ta\n1\tx\nNaN\ty\n")
    with pytest.raises(Exception):
        tab.read_table(spark, str(tmp_path / "t.tsv"), "a string, b double").collect()
    named = tab.read_table(spark, str(tmp_path / "t.tsv"), "a string, b double", by_name=True)
    assert sorted(map(str, (tuple(r) for r in named.collect()))) == ["('x', 1.0)", "('y', None)"]


def test_missing_and_existing_targets(spark, tmp_path):
    assert tab.read_or_empty(spark, str(tmp_path / "no" / "*.tsv"), "a int").count() == 0
    df = spark.range(3)
    sinks.write_table(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        sinks.write_table(df, str(tmp_path / "out"))
    sinks.write_empty(spark, str(tmp_path / "empty"), "bin string, n long")
    assert tab.read_table(spark, str(tmp_path / "empty"), "bin string, n long").count() == 0
    assert any(p.read_text() == "bin\tn\n" for p in (tmp_path / "empty").glob("*.csv"))


def test_work_folder_follows_the_setting(spark):
    first, second = work_path(spark, "x"), work_path(spark, "x")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


@pytest.mark.parametrize("limit", [0, 500_000])
def test_summaries_join_the_same_way_at_any_size(spark, rows, monkeypatch, limit):
    from locigrid import session

    monkeypatch.setattr(session, "BROADCAST_ROWS", limit)
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0)], "k string, v double")
    assert rows(agg.share_of_group(df, ["k"], "v", "s"), "v", "s") == [(1.0, 0.25), (2.0, 1.0), (3.0, 0.75)]
    assert rows(joins.argmax_join(df, ["k"], "v"), "v") == [(2.0,), (3.0,)]


def test_a_long_record_is_read_and_cut_by_many_tasks(spark, tmp_path):
    pick = random.Random(2)
    record = lambda n: "".join(pick.choices("ACGT", k=n))
    records = {"c1": record(50_003), "c2": "", "c3": record(7), "c4": record(3_000)}
    width = {"c1": 61, "c2": 60, "c3": 3, "c4": 3_000}
    wrap = lambda c: "".join(records[c][i : i + width[c]] + "\r\n" for i in range(0, len(records[c]), width[c]))
    write_text(tmp_path / "x.fa", "".join(f">{c} note\n{wrap(c)}\n" for c in records))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        spans = seq_io.read_fasta_spans(spark, str(tmp_path / "x.fa"), 1_000)
        got = sorted((r["contig"], r["start"], r["seq"]) for r in spans.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((c, i, s[i : i + 1_000]) for c, s in records.items() for i in range(0, len(s), 1_000))
    for size, step in ((700, 300), (1_000, 1_000), (2_500, 700), (10, 1_700)):
        found = sorted((r["contig"], r["start"], r["end"], r["seq"]) for r in sequence_operators.span_windows(spans, 1_000, size, step).collect())
        assert found == sorted((c, i + 1, i + size, s[i : i + size]) for c, s in records.items() for i in range(0, len(s) - size + 1, step))


def test_lines_of_one_split_are_numbered_in_small_buckets(spark, tmp_path, monkeypatch):
    records = {f"r{k}": "ACGT" * (k * 7) for k in range(12)}
    write_text(tmp_path / "y.fa", "".join(f">{c}\n" + "".join(s[i : i + 9] + "\n" for i in range(0, len(s), 9)) for c, s in records.items()))
    monkeypatch.setattr(seq_io, "LINE_BITS", 2)
    held = []
    running = seq_io.OrderedScan.running_sum

    def counted(scan, value, name):
        held.extend(r["count"] for r in scan.df.groupBy("__group", "__bucket").count().collect())
        return running(scan, value, name)

    monkeypatch.setattr(seq_io.OrderedScan, "running_sum", counted)
    spans = seq_io.read_fasta_spans(spark, str(tmp_path / "y.fa"), 50)
    got = sorted((r["contig"], r["start"], r["seq"]) for r in spans.collect())
    assert got == sorted((c, i, s[i : i + 50]) for c, s in records.items() for i in range(0, len(s), 50))
    assert len(held) > 10 and max(held) <= 4


def test_ordered_text_of_one_large_group(spark):
    rows = spark.range(20_000).selectExpr("'g' AS g", "id", "concat('<', id, '>') AS s").union(spark.createDataFrame([("h", 1, None), (None, 2, "b"), (None, 1, "a")], "g string, id long, s string"))
    parts = shape.ordered_text(rows, ["g"], ["id"], "s", 1_000).collect()
    mine = sorted((r["part"], r["joined"]) for r in parts if r["g"] == "g")
    assert [k for k, _ in mine] == list(range(len(mine))) and len(mine) > 100
    assert max(len(t) for _, t in mine) < 1_010
    assert "".join(t for _, t in mine) == "".join(f"<{k}>" for k in range(20_000))
    assert sorted((r["g"] or "", r["joined"]) for r in parts if r["g"] != "g") == [("", "ab"), ("h", "")]


def test_reads_without_bases_keep_their_record(spark, rows, tmp_path):
    reads = spark.createDataFrame([("r1", "t", "ACGT", "@@@@"), ("r2", "", "", ""), ("r3", None, None, None), ("r4", "u", "A", "I")], "read_id string, tags string, seq string, qual string")
    sinks.write_fastq(reads.coalesce(1), str(tmp_path / "fq"))
    got = rows(seq_io.read_fastq(spark, str(tmp_path / "fq")))
    assert got == [("r1", "t", "ACGT", "@@@@"), ("r2", "", "", ""), ("r3", "", "", ""), ("r4", "u", "A", "I")]


def test_a_grid_is_summed_without_its_cells(spark, rows):
    data = spark.createDataFrame([("a", 1, 5.0), ("a", 2, -1.0), (None, 1, 2.0), ("x", 9, 7.0)], "k string, d int, v double")
    dims = {"k": spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "k string"), "d": spark.createDataFrame([(1,), (2,), (3,)], "d int")}
    got = {r["k"]: r for r in joins.grid_summary(data, dims, "k", "v", 1.0).collect()}
    dense = joins.densify(data.filter("k IS NULL OR k <> 'x'"), [dims["k"], dims["d"]], {"v": 1.0})
    wanted = {r["k"]: r for r in dense.groupBy("k").agg(F.count("*").alias("cells"), F.sum("v").alias("total"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most")).collect()}
    assert set(got) == set(wanted) == {"a", "b", None}
    for k, w in wanted.items():
        assert all(got[k][c] == pytest.approx(w[c]) for c in ("cells", "total", "mean", "least", "most"))
    by_d = {r["d"]: (r["cells"], r["filled"], r["most"]) for r in joins.grid_summary(data, dims, "d", "v").collect()}
    assert by_d == {1: (3, 2, 5.0), 2: (3, 1, 0.0), 3: (3, 0, 0.0)}
    full = {"k": dims["k"].limit(1), "d": dims["d"].filter("d < 3")}
    assert joins.grid_summary(data.filter("k = 'a'"), full, "k", "v").first()["least"] == -1.0
