import pytest
from pyspark.sql import functions as F

from locigrid.operators import scoring


def test_cells_and_undefined_metrics(spark):
    df = spark.createDataFrame(
        [("a", True, True), ("a", True, False), ("a", False, True), ("a", False, False), ("a", False, False), ("b", False, False)],
        "g string, actual boolean, predicted boolean",
    )
    cells = scoring.confusion(df, ["g"], F.col("actual"), F.col("predicted"))
    total = sum(F.col(c) for c in scoring.CELLS)
    assert cells.agg(F.sum(total)).first()[0] == df.count()
    out = {r["g"]: r for r in scoring.binary_metrics(cells).collect()}
    a, b = out["a"], out["b"]
    assert (a["true_positive"], a["false_negative"], a["false_positive"], a["true_negative"]) == (1, 1, 1, 2)
    assert a["accuracy"] == pytest.approx(0.6) and a["precision"] == 0.5 and a["F1"] == pytest.approx(0.5)
    assert a["F0_5"] == pytest.approx(1.25 * 0.25 / (0.125 + 0.5))
    assert b["specificity"] == 1.0
    assert b["sensitivity"] is b["precision"] is b["F1"] is b["F0_5"] is None
    means = scoring.mean_metrics(scoring.metrics_long(scoring.binary_metrics(cells), ["g"]), [])
    found = {r["metric"]: r["value"] for r in means.collect()}
    assert found["sensitivity"] == 0.5 and found["accuracy"] == pytest.approx(0.8)


def test_assignment_metrics(spark):
    df = spark.createDataFrame(
        [("x", "a", "a"), ("x", "a", "b"), ("x", "a", None), ("x", "b", "b"), ("y", "a", None)], "s string, t string, p string"
    ).withColumn("measure", scoring.assignment_outcome(F.col("t"), F.col("p")))
    out = {r["s"]: r for r in scoring.assignment_metrics(df, ["s"]).collect()}
    x, y = out["x"], out["y"]
    assert (x["correct"], x["incorrect"], x["unassigned"]) == (2, 1, 1)
    assert x["precision"] == pytest.approx(2 / 3) and x["recall"] == pytest.approx(2 / 3) and x["recall_compat"] == 0.5
    assert y["precision"] is None and y["recall"] == 0.0


def test_truth_and_contamination_rows(spark, rows):
    table = spark.createDataFrame(
        [("m", 0, "a_contig_1", "a"), ("m", 0, "contamination_b_contig_2", "a"), ("m", 0, "b_contig_3", "b")],
        "sample string, benchmark int, contig string, bin string",
    )
    truth = scoring.bin_truth(table).select("sample", "contig", "bin_truth")
    assert rows(truth, "contig", "bin_truth") == [("a_contig_1", "a"), ("b_contig_2", "b"), ("b_contig_3", "b")]
    predicted = spark.createDataFrame(
        [("m", 0, "contamination_b_contig_2", "a"), ("m", 0, "contamination_b_contig_2", "a"), ("m", 0, "b_contig_3", "b")],
        table.schema,
    )
    out = scoring.score_contamination(table, predicted, truth)
    assert rows(out, "contig", "measure") == [
        ("a_contig_1", "true negative"), ("b_contig_2", "true positive"), ("b_contig_3", "false positive"),
    ]


SIZES = "bin string, method string, cluster long, n_contigs long, cluster_length long"


def test_home_clusters_and_consensus(spark, rows):
    sizes = spark.createDataFrame([("a", "k", 1, 2, 10), ("a", "k", 2, 1, 10), ("a", "g", 1, 3, 20), ("b", "k", 3, 1, 5)], SIZES)
    homes = scoring.home_cluster(sizes)
    assert rows(homes, "bin", "method", "bin_cluster") == [("a", "g", 1), ("a", "k", 1), ("a", "k", 2), ("b", "k", 3)]
    homes = homes.filter("NOT (method = 'k' AND bin_cluster = 2)")
    results = spark.createDataFrame(
        [("c1", "a", "k", 1), ("c1", "a", "g", 1), ("c2", "a", "k", 9), ("c2", "a", "g", -1), ("c3", "a", "k", 9), ("c3", "a", "g", 1)],
        "contig string, bin string, method string, cluster long",
    )
    assert rows(scoring.flag_foreign(results, homes, 2)) == [("c2", 2)]
    assert rows(scoring.flag_foreign(results, homes, 1)) == [("c3", 1)]
    assert rows(scoring.flag_foreign(results, homes, 1, at_least=True), "contig") == [("c2",), ("c3",)]


def test_unique_assignment_needs_all_methods(spark):
    homes = spark.createDataFrame(
        [("a", "k", 1), ("b", "k", 2), ("a", "g", 1), ("b", "g", 1)], "bin string, method string, bin_cluster long"
    )
    results = spark.createDataFrame(
        [("u", "unbinned", "k", 1), ("u", "unbinned", "g", 1), ("v", "unbinned", "k", 2), ("w", "a", "k", 1)],
        "contig string, bin string, method string, cluster long",
    )
    out = scoring.assign_unbinned(results, homes, 2)
    assert out.filter("contig = 'u'").count() == 3 and out.filter("assignment_is_unique").count() == 0
    out = scoring.assign_unbinned(results, homes, 1)
    assert {r["contig"] for r in out.filter("assignment_is_unique").collect()} == {"u", "v"}


def test_tiers(spark, rows):
    votes = [
        ("high", "svm", "a", 0.9), ("high", "knn", "a", 1.0), ("high", "rf", "a", 0.8), ("high", "lda", "z", 1.0),
        ("medium", "svm", "a", 0.75), ("medium", "knn", "a", 0.75), ("medium", "rf", "a", 0.75),
        ("low", "svm", "a", 0.4), ("low", "knn", "b", 1.0), ("low", "rf", "a", 0.6),
        ("none", "svm", "a", 1.0), ("none", "knn", "b", 1.0), ("none", "rf", "c", 1.0),
    ]
    df = spark.createDataFrame(votes, "contig string, method string, assigned_bin string, prob double")
    out = scoring.confidence_tiers(df)
    assert rows(out.select("contig", "assigned_bin", "confidence").distinct()) == [
        ("high", "a", "high_confidence"), ("low", "a", "low_confidence"), ("medium", "a", "medium_confidence"),
    ]
    assert out.count() == 8
    assert out.filter("contig = 'low'").agg(F.max("mean_prob")).first()[0] == pytest.approx(0.5)
    old = spark.createDataFrame([("x", "q")], "contig string, bin string")
    assert rows(scoring.apply_assignments(old, out)) == [("high", "a", True), ("x", "q", False)]


def test_soft_vote_and_contrast(spark, rows):
    p = spark.createDataFrame(
        [("c", "lda", "a", 0.5), ("c", "lda", "b", 0.5), ("c", "knn", "b", 1.0), ("c", "rf", "a", 0.4), ("c", "rf", "c", 0.6), ("d", "rf", "y", 0.5), ("d", "rf", "x", 0.5)],
        "contig string, method string, class string, prob double",
    )
    assert rows(scoring.soft_vote(p), "contig", "classification") == [("c", "b"), ("d", "x")]
    m = spark.createDataFrame(
        [("a", "m1", 0.9), ("a", "m1", 0.0), ("a", "m2", 0.1), ("a", "m3", 0.12), ("a", "m4", 0.2), ("b", "m2", 0.3)],
        "bin string, motif string, mean double",
    )
    out = scoring.contrast_features(m, ["bin"], "motif", "mean", 0.25, 0.15, 1)
    assert rows(out, "bin", "motif", "side") == [("a", "m1", "high"), ("a", "m3", "low"), ("b", "m2", "high")]
