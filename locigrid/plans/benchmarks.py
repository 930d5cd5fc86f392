"""Whole benchmark reports: replicates, predictions, confusion cells, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locigrid.functions.text import cell_label
from locigrid.operators import joins, scoring, shape
from locigrid.operators.aggregate import with_group_stats
from locigrid.plans.catalog import query
from locigrid.plans.replicates import MOVES, REMOVED, REPLICATES, _moves, eligible
from locigrid.plans.standins import (
    CONTIG_BIN,
    SCORED,
    contig_bin,
    hash_share,
    hash_share_sql,
    r6,
    scored,
    table,
)
from locigrid.session import cut_lineage


def _div(top: str, bottom: str) -> str:
    return f"CAST({top} AS DOUBLE) / nullif({bottom}, 0)"


# Metrics of tp, fn, fp, tn as SQL; undefined ones are NULL.
METRICS_SQL = f"""m0 AS (SELECT *, {_div("tp + tn", "tp + tn + fp + fn")} AS accuracy, {_div("tp", "tp + fn")} AS sensitivity,
    {_div("tn", "tn + fp")} AS specificity, {_div("tp", "tp + fp")} AS precision FROM cells),
  metrics AS (SELECT *, 2 * precision * sensitivity / nullif(precision + sensitivity, 0) AS f1,
    1.25 * precision * sensitivity / nullif(0.25 * precision + sensitivity, 0) AS f05 FROM m0)"""
CELL_SUMS = """CAST(sum(CASE WHEN actual AND predicted THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN actual AND NOT predicted THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN NOT actual AND predicted THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN NOT actual AND NOT predicted THEN 1 ELSE 0 END) AS BIGINT) AS tn"""


@query(
    "A12 A13 J02 P07 S01",
    f"""WITH d AS (SELECT source, lang, quality = 0 AS actual, n_chars < 400 AS predicted FROM documents JOIN labels USING (doc_id)),
          cells AS (SELECT source, lang, {CELL_SUMS} FROM d GROUP BY 1, 2), {METRICS_SQL}
        SELECT source, lang, tp AS true_positive, fn AS false_negative, fp AS false_positive, tn AS true_negative, round(accuracy, 6) AS accuracy,
          round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(precision, 6) AS precision, round(f1, 6) AS "F1", round(f05, 6) AS "F0_5" FROM metrics""",
)
def contamination_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual against predicted flags: confusion cells and metrics per group."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    cells = scoring.confusion(rows, ["source", "lang"], F.col("quality") == 0, F.col("n_chars") < 400)
    names = ["accuracy", "sensitivity", "specificity", "precision", "F1", "F0_5"]
    return scoring.binary_metrics(cells).withColumns({c: r6(F.col(c)) for c in names})


@query(
    "A12 J04 A28",
    """WITH t(actual, predicted, measure) AS (VALUES ('contamination', 'contamination', 'true positive'), ('contamination', 'not contamination', 'false negative'),
         ('not contamination', 'contamination', 'false positive'), ('not contamination', 'not contamination', 'true negative')),
         d AS (SELECT CASE WHEN quality = 0 THEN 'contamination' ELSE 'not contamination' END AS actual, CASE WHEN n_chars < 30 THEN 'contamination' ELSE 'not contamination' END AS predicted
           FROM documents JOIN labels USING (doc_id))
       SELECT t.actual, t.predicted, measure, count(d.actual) AS count, measure || ' (' || count(d.actual) || ')' AS count_label
       FROM t LEFT JOIN d ON d.actual = t.actual AND d.predicted = t.predicted GROUP BY 1, 2, 3""",
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four cells as a labelled table; unseen ones are shown as 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    named = rows.select(scoring.measure(F.col("quality") == 0, F.col("n_chars") < 30).alias("measure"))
    # What each cell means.
    cells = [
        ("contamination", "contamination", "true positive"),
        ("contamination", "not contamination", "false negative"),
        ("not contamination", "contamination", "false positive"),
        ("not contamination", "not contamination", "true negative"),
    ]
    template = spark.createDataFrame(cells, "actual string, predicted string, measure string")
    counts = named.groupBy("measure").agg(F.count("*").alias("count"))
    out = joins.complete_to(counts, template, ["measure"], {"count": 0})
    label = F.concat("measure", F.lit(" ("), F.col("count").cast("string"), F.lit(")"))
    return out.withColumn("count_label", label)


@query(
    "C17 A12 P07",
    """WITH c AS (SELECT doc_id, CASE WHEN quality = 0 AND n_chars < 400 THEN 'true positive' WHEN quality = 0 THEN 'false negative'
           WHEN n_chars < 400 THEN 'false positive' ELSE 'true negative' END AS cell FROM documents JOIN labels USING (doc_id)),
         k(cell, colour) AS (VALUES ('true positive', 'red'), ('false negative', 'orange'), ('false positive', 'blue'), ('true negative', 'green'))
       SELECT doc_id, '<span style=' || chr(39) || 'color:' || colour || chr(39) || '>' || doc_id || ' - ' || cell || '</span>' AS label
       FROM c JOIN k USING (cell)""",
)
def confusion_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row labels coloured by their confusion cell."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    cell = scoring.measure(F.col("quality") == 0, F.col("n_chars") < 400)
    return rows.select("doc_id", cell_label(F.col("doc_id").cast("string"), cell).alias("label"))


# A detector that finds most moved contigs and a few others, by hash.
def _predictions(replicates: DataFrame) -> DataFrame:
    moved = F.col("contig").contains("contamination_")
    key = F.concat_ws("|", F.lit("detect"), F.col("benchmark").cast("string"), "contig", "bin")
    share = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return replicates.filter(share < F.when(moved, 0.8).otherwise(0.01))


PREDICTED = f"""{MOVES}, rep AS (SELECT benchmark, contig, bin, false AS moved FROM contigs, reps WHERE (benchmark, contig) NOT IN (SELECT (benchmark, contig) FROM moves)
    UNION ALL SELECT benchmark, contig, bin, true FROM moves),
  scoredrows AS (SELECT *, moved AS actual, CAST(CAST('0x' || substr(md5('detect|' || benchmark || '|' || CASE WHEN moved THEN 'contamination_' ELSE '' END || contig || '|' || bin), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296
     < CASE WHEN moved THEN 0.8 ELSE 0.01 END AS predicted FROM rep)"""


def _scored_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The replicate tables are written once and read by the detector and the score.
    replicates = cut_lineage(_moves(spark, sf_dir)[0].withColumn("sample", F.lit("mock")))
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("contig"), F.col("c_nationkey").cast("string").alias("bin_truth")
    )
    truth = customer.withColumn("sample", F.lit("mock"))
    return scoring.score_contamination(replicates, _predictions(replicates), truth)


@query(
    "R04 A12 A13 J01 U05 W01",
    f"""WITH {PREDICTED}, cells AS (SELECT benchmark, {CELL_SUMS} FROM scoredrows GROUP BY 1), {METRICS_SQL}
        SELECT benchmark, tp AS true_positive, fn AS false_negative, fp AS false_positive, tn AS true_negative, round(accuracy, 6) AS accuracy,
          round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(precision, 6) AS precision, round(f1, 6) AS "F1", round(f05, 6) AS "F0_5" FROM metrics""",
)
def contamination_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign contigs injected, detected and scored, all replicates in one job."""
    rows = _scored_replicates(spark, sf_dir)
    cells = scoring.confusion(rows, ["benchmark"], F.col("actual"), F.col("predicted"))
    names = ["accuracy", "sensitivity", "specificity", "precision", "F1", "F0_5"]
    return scoring.binary_metrics(cells).withColumns({c: r6(F.col(c)) for c in names})


@query(
    "A11 A03 A28 C13 P09",
    f"""WITH {PREDICTED}, cells AS (SELECT benchmark, {CELL_SUMS} FROM scoredrows GROUP BY 1), {METRICS_SQL},
          l AS (SELECT 'sensitivity' AS metric, round(sensitivity, 9) AS v FROM metrics UNION ALL SELECT 'specificity', round(specificity, 9) FROM metrics UNION ALL SELECT 'precision', round(precision, 9) FROM metrics
            UNION ALL SELECT 'accuracy', round(accuracy, 9) FROM metrics UNION ALL SELECT 'F1', round(f1, 9) FROM metrics)
        SELECT metric, round(avg(v), 6) AS value FROM l GROUP BY 1""",
)
def mean_metrics_over_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics in long form, averaged over replicates."""
    rows = _scored_replicates(spark, sf_dir)
    cells = scoring.confusion(rows, ["benchmark"], F.col("actual"), F.col("predicted"))
    long = scoring.metrics_long(scoring.binary_metrics(cells), ["benchmark"])
    long = long.withColumn("value", F.round("value", 9))
    return scoring.mean_metrics(long, []).select("metric", r6(F.col("value")).alias("value"))


@query(
    "M27 J06 A13 U01 P18 P11",
    f"""WITH {PREDICTED}, sr AS (SELECT scoredrows.*, CAST(c_nationkey AS VARCHAR) AS bin_truth FROM scoredrows JOIN customer ON CAST(c_custkey AS VARCHAR) = contig),
          g AS (SELECT * FROM (SELECT DISTINCT bin FROM contigs), reps),
          cells AS (SELECT g.bin, g.benchmark, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, coalesce(fp, 0) AS fp, coalesce(tn, 0) AS tn FROM g LEFT JOIN
             (SELECT bin_truth AS bin, benchmark, {CELL_SUMS} FROM sr GROUP BY 1, 2) USING (bin, benchmark)), {METRICS_SQL},
          l AS (SELECT bin, 'sensitivity' AS x_axis, sensitivity AS v FROM metrics UNION ALL SELECT bin, 'specificity', specificity FROM metrics UNION ALL SELECT bin, 'precision', precision FROM metrics
            UNION ALL SELECT bin, 'accuracy', accuracy FROM metrics UNION ALL SELECT bin, 'F1', f1 FROM metrics),
          {SCORED}, {CONTIG_BIN}, s AS (SELECT bin, motif, round(sum(median), 2) / count(*) AS m FROM scored JOIN contig_bin USING (contig) WHERE mean_read_cov >= 3 GROUP BY 1, 2),
          k AS (SELECT DISTINCT motif FROM s WHERE m > 0.5), sg AS (SELECT * FROM (SELECT DISTINCT bin FROM s), k)
        SELECT bin, x_axis, round(avg(round(v, 9)), 6) AS value, CAST(NULL AS VARCHAR) AS label, 'metric' AS "group" FROM l WHERE v IS NOT NULL GROUP BY 1, 2
        UNION ALL SELECT bin, motif, round(coalesce(m, 0), 9), CASE WHEN m IS NULL THEN '·' END, 'methylation' FROM sg LEFT JOIN s USING (bin, motif)""",
)
def benchmark_heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature means and metric means per bin, stacked in one long table."""
    rows = _scored_replicates(spark, sf_dir)
    per_bin = rows.withColumn("bin", F.col("bin_truth"))
    counts = scoring.confusion(per_bin, ["bin", "benchmark"], F.col("actual"), F.col("predicted"))
    bins = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("bin"))
    numbers = spark.range(REPLICATES).select(F.col("id").cast("int").alias("benchmark"))
    cells = joins.densify(counts, [bins, numbers], {c: 0 for c in scoring.CELLS})
    long = scoring.metrics_long(scoring.binary_metrics(cells), ["bin"])
    long = shape.present(long, "value").withColumn("value", F.round("value", 9))
    metrics = long.groupBy("bin", F.col("metric").alias("x_axis")).agg(r6(F.avg("value")).alias("value"))

    scores = scored(spark, sf_dir).filter("mean_read_cov >= 3").join(contig_bin(spark, sf_dir), "contig")
    means = scores.groupBy("bin", F.col("motif").alias("x_axis")).agg(
        (F.round(F.sum("median"), 2) / F.count("*")).alias("m")
    )
    kept = means.filter("m > 0.5").select("x_axis").distinct()
    grid = joins.densify(joins.semi(means, kept, ["x_axis"]), [means.select("bin"), kept], {})
    methylation = grid.select(
        "bin", "x_axis", F.round(F.coalesce("m", F.lit(0.0)), 9).alias("value"), F.when(F.col("m").isNull(), "·").alias("label")
    )
    return scoring.stack_grid(methylation, metrics)


# An assigner that is right most of the time and silent now and then, by hash.
OUTCOME = f"""{REMOVED}, o AS (SELECT benchmark, contig, bin AS bin_truth, {hash_share_sql("assign", "benchmark || '|' || contig")} AS h FROM removed),
  a AS (SELECT *, CASE WHEN h < 0.7 THEN bin_truth WHEN h < 0.85 THEN '0' END AS assigned_bin FROM o),
  ms AS (SELECT *, CASE WHEN bin_truth = assigned_bin THEN 'correct' WHEN bin_truth <> assigned_bin THEN 'incorrect' ELSE 'unassigned' END AS measure FROM a)"""


@query(
    "A14 R03 J01 P07",
    f"""WITH {OUTCOME}, c AS (SELECT benchmark, count(*) FILTER (measure = 'correct') AS correct, count(*) FILTER (measure = 'incorrect') AS incorrect, count(*) FILTER (measure = 'unassigned') AS unassigned FROM ms GROUP BY 1)
        SELECT *, round({_div("incorrect", "correct + incorrect")}, 6) AS misclassification_rate, round({_div("correct", "correct + incorrect")}, 6) AS precision,
          round({_div("correct", "correct + unassigned")}, 6) AS recall, round({_div("correct", "correct + unassigned + unassigned")}, 6) AS recall_compat FROM c""",
)
def inclusion_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs held out, assigned again and scored, all replicates in one job."""
    from locigrid.operators.sampling import holdout_one, with_replicates

    pairs = contig_bin(spark, sf_dir)
    kept, _ = holdout_one(pairs, eligible(spark, sf_dir), REPLICATES)
    truth = with_replicates(pairs.withColumnRenamed("bin", "bin_truth"), REPLICATES)
    unbinned = joins.natural_left(truth, kept).filter("bin IS NULL").drop("bin")
    key = F.concat_ws("|", F.col("benchmark").cast("string"), "contig")
    h = hash_share("assign", "__k")
    assigned = F.when(h < 0.7, F.col("bin_truth")).when(h < 0.85, "0")
    rows = unbinned.withColumn("__k", key).withColumn("assigned_bin", assigned)
    rows = rows.withColumn("measure", scoring.assignment_outcome(F.col("bin_truth"), F.col("assigned_bin")))
    out = scoring.assignment_metrics(rows, ["benchmark"])
    names = ["misclassification_rate", "precision", "recall", "recall_compat"]
    return out.withColumns({c: r6(F.col(c)) for c in names})


@query(
    "C01 C02 W01 R04",
    f"""WITH {MOVES}, rep AS (SELECT benchmark, 'nat_' || bin || '_contig_' || contig AS contig, 'nat_' || bin AS bin FROM contigs, reps WHERE (benchmark, contig) NOT IN (SELECT (benchmark, contig) FROM moves)
          UNION ALL SELECT benchmark, 'nat_' || donor || '_contig_' || contig, 'nat_' || bin FROM moves)
        SELECT benchmark, contig, bin, regexp_replace(contig, '_contig.*', '') AS bin_truth FROM rep""",
)
def truth_from_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True bin of each contig read off its name."""
    customer = table(spark, sf_dir, "customer")
    owner = F.concat(F.lit("nat_"), F.col("c_nationkey").cast("string"))
    names = customer.select(
        F.col("c_custkey").cast("string").alias("key"),
        owner.alias("owner"),
        F.concat(owner, F.lit("_contig_"), F.col("c_custkey").cast("string")).alias("name"),
    )
    rows = _moves(spark, sf_dir)[0]
    moved = F.col("contig").contains("contamination_")
    rows = rows.withColumns({"moved": moved, "key": F.regexp_replace("contig", "contamination_", "")})
    rows = rows.join(names, "key").select(
        "benchmark",
        F.concat(F.when(F.col("moved"), "contamination_").otherwise(""), "name").alias("contig"),
        F.when(F.col("moved"), F.concat(F.lit("nat_"), F.col("bin"))).otherwise(F.col("owner")).alias("bin"),
    )
    return scoring.bin_truth(rows)


@query(
    "W05 A16 P12 N02 U06",
    """WITH q AS (SELECT c_nationkey AS sample, c_custkey AS bin, 'before' AS decon, CASE WHEN c_acctbal / 100 >= 90 THEN 'HQ' WHEN c_acctbal / 100 >= 50 THEN 'MQ' ELSE 'LQ' END AS tier FROM customer
         UNION ALL SELECT c_nationkey, o_custkey, 'after', CASE WHEN o_totalprice / 5000 >= 90 THEN 'HQ' WHEN o_totalprice / 5000 >= 50 THEN 'MQ' ELSE 'LQ' END FROM
           (SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey),
       both_ AS (SELECT sample, bin, count(DISTINCT tier) AS t FROM q GROUP BY 1, 2 HAVING count(DISTINCT decon) = 2)
       SELECT sample, count(*) FILTER (t = 2) AS changed, count(*) AS bins FROM both_ GROUP BY 1""",
)
def changed_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins whose quality tier differs before and after, per sample."""
    from locigrid.functions.numeric import quality_tier
    from locigrid.operators.aggregate import groups_with_n_distinct

    customer = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("price"))
    before = customer.select(
        F.col("c_nationkey").alias("sample"), F.col("c_custkey").alias("bin"), F.lit("before").alias("decon"),
        quality_tier(F.col("c_acctbal") / 100, F.lit(0)).alias("tier"),
    )
    after = best.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("sample"), F.col("c_custkey").alias("bin"), F.lit("after").alias("decon"),
        quality_tier(F.col("price") / 5000, F.lit(0)).alias("tier"),
    )
    rows = groups_with_n_distinct(shape.union_strict(before, after), ["sample", "bin"], "decon", 2)
    tiers = rows.groupBy("sample", "bin").agg(F.count_distinct("tier").alias("t"))
    return tiers.groupBy("sample").agg(F.count_if(F.col("t") == 2).alias("changed"), F.count("*").alias("bins"))


@query(
    "W03 A11 J01 C01 P06",
    """WITH s AS (SELECT user_id, event_type, round(sum(value), 2) AS score FROM events GROUP BY 1, 2)
       SELECT user_id, event_type AS mge, score FROM (SELECT *, max(score) OVER (PARTITION BY user_id) AS m FROM s) WHERE score = m""",
)
def best_class_of_wide_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide score columns turned long, the top class kept, its suffix removed."""
    from locigrid.functions.text import remove_first

    long = table(spark, sf_dir, "events").withColumn("name", F.concat("event_type", F.lit("_score")))
    # The event types of the table.
    names = [f"{t}_score" for t in ("click", "error", "purchase", "signup", "view")]
    sums = long.groupBy("user_id", "name").agg(F.round(F.sum("value"), 2).alias("score"))
    wide = shape.pivot_wide(sums, ["user_id"], "name", "score", names)
    back = shape.present(shape.unpivot(wide, ["user_id"], names, "mge", "score"), "score")
    top = with_group_stats(back, ["user_id"], best=F.max("score")).filter("score = best").drop("best")
    return top.withColumn("mge", remove_first(F.col("mge"), "_score"))
