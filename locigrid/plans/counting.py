"""Group aggregates, shares, distributions, pivots and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locigrid.operators import aggregate as agg
from locigrid.operators import features, scoring, shape
from locigrid.plans.catalog import query
from locigrid.plans.standins import (
    CONTIG_BIN,
    SCORED,
    contig_bin,
    embeddings,
    exact_mean,
    exact_mean_sql,
    hash_share,
    hash_share_sql,
    minute,
    r6,
    scored,
    table,
    text_of,
)


@query(
    "A01 A02 A03 A04",
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS total,
         {exact_mean_sql("l_extendedprice")} AS mean, max(l_discount) AS top FROM lineitem GROUP BY 1, 2""",
)
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, sum, mean and maximum in one pass."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_quantity"), 4).alias("total"),
        exact_mean("l_extendedprice").alias("mean"),
        F.max("l_discount").alias("top"),
    )


@query(
    "A05",
    "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1",
)
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_returnflag").alias("flags")
    )


@query(
    "A06 A16",
    """SELECT o_orderpriority, median(n) AS median FROM (SELECT o_orderpriority, o_custkey, count(*) AS n
         FROM orders GROUP BY 1, 2) GROUP BY 1""",
)
def median_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median over groups of the rows per subgroup."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"))
    return agg.exact_quantiles(counts, ["o_orderpriority"], "n", {"median": 0.5})


@query(
    "A07",
    f"SELECT l_suppkey, {exact_mean_sql('l_quantity')} AS mean, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY 1",
)
def mean_and_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        exact_mean("l_quantity").alias("mean"), r6(F.stddev_samp("l_quantity")).alias("sd")
    )


@query(
    "A08",
    "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 10)",
)
def groups_of_exact_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.groups_with_n(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 10)


@query("A09", "SELECT DISTINCT user_id, event_type FROM events")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type").distinct()


@query(
    "A10",
    """SELECT user_id, coalesce(max(CASE WHEN event_type = 'click' THEN v END), 0) AS click,
         coalesce(max(CASE WHEN event_type = 'error' THEN v END), 0) AS error,
         coalesce(max(CASE WHEN event_type = 'purchase' THEN v END), 0) AS purchase,
         coalesce(max(CASE WHEN event_type = 'signup' THEN v END), 0) AS signup,
         coalesce(max(CASE WHEN event_type = 'view' THEN v END), 0) AS view
       FROM (SELECT user_id, event_type, round(sum(value), 4) AS v FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long to wide with an explicit name list, missing cells 0."""
    long = table(spark, sf_dir, "events").groupBy("user_id", "event_type")
    long = long.agg(F.round(F.sum("value"), 4).alias("v"))
    return shape.pivot_wide(long, ["user_id"], "event_type", "v", ["click", "error", "purchase", "signup", "view"], 0)


@query(
    "A11",
    """SELECT doc_id, 'quality' AS metric, quality AS value FROM labels
       UNION ALL SELECT doc_id, 'toxic', toxic FROM labels""",
)
def unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.unpivot(table(spark, sf_dir, "labels"), ["doc_id"], ["quality", "toxic"], "metric", "value")


@query(
    "A15 A02",
    f"""WITH {SCORED}, {CONTIG_BIN}, r AS (SELECT bin, contig, motif, CAST(sum(n_motif_obs) AS BIGINT) AS n FROM scored
          JOIN contig_bin USING (contig) GROUP BY 1, 2, 3)
        SELECT bin, contig, motif, n, round(n / sum(n) OVER (PARTITION BY bin, motif), 6) AS obs_percentage FROM r""",
)
def group_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of a contig over those of its bin, per motif."""
    rows = scored(spark, sf_dir).select("contig", "motif", "n_motif_obs").join(contig_bin(spark, sf_dir), "contig")
    counts = rows.groupBy("bin", "contig", "motif").agg(F.sum("n_motif_obs").alias("n"))
    shares = agg.share_of_group(counts, ["bin", "motif"], "n", "obs_percentage")
    return shares.withColumn("obs_percentage", r6(F.col("obs_percentage")))


@query(
    "A16 A05",
    """SELECT r_name, count(DISTINCT s_nationkey) AS bins FROM (SELECT s_nationkey, count(DISTINCT CAST(floor(s_acctbal / 5000) AS BIGINT)) AS tiers
         FROM supplier GROUP BY 1) JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE tiers >= 2 GROUP BY 1""",
)
def two_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins that hold several tiers, counted per region."""
    tiers = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(
        F.count_distinct(F.floor(F.col("s_acctbal") / 5000)).alias("tiers")
    )
    nation = table(spark, sf_dir, "nation").selectExpr("n_nationkey s_nationkey", "n_regionkey r_regionkey")
    region = table(spark, sf_dir, "region")
    rows = tiers.filter("tiers >= 2").join(nation, "s_nationkey").join(region, "r_regionkey")
    return rows.groupBy("r_name").agg(F.count_distinct("s_nationkey").alias("bins"))


@query(
    "A17",
    """WITH b AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
           quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1, 2)
       SELECT l_returnflag, l_linestatus, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
         min(CASE WHEN l_extendedprice >= q1 - 1.5 * (q3 - q1) THEN l_extendedprice END) AS whisker_low,
         max(CASE WHEN l_extendedprice <= q3 + 1.5 * (q3 - q1) THEN l_extendedprice END) AS whisker_high
       FROM lineitem JOIN b USING (l_returnflag, l_linestatus) GROUP BY 1, 2, 3, 4, 5""",
)
def box_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles and whiskers of a few very large groups."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    box = agg.boxplot_stats(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return box.withColumns({c: r6(F.col(c)) for c in ("q1", "median", "q3")})


@query(
    "A18",
    "SELECT CAST(ceil((value - 5) / 10) * 10 AS DOUBLE) AS centre, count(*) AS n FROM events GROUP BY 1",
)
def fixed_width_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right-closed bins centred on multiples of ten."""
    return agg.histogram(table(spark, sf_dir, "events"), "value", 10.0)


@query(
    "A19",
    f"""SELECT method, CAST(sum(c) AS BIGINT) AS n_correct, count(c) AS n_total, round(CAST(sum(c) AS DOUBLE) / count(c), 6) AS accuracy FROM (
          SELECT 'a' AS method, CAST(quality = CASE WHEN {hash_share_sql("a", "doc_id")} < 0.7 THEN 1 ELSE 0 END AS INTEGER) AS c FROM labels UNION ALL
          SELECT 'b', CAST(quality = CASE WHEN {hash_share_sql("b", "doc_id")} < 0.9 THEN 1 ELSE 0 END AS INTEGER) FROM labels) GROUP BY 1""",
)
def method_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correct rows over rows per method."""
    rows = table(spark, sf_dir, "labels")
    parts = [
        rows.select(F.lit(m).alias("method"), "quality", (hash_share(m, "doc_id") < t).cast("int").alias("p"))
        for m, t in (("a", 0.7), ("b", 0.9))
    ]
    both = shape.union_strict(*parts)
    out = agg.accuracy_by(both, ["method"], F.col("quality") == F.col("p"))
    return out.withColumn("accuracy", r6(F.col("accuracy")))


_SPOT = "CAST(floor(epoch(ts) / 60) AS BIGINT) - 28401120"


@query(
    "A22",
    f"""SELECT CAST(user_id AS VARCHAR) AS contig, ({_SPOT}) // 360 AS pos, '+' AS strand, event_type AS mod_type, count(*) AS coverage,
          CAST(sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) AS BIGINT) AS n_mod,
          round(CAST(sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS fraction FROM events GROUP BY 1, 2, 3, 4""",
)
def modified_base_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, modified count and fraction per position, strand and code."""
    return agg.mod_pileup(calls(spark, sf_dir)).withColumn("fraction", r6(F.col("fraction")))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modified-base calls: one per event, six hours of a user as a position."""
    return table(spark, sf_dir, "events").select(
        text_of("user_id").alias("contig"),
        F.floor(minute() / 360).alias("pos"),
        F.lit("+").alias("strand"),
        F.col("event_type").alias("mod_type"),
        (F.col("value") > 30).alias("is_mod"),
    )


@query(
    "A23 J12",
    f"""WITH p AS (SELECT CAST(user_id AS VARCHAR) AS contig, ({_SPOT}) // 360 AS pos, event_type AS mod_type, count(*) AS coverage,
            CAST(sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS fraction FROM events GROUP BY 1, 2, 3)
        SELECT contig, CASE WHEN pos % 2 = 0 THEN 'GATC' ELSE 'CCWGG' END AS motif, mod_type, CAST(pos % 2 AS INTEGER) AS mod_position,
          round(avg(coverage), 6) AS mean_read_cov, count(*) AS n_motif_obs, round(median(fraction), 6) AS median FROM p WHERE coverage >= 2 GROUP BY 1, 2, 3, 4""",
)
def motif_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median fraction, mean coverage and positions per contig and motif."""
    pileup = agg.mod_pileup(calls(spark, sf_dir))
    odd = F.pmod("pos", F.lit(2))
    joined = pileup.withColumns(
        {"motif": F.when(odd == 0, "GATC").otherwise("CCWGG"), "mod_position": odd.cast("int")}
    )
    out = agg.score_motifs(joined, 2)
    return out.withColumns({c: r6(F.col(c)) for c in ("mean_read_cov", "median")})


@query(
    "A28",
    """SELECT n_name, 'N bins: ' || count(DISTINCT s_nationkey) || chr(10) || 'N contaminants: ' || count(*) AS label
       FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""",
)
def count_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as a two-line label per group."""
    nation = table(spark, sf_dir, "nation").selectExpr("n_nationkey s_nationkey", "n_name")
    rows = table(spark, sf_dir, "supplier").join(nation, "s_nationkey")
    return agg.label_counts(
        rows, ["n_name"], {"N bins": F.count_distinct("s_nationkey"), "N contaminants": F.count("*")}
    )


@query(
    "A29",
    """SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, max(n) <= 1 AS is_unique
       FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""",
)
def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.uniqueness(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("A29", "SELECT o_orderkey FROM orders")
def unique_key_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows pass when their key is unique."""
    return agg.assert_unique(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


LENGTHS = "lengths AS (SELECT CAST(l_suppkey AS VARCHAR) AS contig, count(*) AS length FROM lineitem GROUP BY 1)"


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of a contig: its number of line items."""
    return table(spark, sf_dir, "lineitem").groupBy(text_of("l_suppkey").alias("contig")).agg(F.count("*").alias("length"))


@query(
    "A26",
    f"""WITH {CONTIG_BIN}, {LENGTHS} SELECT bin, CAST(sum(length) AS BIGINT) AS bin_length, count(*) AS n_contigs_bin
        FROM contig_bin JOIN lengths USING (contig) WHERE bin <> '7' GROUP BY 1""",
)
def bin_size_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and contigs per bin, without one bin."""
    return agg.bin_sizes(contig_bin(spark, sf_dir), lengths(spark, sf_dir), drop="7")


METHODS = ("kmeans", "gmm", "agg", "dscan")
# Cluster labels that stand in for model output: the bin, or another one by hash.
LABELS = "labels_long AS (" + " UNION ALL ".join(
    f"""SELECT CAST(s_suppkey AS VARCHAR) AS contig, CAST(s_nationkey AS VARCHAR) AS bin, '{m}' AS method,
          CASE WHEN {hash_share_sql(m, "s_suppkey")} < 0.7 THEN CAST(s_nationkey AS BIGINT)
               ELSE CAST(floor({hash_share_sql("c" + m, "s_suppkey")} * 25) AS BIGINT) END AS cluster FROM supplier"""
    for m in METHODS
) + ")"


def method_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    parts = [
        supplier.select(
            text_of("s_suppkey").alias("contig"),
            text_of("s_nationkey").alias("bin"),
            F.lit(m).alias("method"),
            F.when(hash_share(m, "s_suppkey") < 0.7, F.col("s_nationkey").cast("long"))
            .otherwise(F.floor(hash_share("c" + m, "s_suppkey") * 25))
            .alias("cluster"),
        )
        for m in METHODS
    ]
    return shape.union_strict(*parts)


SIZES = f"""{CONTIG_BIN}, {LENGTHS}, {LABELS},
  b AS (SELECT bin, CAST(sum(length) AS BIGINT) AS bin_length, count(*) AS n_contigs_bin FROM contig_bin JOIN lengths USING (contig) GROUP BY 1),
  sizes AS (SELECT bin, method, cluster, count(*) AS n_contigs, CAST(sum(length) AS BIGINT) AS cluster_length, bin_length, n_contigs_bin,
      round(CAST(count(*) AS DOUBLE) / n_contigs_bin, 6) AS fraction_contigs, round(CAST(sum(length) AS DOUBLE) / bin_length, 6) AS fraction_length
    FROM labels_long JOIN lengths USING (contig) JOIN b USING (bin) GROUP BY bin, method, cluster, bin_length, n_contigs_bin)"""


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lengths(spark, sf_dir)
    bins = agg.bin_sizes(contig_bin(spark, sf_dir), long)
    out = agg.cluster_sizes(method_labels(spark, sf_dir), long, bins)
    return out.withColumns({c: r6(F.col(c)) for c in ("fraction_contigs", "fraction_length")})


@query("A27 A26", f"WITH {SIZES} SELECT * FROM sizes")
def cluster_size_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs and bases of each bin in each cluster, per method."""
    return sizes(spark, sf_dir)


HOMES = f"""{SIZES}, homes AS (SELECT bin, method, cluster AS bin_cluster, bin_length, n_contigs_bin, fraction_contigs, fraction_length
  FROM (SELECT *, max(cluster_length) OVER (PARTITION BY bin, method) AS m FROM sizes) WHERE cluster_length = m)"""


@query("M12 J09", f"WITH {HOMES} SELECT * FROM homes")
def home_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per method and bin the cluster with most bases, ties kept."""
    return scoring.home_cluster(sizes(spark, sf_dir))


@query(
    "M13",
    f"""WITH {HOMES} SELECT contig, CAST(sum(CASE WHEN bin_cluster <> cluster THEN 1 ELSE 0 END) AS BIGINT) AS sum_predictions
        FROM labels_long JOIN homes USING (bin, method) GROUP BY 1 HAVING sum(CASE WHEN bin_cluster <> cluster THEN 1 ELSE 0 END) >= 2""",
)
def foreign_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs that several methods place outside the home cluster of their bin."""
    homes = scoring.home_cluster(sizes(spark, sf_dir))
    return scoring.flag_foreign(method_labels(spark, sf_dir), homes, 2, at_least=True)


# Every contig whose hash is low counts as unbinned.
_UNBINNED = f"{hash_share_sql('u', 'contig')} < 0.4"
_USED = "('kmeans', 'gmm', 'agg')"


@query(
    "M14 A08 P19",
    f"""WITH {HOMES}, r AS (SELECT contig, CASE WHEN {_UNBINNED} THEN 'unbinned' ELSE bin END AS bin, method, cluster FROM labels_long WHERE method IN {_USED}),
         j AS (SELECT r.*, h.bin AS assigned_bin FROM r JOIN homes h ON h.method = r.method AND h.bin_cluster = r.cluster WHERE r.bin = 'unbinned'),
         u AS (SELECT contig FROM (SELECT contig, method FROM j GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 1 HAVING count(*) = 3)
        SELECT cluster, method, contig, bin, assigned_bin, contig IN (SELECT contig FROM u) AS assignment_is_unique FROM j""",
)
def unbinned_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbinned contigs joined to bins by cluster, flagged when three methods
    each name exactly one bin."""
    labels = method_labels(spark, sf_dir).filter(F.col("method").isin("kmeans", "gmm", "agg"))
    free = hash_share("u", "contig") < 0.4
    labels = labels.withColumn("bin", F.when(free, "unbinned").otherwise(F.col("bin")))
    return scoring.assign_unbinned(labels, scoring.home_cluster(sizes(spark, sf_dir)))


VOTES = "votes AS (" + " UNION ALL ".join(
    f"""SELECT CAST(vec_id AS VARCHAR) AS contig, '{m}' AS method, 'bin_' || CAST(CASE WHEN {hash_share_sql("v" + m, "vec_id")} < 0.6 THEN label ELSE (label + {i}) % 10 END AS VARCHAR) AS assigned_bin,
          0.5::DOUBLE + {hash_share_sql("p" + m, "vec_id")} / 2 AS prob FROM embeddings"""
    for i, m in enumerate(("svm", "knn", "rf", "lda"), start=1)
) + ")"


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    parts = []
    for i, m in enumerate(("svm", "knn", "rf", "lda"), start=1):
        named = F.when(hash_share("v" + m, "vec_id") < 0.6, F.col("label")).otherwise((F.col("label") + i) % 10)
        parts.append(
            rows.select(
                text_of("vec_id").alias("contig"),
                F.lit(m).alias("method"),
                F.concat(F.lit("bin_"), named.cast("string")).alias("assigned_bin"),
                (0.5 + hash_share("p" + m, "vec_id") / 2).alias("prob"),
            )
        )
    return shape.union_strict(*parts)


TIERS = f"""{VOTES}, v AS (SELECT * FROM votes WHERE method <> 'lda'),
  pb AS (SELECT contig, assigned_bin, count(*) AS n, avg(prob) AS mean_prob FROM v GROUP BY 1, 2),
  pc AS (SELECT contig, count(*) AS bins FROM pb GROUP BY 1),
  tiers AS (SELECT contig, assigned_bin, mean_prob, CASE WHEN bins = 2 THEN 'low_confidence' WHEN mean_prob > 0.8 THEN 'high_confidence'
      ELSE 'medium_confidence' END AS confidence FROM pb JOIN pc USING (contig) WHERE bins = 1 OR (bins = 2 AND n = 2))"""


@query(
    "M19",
    f"""WITH {TIERS} SELECT contig, assigned_bin, method, round(prob, 6) AS prob, round(mean_prob, 6) AS mean_prob, confidence
        FROM v JOIN tiers USING (contig, assigned_bin)""",
)
def vote_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three votes per contig reduced to a bin and a confidence tier."""
    out = scoring.confidence_tiers(votes(spark, sf_dir))
    return out.withColumns({c: r6(F.col(c)) for c in ("prob", "mean_prob")})


@query(
    "M28",
    f"""WITH {TIERS} SELECT CAST(vec_id AS VARCHAR) AS contig, 'bin_' || CAST(label AS VARCHAR) AS bin, false AS included FROM embeddings
        UNION ALL SELECT DISTINCT contig, assigned_bin, true FROM tiers WHERE confidence = 'high_confidence'""",
)
def applied_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old pairs plus the contigs assigned with high confidence."""
    old = table(spark, sf_dir, "embeddings").select(
        text_of("vec_id").alias("contig"), F.concat(F.lit("bin_"), text_of("label")).alias("bin")
    )
    return scoring.apply_assignments(old, scoring.confidence_tiers(votes(spark, sf_dir)))


@query(
    "M20",
    f"""WITH {VOTES}, m AS (SELECT contig, assigned_bin AS class, sum(round(prob, 8)) / 3 AS prob FROM votes WHERE method IN ('lda', 'knn', 'rf') GROUP BY 1, 2),
         t AS (SELECT *, max(round(prob, 9)) OVER (PARTITION BY contig) AS top FROM m)
        SELECT contig, top AS confidence, min(class) AS classification FROM t WHERE round(prob, 9) = top GROUP BY 1, 2""",
)
def soft_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean class probability over methods and the best class."""
    long = votes(spark, sf_dir).withColumnRenamed("assigned_bin", "class")
    long = long.withColumn("prob", F.round("prob", 8))
    used = scoring.soft_vote(long)
    return used.withColumn("confidence", F.round("confidence", 9))


@query(
    "M25 T03",
    f"""WITH {SCORED}, {CONTIG_BIN}, m AS (SELECT bin, motif, round(avg(median), 9) AS mean, max(median) AS top FROM scored JOIN contig_bin USING (contig)
            WHERE mean_read_cov >= 3 AND n_motif_obs * mean_read_cov >= 17 GROUP BY 1, 2)
        SELECT bin, motif, mean, 'high' AS side FROM m WHERE top >= 1.0 UNION ALL
        SELECT bin, motif, mean, 'low' FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY mean DESC, motif) AS n FROM m WHERE mean < 0.5) WHERE n <= 3""",
)
def motif_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motifs that reach a limit, plus a few low ones, per bin."""
    rows = shape.min_evidence(scored(spark, sf_dir), 17, 3, strict=False).join(contig_bin(spark, sf_dir), "contig")
    return scoring.contrast_features(rows, ["bin"], "motif", "median", 1.0, 0.5, 3)


@query(
    "M26",
    f"""WITH {SCORED}, {CONTIG_BIN}, lim("limit") AS (VALUES (17.0::DOUBLE), (24.0::DOUBLE), (40.0::DOUBLE))
        SELECT "limit", bin, count(*) AS n, count(DISTINCT contig) AS n_contigs, {exact_mean_sql("median")} AS mean
        FROM scored JOIN contig_bin USING (contig) JOIN lim ON n_motif_obs * mean_read_cov >= "limit" WHERE mean_read_cov >= 3 GROUP BY 1, 2""",
)
def evidence_limit_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same summary for several evidence limits in one job."""
    swept = features.evidence_sweep(scored(spark, sf_dir), [17, 24, 40], 3)
    return swept.join(contig_bin(spark, sf_dir), "contig").groupBy("limit", "bin").agg(
        F.count("*").alias("n"), F.count_distinct("contig").alias("n_contigs"), exact_mean("median").alias("mean")
    )


@query("M26 M01 M06 M12")
def clusters_per_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs clustered anew for every evidence limit, with the cluster and the home share of their bin.

    One row per limit and contig. ``home_share`` is the part of the bin's contigs
    that lie in its home cluster, the one that holds most of them.
    """
    swept = features.evidence_sweep(scored(spark, sf_dir), [17, 24, 40], 3).join(contig_bin(spark, sf_dir), "contig")
    return scoring.home_shares(features.clustered_per_limit(swept, "motif", "median", 10))


CELLS = f"""cells AS (SELECT contig, bin, motif, avg(median) AS x FROM scored JOIN contig_bin USING (contig)
  WHERE mean_read_cov >= 3 AND n_motif_obs * mean_read_cov >= 17 GROUP BY 1, 2, 3)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contig by motif table of the rows with enough evidence."""
    rows = shape.min_evidence(scored(spark, sf_dir), 17, 3, strict=False)
    rows = rows.join(contig_bin(spark, sf_dir), "contig")
    return rows.groupBy("contig", "bin", "motif").agg(F.avg("median").alias("x"))


@query(
    "M01 M03",
    f"""WITH {SCORED}, {CONTIG_BIN}, {CELLS}, g AS (SELECT * FROM (SELECT DISTINCT contig, bin FROM cells), (SELECT DISTINCT motif FROM cells)),
          b AS (SELECT bin, motif, avg(x) AS m FROM cells GROUP BY 1, 2)
        SELECT contig, bin, motif, round(coalesce(x, m, 0), 6) AS x FROM g LEFT JOIN cells USING (contig, bin, motif) LEFT JOIN b USING (bin, motif)""",
)
def imputed_within_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing cells take the mean of their bin, or 0."""
    rows = cells(spark, sf_dir)
    index = features.feature_index(rows, "motif")
    vectors = features.impute_within(rows, "motif", "x", index)
    return features.vectors_to_long(vectors, ["contig", "bin"], index, "x").withColumn("x", r6(F.col("x")))


@query(
    "M02 J05",
    f"""WITH {SCORED}, {CONTIG_BIN}, {CELLS}, f AS (SELECT DISTINCT motif FROM cells), g AS (SELECT * FROM (SELECT DISTINCT contig FROM cells JOIN f USING (motif)), f)
        SELECT contig, motif, round(coalesce(x, 0), 6) AS x FROM g LEFT JOIN cells USING (contig, motif)""",
)
def imputed_unbinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing cells of contigs without a bin become 0."""
    rows = cells(spark, sf_dir)
    index = features.feature_index(rows, "motif")
    vectors = features.impute_unbinned(rows, "motif", "x", index)
    return features.vectors_to_long(vectors, ["contig"], index, "x").withColumn("x", r6(F.col("x")))


@query(
    "M04 M03",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings),
         s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY 1)
       SELECT vec_id AS id, CAST(dim AS INTEGER) AS dim, round((x - m) / sd, 5) AS z FROM e JOIN s USING (dim)""",
)
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero mean and unit deviation per feature, in long form."""
    rows = embeddings(spark, sf_dir)
    scaled = features.Standardiser.fit(rows).apply(rows)
    long = scaled.select("id", F.posexplode("features").alias("dim", "z"))
    return long.withColumn("z", F.round("z", 5))


@query("M24")
def axis_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of the contigs of each region by average linkage of their features."""
    rows = cells(spark, sf_dir)
    index = features.feature_index(rows, "motif")
    vectors = features.impute_within(rows, "motif", "x", index)
    nation = table(spark, sf_dir, "nation").select(text_of("n_nationkey").alias("bin"), "n_regionkey")
    return features.leaf_order(vectors.join(nation, "bin"), ["n_regionkey"], "contig")


@query(
    "M24",
    f"""WITH {SCORED}, {CONTIG_BIN}, {CELLS}, c AS (SELECT DISTINCT contig, bin FROM cells)
        SELECT n_regionkey, count(*) AS rows, count(DISTINCT contig) AS contigs, true AS in_range FROM c JOIN nation ON bin = CAST(n_nationkey AS VARCHAR) GROUP BY 1""",
)
def axis_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contig has one place on its region's axis, counted from 0 and below the number of contigs."""
    order = axis_order(spark, sf_dir)
    return order.groupBy("n_regionkey").agg(
        F.count("*").alias("rows"), F.count_distinct("contig").alias("contigs"),
        ((F.min("leaf") == 0) & (F.max("leaf") < F.count("*"))).alias("in_range"),
    )
