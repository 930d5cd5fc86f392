"""Seeded samples and benchmark replicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locigrid.operators import sampling
from locigrid.operators.aggregate import groups_with_n
from locigrid.plans.catalog import query
from locigrid.plans.standins import CONTIG_BIN, SCORED, contig_bin, scored, table, text_of

REPLICATES = 50


@query(
    "R01",
    "SELECT doc_id FROM documents WHERE CAST(CAST('0x' || substr(md5('11|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 < 0.3",
)
def fraction_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About a share of the rows, by hash: the same rows on any layout."""
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return sampling.sample_fraction(rows, F.col("doc_id"), 0.3, 11)


@query(
    "R02 R01",
    """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('11|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS n FROM orders
         WHERE CAST(CAST('0x' || substr(md5('11|' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 < 0.5) WHERE n <= 4000""",
)
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly n rows after a share was drawn."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return sampling.sample_n(sampling.sample_fraction(rows, F.col("o_orderkey"), 0.5, 11), "o_orderkey", 4000, 11)


@query(
    "R02",
    """SELECT l_returnflag, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('3|' || CAST(l_orderkey AS VARCHAR)), l_orderkey) AS n
         FROM (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem)) WHERE n <= 500""",
)
def exact_sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey").distinct()
    return sampling.sample_n(rows, "l_orderkey", 500, 3, ["l_returnflag"])


ELIGIBLE = f"""{SCORED}, {CONTIG_BIN},
  m AS (SELECT contig, bin, n_motif_obs FROM scored JOIN contig_bin USING (contig)
        WHERE mean_read_cov > 2 AND n_motif_obs * mean_read_cov >= 40 AND motif = 'Brand#1' AND mod_type = 'A'),
  eligible AS (SELECT DISTINCT contig, bin FROM (SELECT *, n_motif_obs / sum(n_motif_obs) OVER (PARTITION BY bin) AS p FROM m) WHERE p < 0.2)"""


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.eligible_small(scored(spark, sf_dir), contig_bin(spark, sf_dir), "Brand#1", "A")


@query("R05 P08 A15", f"WITH {ELIGIBLE} SELECT * FROM eligible")
def eligible_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs with a small share of the observations of one motif in their bin."""
    return eligible(spark, sf_dir)


REMOVED = f"""{ELIGIBLE}, reps AS (SELECT CAST(unnest(range({REPLICATES})) AS INTEGER) AS benchmark),
  removed AS (SELECT benchmark, bin, contig FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, bin ORDER BY
     md5('42|' || CAST(benchmark AS VARCHAR) || '|' || contig), contig) AS n FROM eligible, reps) WHERE n = 1)"""


@query(
    "R03",
    f"WITH {REMOVED} SELECT benchmark, contig, bin FROM contig_bin, reps WHERE (benchmark, bin, contig) NOT IN (SELECT (benchmark, bin, contig) FROM removed)",
)
def holdout_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bin with eligible contigs loses one per replicate."""
    kept, _ = sampling.holdout_one(contig_bin(spark, sf_dir), eligible(spark, sf_dir), REPLICATES)
    return kept


@query("R03", f"WITH {REMOVED} SELECT * FROM removed")
def heldout_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, removed = sampling.holdout_one(contig_bin(spark, sf_dir), eligible(spark, sf_dir), REPLICATES)
    return removed


# Donors need several contigs: here every customer of a nation may move.
MOVABLE = "contigs AS (SELECT CAST(c_custkey AS VARCHAR) AS contig, CAST(c_nationkey AS VARCHAR) AS bin FROM customer)"
ROOMY = "el AS (SELECT contigs.contig, contigs.bin FROM contigs JOIN customer ON contig = CAST(c_custkey AS VARCHAR) WHERE c_nationkey % 5 < 3)"
MOVES = f"""{MOVABLE}, {ROOMY}, reps AS (SELECT CAST(unnest(range({REPLICATES})) AS INTEGER) AS benchmark),
  bins AS (SELECT benchmark, bin, bin IN (SELECT bin FROM el) AS donor, md5('42|' || CAST(benchmark AS VARCHAR) || '|' || bin) AS h FROM (SELECT DISTINCT bin FROM contigs), reps),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY benchmark, donor ORDER BY h, bin) - 1 AS r FROM bins),
  d AS (SELECT benchmark, count(*) AS d FROM ranked WHERE donor GROUP BY 1),
  picks AS (SELECT benchmark, bin AS donor, contig, row_number() OVER (PARTITION BY benchmark, bin ORDER BY md5('42|pick|' || CAST(benchmark AS VARCHAR) || '|' || contig), contig) AS pick FROM el, reps),
  owned AS (SELECT p.*, g.r AS src FROM picks p JOIN ranked g ON g.benchmark = p.benchmark AND g.donor AND g.bin = p.donor),
  spare AS (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY pick, src) AS place FROM owned WHERE pick > 1),
  moves AS (SELECT t.benchmark, o.contig, o.donor, t.bin FROM ranked t JOIN d USING (benchmark) JOIN owned o ON o.benchmark = t.benchmark AND o.pick = 1 AND o.src = (t.r + 1) % d WHERE t.donor
     UNION ALL SELECT t.benchmark, s.contig, s.donor, t.bin FROM ranked t JOIN spare s ON s.benchmark = t.benchmark AND s.place = t.r + 1 WHERE NOT t.donor)"""


def _moves(spark: SparkSession, sf_dir: str):
    customer = table(spark, sf_dir, "customer")
    pairs = customer.select(
        text_of("c_custkey").alias("contig"), text_of("c_nationkey").alias("bin"), "c_nationkey"
    )
    movable = pairs.filter(F.col("c_nationkey") % 5 < 3).select("contig", "bin")
    return sampling.inject_foreign(pairs.select("contig", "bin"), movable, REPLICATES)


@query("R04", f"WITH {MOVES} SELECT * FROM moves")
def injected_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which contig moves from which bin to which, per replicate."""
    return _moves(spark, sf_dir)[1]


@query(
    "R04 U05 K07",
    f"""WITH {MOVES} SELECT benchmark, contig, bin FROM contigs, reps WHERE (benchmark, contig) NOT IN (SELECT (benchmark, contig) FROM moves)
        UNION ALL SELECT benchmark, 'contamination_' || contig, bin FROM moves""",
)
def injected_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicate tables in which every bin holds one foreign contig."""
    return _moves(spark, sf_dir)[0]


@query(
    "R06",
    """WITH k AS (SELECT DISTINCT source FROM documents)
       SELECT source FROM (SELECT source, row_number() OVER (ORDER BY md5('1|' || source), source) AS n FROM k WHERE source <> 'src0')
       WHERE n <= (SELECT count(*) // 2 FROM k)""",
)
def half_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the distinct keys, after one is excluded."""
    return sampling.choose_keys(table(spark, sf_dir, "documents"), "source", 1, ["src0"])


DOWN = """t AS (SELECT source AS sample, CAST(sum(n_chars) AS DOUBLE) AS total, count(*) AS num_reads, 60000.0::DOUBLE AS bases_required FROM documents GROUP BY 1),
  s AS (SELECT source AS sample, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY md5('1236|' || CAST(doc_id AS VARCHAR)), doc_id) AS upto FROM documents),
  kept AS (SELECT sample, doc_id, n_chars FROM s WHERE upto - n_chars < 60000)"""


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS read_id", "source AS sample", "n_chars AS length")


def _targets(reads: DataFrame) -> DataFrame:
    return reads.select("sample").distinct().withColumn("bases_required", F.lit(60_000.0))


@query("R07 W07", f"WITH {DOWN} SELECT doc_id AS read_id, sample, n_chars AS length FROM kept")
def downsampled_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled reads of each sample until the required bases are reached."""
    reads = _reads(spark, sf_dir)
    return sampling.downsample_to_coverage(reads, _targets(reads))


@query(
    "R07 C15",
    f"""WITH {DOWN} SELECT sample, CAST(total AS BIGINT) AS total_bp, num_reads, k.num_reads_required, k.sampled_length_sum, bases_required < total AS enough_bases
        FROM t JOIN (SELECT sample, count(*) AS num_reads_required, CAST(sum(n_chars) AS BIGINT) AS sampled_length_sum FROM kept GROUP BY 1) k USING (sample)""",
)
def downsampling_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and bases kept, and whether there were enough."""
    reads = _reads(spark, sf_dir)
    targets = _targets(reads)
    return sampling.downsample_report(reads, sampling.downsample_to_coverage(reads, targets), targets)


@query(
    "R08",
    """SELECT source, count(*) AS observed, CAST(count(*) AS BIGINT) + CAST(length(source) AS BIGINT) AS expected, count(*) >= count(*) + length(source) - 5 AS ok
       FROM documents GROUP BY 1""",
)
def count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed against expected numbers with a tolerance."""
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("observed"))
    expected = counts.select("source", (F.col("observed") + F.length("source")).alias("expected"))
    return sampling.check_counts(counts, expected, "source", 5)


@query("R08", "SELECT source, count(*) AS observed, count(*) AS expected, true AS ok FROM documents GROUP BY 1")
def count_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows pass when no sample has too few reads."""
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("observed"))
    expected = counts.select("source", F.col("observed").alias("expected"))
    return sampling.require_counts(sampling.check_counts(counts, expected, "source"))


@query(
    "A08 R05",
    f"WITH {CONTIG_BIN} SELECT contig, bin FROM contig_bin WHERE bin IN (SELECT bin FROM contig_bin GROUP BY 1 HAVING count(*) = 1)",
)
def single_contig_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins with one contig, in which no foreign contig can be told."""
    return groups_with_n(contig_bin(spark, sf_dir), ["bin"], 1)
