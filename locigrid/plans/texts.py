"""String and number columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locigrid.functions import numeric as num
from locigrid.functions import text as txt
from locigrid.plans.catalog import query
from locigrid.plans.standins import SEQUENCES, r6, sequences, table

# A motif for every part: bases with one modified position, some with an N run.
_MOTIF = "CASE WHEN p_size % 3 = 0 THEN 'CAT' || repeat('N', p_size % 7) || 'TTC' ELSE 'GANNTC' END"
_MOD = "CASE p_size % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'm' WHEN 2 THEN '21839' ELSE 'x' END"
MOTIFS = f"motifs AS (SELECT p_partkey, {_MOTIF} AS motif, {_MOD} AS mod_type, p_size % 5 AS mod_position FROM part)"


def motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey", f"{_MOTIF} AS motif", f"{_MOD} AS mod_type", "p_size % 5 AS mod_position"
    )


@query(
    "C01",
    """SELECT url, regexp_replace(url, 'th', '') AS removed, regexp_replace(url, '[?#].*', '!') AS replaced FROM pages""",
)
def first_match_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first match is removed or replaced."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "url", txt.remove_first(url, "th").alias("removed"), txt.replace_first(url, "[?#].*", "!").alias("replaced")
    )


@query(
    "C02",
    "SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS has_number, contains(text, 'the') AS has_the FROM documents",
)
def detect_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").rlike("[0-9]{3}").alias("has_number"), F.col("text").contains("the").alias("has_the")
    )


@query(
    "C03",
    f"WITH {MOTIFS} SELECT p_partkey, CAST(length(nullif(regexp_extract(motif, 'NNN*'), '')) AS INTEGER) AS ns FROM motifs",
)
def n_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the first run of two or more N, NULL without one."""
    return motifs(spark, sf_dir).select("p_partkey", txt.n_run_length(F.col("motif")).alias("ns"))


@query(
    "C04",
    f"""WITH {MOTIFS} SELECT p_partkey, substr(motif, 1, mod_position) AS before, substr(motif, mod_position + 1, 1) AS base,
          substr(motif, mod_position + 2) AS after FROM motifs""",
)
def split_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = txt.split_at(F.col("motif"), F.col("mod_position"))
    names = ("before", "base", "after")
    return motifs(spark, sf_dir).select("p_partkey", *[c.alias(n) for c, n in zip(parts, names)])


@query(
    "C06 J13 F01",
    f"""WITH {MOTIFS}, l AS (SELECT p_partkey, motif, substr(motif, 1, mod_position) || '<strong>' || substr(motif, mod_position + 1, 1)
            || '<sub>' || CASE mod_type WHEN 'a' THEN 'm6' WHEN 'm' THEN 'm5' WHEN '21839' THEN 'm4' ELSE 'NA' END
            || '</sup></strong>' || substr(motif, mod_position + 2) AS label FROM motifs)
        SELECT p_partkey, regexp_replace(label, 'NNN*', '(N)<sub>' ||
          coalesce(CAST(length(nullif(regexp_extract(motif, 'NNN*'), '')) AS VARCHAR), 'NA') || '</sub>') AS label FROM l""",
)
def motif_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = txt.motif_label(F.col("motif"), F.col("mod_position"), F.col("mod_type"))
    return motifs(spark, sf_dir).select("p_partkey", label.alias("label"))


@query(
    "C07",
    """SELECT d.doc_id, d.source || ' - ' || coalesce(CAST(l.quality AS VARCHAR), 'NA') AS label
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def paste_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing part prints as NA."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", txt.paste(F.col("source"), " - ", F.col("quality")).alias("label"))


@query(
    "C08 P05",
    """SELECT p_partkey, split_part(p_name, ' ', 1) AS first, nullif(split_part(p_name, ' ', 3), '') AS third,
         TRY_CAST(split_part(p_brand, '#', 2) AS BIGINT) AS number FROM part""",
)
def split_and_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        txt.split_pick(F.col("p_name"), " ", 0).alias("first"),
        txt.split_pick(F.col("p_name"), " ", 2).alias("third"),
        txt.split_pick(F.col("p_brand"), "#", 1).try_cast("long").alias("number"),
    )


_HEADER = """CASE doc_id % 4 WHEN 0 THEN source || '_contig_' || CAST(doc_id AS VARCHAR) || '_sliding_1-' || CAST(n_chars AS VARCHAR)
  WHEN 1 THEN source || '_contig_a_contig_' || CAST(doc_id AS VARCHAR) WHEN 2 THEN source || '_sliding_x-y' ELSE source END"""


@query(
    "C09 C10",
    f"""WITH h AS (SELECT doc_id, {_HEADER} AS header FROM documents),
         w AS (SELECT *, CASE WHEN contains(header, '_sliding_') THEN regexp_extract(header, '^.*_sliding_(.*)$', 1) END AS win,
           CASE WHEN contains(header, '_sliding_') THEN regexp_extract(header, '^(.*)_sliding_.*$', 1) ELSE header END AS head FROM h)
        SELECT doc_id, CASE WHEN contains(head, '_contig_') THEN regexp_extract(head, '^(.*)_contig_.*$', 1) ELSE head END AS sample,
          CASE WHEN contains(head, '_contig_') THEN regexp_extract(head, '^.*_contig_(.*)$', 1) END AS contig,
          TRY_CAST(split_part(win, '-', 1) AS BIGINT) AS start, TRY_CAST(split_part(win, '-', 2) AS BIGINT) AS "end" FROM w""",
)
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample, contig and range of a window header; missing parts are NULL."""
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{_HEADER} AS header".replace("VARCHAR", "STRING")
    )
    sample, contig, window = txt.header_parts(F.col("header"))
    start, end = txt.parse_range(window)
    return rows.select(
        "doc_id", sample.alias("sample"), contig.alias("contig"), start.alias("start"), end.alias("end")
    )


@query("C11", "SELECT page_id, 'page_' || replace(url, ':', '_') AS header FROM pages")
def header_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", txt.prefixed_header(F.lit("page"), F.col("url")).alias("header")
    )


@query(
    "C13",
    """SELECT doc_id, CAST(CAST(round_even(n_chars / 1000.0::DOUBLE, 0) AS BIGINT) AS VARCHAR) || ' kbp' AS kbp,
         CAST(round_even(n_chars / 8.0::DOUBLE, 0) AS BIGINT) AS eighth FROM documents""",
)
def numeric_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded numbers as text, halves to even."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        txt.kbp_label(F.col("n_chars")).alias("kbp"),
        F.bround(F.col("n_chars") / 8.0, 0).cast("long").alias("eighth"),
    )


@query(
    "C14 C15",
    """SELECT s_suppkey, round(log10(n + 1), 6) AS weight, round(pow(10, 1 + s_suppkey / 1000.0::DOUBLE), 4) AS abundance,
         round(bases / n, 6) AS coverage, round(n * 1.5::DOUBLE, 6) AS required, n * 1.5::DOUBLE < bases AS enough
       FROM (SELECT l_suppkey AS s_suppkey, CAST(count(*) AS DOUBLE) AS n, sum(l_quantity) AS bases FROM lineitem GROUP BY 1)""",
)
def coverage_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms, powers and coverage ratios."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count("*").cast("double").alias("n"), F.sum("l_quantity").alias("bases")
    )
    required = num.bases_required(F.col("n"), F.lit(1.5))
    return rows.select(
        "s_suppkey",
        r6(F.log10(F.col("n") + 1)).alias("weight"),
        F.round(F.pow(F.lit(10.0), 1 + F.col("s_suppkey") / 1000.0), 4).alias("abundance"),
        r6(num.available_coverage(F.col("bases"), F.col("n"))).alias("coverage"),
        r6(required).alias("required"),
        (required < F.col("bases")).alias("enough"),
    )


@query(
    "C16",
    """SELECT p_partkey, round(least(1.0::DOUBLE, p_size / nullif(p_retailprice / 30, 0) + 0.1::DOUBLE), 6) AS share,
         least(1.0::DOUBLE, floor(10.0::DOUBLE / p_size * 100) / 100) AS capped FROM part""",
)
def sampling_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the reads to draw, at most 1."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        r6(num.sampling_share(F.col("p_size"), F.col("p_retailprice") / 30)).alias("share"),
        num.capped_share(F.lit(10.0), F.col("p_size")).alias("capped"),
    )


@query(
    "C17 P07",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '<span style=''color:red''>' || c_name || '</span>'
         WHEN c_acctbal > 9000 THEN '<span style=''color:green''>' || c_name || '</span>' ELSE c_name END AS label FROM customer""",
)
def highlighted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    colour = F.when(F.col("c_acctbal") < 0, "red").when(F.col("c_acctbal") > 9000, "green")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", txt.highlight(F.col("c_name"), colour).alias("label")
    )


@query(
    "A20",
    f"""WITH {SEQUENCES} SELECT contig, length(seq) AS length,
          round(CAST(length(regexp_replace(seq, '[^CG]', '', 'g')) AS DOUBLE) / nullif(length(regexp_replace(seq, '[^ACGT]', '', 'g')), 0), 6) AS gc
        FROM seqs""",
)
def sequence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and GC fraction per sequence."""
    from locigrid.operators.aggregate import sequence_stats

    return sequence_stats(sequences(spark, sf_dir)).withColumn("gc", r6(F.col("gc")))


def quality_text(column: str = "seq"):
    """Quality letters that stand in for a read's: C is good, A is poor."""
    return F.translate(column, "ACGT", "#I5~")


@query(
    "C05 P16",
    f"""WITH {SEQUENCES}, c AS (SELECT contig, CAST(length(seq) AS DOUBLE) AS n,
          CAST(length(seq) - length(replace(seq, 'A', '')) AS DOUBLE) * pow(10, -0.2::DOUBLE) + CAST(length(seq) - length(replace(seq, 'C', '')) AS DOUBLE) * pow(10, -4.0::DOUBLE)
            + CAST(length(seq) - length(replace(seq, 'G', '')) AS DOUBLE) * pow(10, -2.0::DOUBLE) + CAST(length(seq) - length(replace(seq, 'T', '')) AS DOUBLE) * pow(10, -9.3::DOUBLE) AS e FROM seqs)
        SELECT contig, CAST(n AS BIGINT) AS length, round(-10 * log10(e / n), 6) AS quality FROM c WHERE n >= 200 AND -10 * log10(e / n) >= 7""",
)
def read_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads over a length and a mean quality limit."""
    from locigrid.operators.shape import filter_reads

    reads = sequences(spark, sf_dir).withColumn("qual", quality_text())
    reads = reads.withColumn("quality", num.mean_quality(F.col("qual")))
    kept = filter_reads(reads, F.col("quality"), 200, 7)
    return kept.select("contig", F.length("seq").cast("long").alias("length"), r6(F.col("quality")).alias("quality"))


@query(
    "A21 A06",
    f"""WITH {SEQUENCES}, c AS (SELECT sample, length(seq) AS n,
          CAST(length(seq) - length(replace(seq, 'A', '')) AS DOUBLE) * pow(10, -0.2::DOUBLE) + CAST(length(seq) - length(replace(seq, 'C', '')) AS DOUBLE) * pow(10, -4.0::DOUBLE)
            + CAST(length(seq) - length(replace(seq, 'G', '')) AS DOUBLE) * pow(10, -2.0::DOUBLE) + CAST(length(seq) - length(replace(seq, 'T', '')) AS DOUBLE) * pow(10, -9.3::DOUBLE) AS e FROM seqs)
        SELECT sample, count(*) AS reads, CAST(sum(n) AS BIGINT) AS bases, round(avg(n), 6) AS mean_length, median(n) AS median_length,
          round(avg(CASE WHEN n > 0 THEN -10 * log10(e / n) END), 6) AS mean_quality FROM c GROUP BY sample""",
)
def reads_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads, bases, mean and median length and mean quality per sample."""
    from locigrid.operators.aggregate import reads_summary

    reads = sequences(spark, sf_dir).withColumn("qual", quality_text())
    out = reads_summary(reads, ["sample"], num.mean_quality(F.col("qual")))
    return out.withColumns({c: r6(F.col(c)) for c in ("mean_length", "mean_quality")})


@query("F01 F02", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1)")
def single_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of one row, by a count instead of a lambda over each group."""
    from locigrid.operators.aggregate import groups_with_n

    return groups_with_n(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 1)


