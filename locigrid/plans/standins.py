"""The given tables in the shapes the operators expect, as DataFrames and as the
same SQL.

contig = supplier or document, bin = nation or document source, motif = part
brand, intervals = events, sequence = the letters of a document mapped to bases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of a text that are not bases, and the base each becomes.
LETTERS = "BDEFHIJKLMNOPQRSUVWXYZ"
BASES = "ACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    return F.col(column).cast("string")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored motif rows: several per contig and motif."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            text_of("l_suppkey").alias("contig"),
            F.col("p_brand").alias("motif"),
            F.col("l_returnflag").alias("mod_type"),
            F.col("l_linenumber").alias("mod_position"),
            F.col("l_quantity").cast("long").alias("n_motif_obs"),
            F.round(F.col("l_tax") * 100, 0).alias("mean_read_cov"),
            F.round(F.col("l_discount") * 10, 2).alias("median"),
        )
    )


SCORED = """scored AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS contig, p_brand AS motif, l_returnflag AS mod_type,
         l_linenumber AS mod_position, CAST(l_quantity AS BIGINT) AS n_motif_obs,
         round(l_tax * 100, 0) AS mean_read_cov, round(l_discount * 10, 2) AS median
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def contig_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        text_of("s_suppkey").alias("contig"), text_of("s_nationkey").alias("bin")
    )


CONTIG_BIN = """contig_bin AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS contig, CAST(s_nationkey AS VARCHAR) AS bin FROM supplier)"""


def base_text(column: str = "text") -> Column:
    letters = F.upper(F.regexp_replace(column, "[^A-Za-z]", ""))
    return F.translate(letters, LETTERS, BASES)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), text_of("doc_id")).alias("contig"),
        F.col("source").alias("sample"),
        base_text().alias("seq"),
    )


SEQUENCES = f"""seqs AS (
  SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS contig, source AS sample,
         translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq
  FROM documents)"""


def minute(column: str = "ts") -> Column:
    """Whole minutes since 2024-01-01, whatever the session time zone."""
    days = F.date_diff(F.to_date(column), F.lit("2024-01-01").cast("date"))
    return (days.cast("long") * 1440 + F.hour(column) * 60 + F.minute(column)).cast("long")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = minute()
    return table(spark, sf_dir, "events").select(
        text_of("user_id").alias("contig"),
        F.col("event_type").alias("sample"),
        start.alias("start"),
        (start + 1 + F.floor("value")).alias("end"),
    )


INTERVALS = """intervals AS (
  SELECT CAST(user_id AS VARCHAR) AS contig, event_type AS sample,
         CAST(floor(epoch(ts) / 60) AS BIGINT) - 28401120 AS start,
         CAST(floor(epoch(ts) / 60) AS BIGINT) - 28401120 + 1 + CAST(floor(value) AS BIGINT) AS "end"
  FROM events)"""

# Length of every contig of the interval table: 45 days of minutes.
INTERVAL_SPAN = 64_800


def interval_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select(text_of("user_id").alias("contig")).distinct()
    return ids.withColumn("length", F.lit(INTERVAL_SPAN).cast("long"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("features"),
        text_of("label").alias("label"),
    )


def hash_share(seed: str, column: str) -> Column:
    """Number in [0, 1) from a hash, for labels and votes that stand in for
    model output."""
    text = F.md5(F.concat(F.lit(seed + "|"), text_of(column)).cast("binary"))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_share_sql(seed: str, column: str) -> str:
    digits = f"'0x' || substr(md5('{seed}|' || CAST({column} AS VARCHAR)), 1, 8)"
    return f"(CAST(CAST({digits} AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


def r6(column: Column) -> Column:
    return F.round(column, 6)


def exact_mean(column: str, digits: int = 2) -> Column:
    """Mean of values that hold at most ``digits`` decimals. The sum is rounded
    to them first, so the result does not depend on the order of summation."""
    return F.round(F.round(F.sum(column), digits) / F.count(column), 9)


def exact_mean_sql(column: str, digits: int = 2) -> str:
    return f"round(round(sum({column}), {digits}) / count({column}), 9)"
