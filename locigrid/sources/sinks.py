"""Writers. Output is a folder of part files; no writer gathers rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locigrid.operators.joins import join_null_safe
from locigrid.session import sized


# Rows of a file in a partitioned folder, about.
FILE_ROWS = 1_000_000


def dealt_to_files(df: DataFrame, partition_by: Sequence[str], rows: int = FILE_ROWS) -> DataFrame:
    """``df`` dealt out so that a partition value is written by as many tasks as its rows need, not by all."""
    per_value = df.groupBy(*partition_by).agg(F.ceil(F.count("*") / rows).alias("__files"))
    joined = join_null_safe(df, sized(per_value), partition_by)
    salt = F.pmod(F.xxhash64(*df.columns), F.col("__files"))
    return joined.withColumn("__file", salt).repartition(*partition_by, "__file").select(*df.columns)


def write_table(
    df: DataFrame,
    path: str,
    sep: str = "\t",
    header: bool = True,
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
) -> None:
    """Delimited text. The default mode refuses to replace an existing target."""
    if partition_by:
        df = dealt_to_files(df, partition_by)
    writer = df.write.mode(mode).option("sep", sep).option("header", header)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_headerless(df: DataFrame, path: str) -> None:
    write_table(df, path, header=False)


def write_csv(df: DataFrame, path: str) -> None:
    write_table(df, path, sep=",")


def write_replicates(df: DataFrame, path: str) -> None:
    """One folder per benchmark replicate, headerless ``contig, bin`` pairs."""
    write_table(df, path, header=False, partition_by=["benchmark"])


def write_empty(spark: SparkSession, path: str, schema: str) -> None:
    """A table of which only the header line is written."""
    empty = spark.createDataFrame([], T.StructType.fromDDL(schema))
    write_table(empty.coalesce(1), path)


def fasta_record(header: Column, seq: Column, width: int = 60) -> Column:
    wrapped = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), header, F.lit("\n"), wrapped)


def write_fasta(
    df: DataFrame, path: str, header: str = "contig", partition_by: Sequence[str] = (), width: int = 60
) -> None:
    text = df.select(*partition_by, fasta_record(F.col(header), F.col("seq"), width).alias("value"))
    if partition_by:
        text = dealt_to_files(text, partition_by)
    writer = text.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).text(path)


def fastq_record(read_id: Column, tags: Column, seq: Column, qual: Column) -> Column:
    head = F.concat(F.lit("@"), read_id, F.when(F.length(tags) > 0, F.concat(F.lit("\t"), tags)).otherwise(""))
    # a read without bases keeps its four lines
    return F.concat_ws("\n", head, F.coalesce(seq, F.lit("")), F.lit("+"), F.coalesce(qual, F.lit("")))


def write_fastq(df: DataFrame, path: str) -> None:
    record = fastq_record(F.col("read_id"), F.coalesce("tags", F.lit("")), F.col("seq"), F.col("qual"))
    df.select(record.alias("value")).write.mode("errorifexists").text(path)


def concat_sources(spark: SparkSession, paths: Sequence[str], target: str) -> None:
    """Lines of many text files in one folder; file order is not kept."""
    spark.read.text(list(paths)).write.mode("errorifexists").text(target)


def gather(
    spark: SparkSession, paths: Sequence[str], schema: str, target: str, source_header: bool = False
) -> None:
    """Bodies of many CSV files under one shared header."""
    reader = spark.read.schema(schema).option("header", source_header)
    write_csv(reader.csv(list(paths)), target)
