"""Readers of sequence and read files, parsed by the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locigrid.operators.joins import join_null_safe
from locigrid.operators.scans import OrderedScan
from locigrid.session import written


def read_fasta(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``contig, description, seq``: the first word of the header, the whole
    header, and the joined sequence lines. The reader splits the file at record
    starts, so one file is read by many tasks."""
    records = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>", "")
    parts = F.split(body, "\n", 2)
    header = F.regexp_replace(F.get(parts, F.lit(0)), r"\s+$", "")
    seq = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "")
    return records.filter(F.length(F.trim("value")) > 0).select(
        F.regexp_substr(header, F.lit(r"^\S+")).alias("contig"),
        header.alias("description"),
        seq.alias("seq"),
    )


# Lines that one window holds, as a power of two.
LINE_BITS = 16


def read_fasta_spans(spark: SparkSession, path: str | Sequence[str], span: int = 1 << 16) -> DataFrame:
    """``contig, record, start, seq``: sequences in spans of ``span`` letters, the last of a record shorter.

    ``start`` counts from 0 and ``record`` tells equal names apart. Lines, not
    records, are the rows, so one long record is read and joined by many tasks;
    headers and offsets reach the lines by a scan that carries one row per bucket.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("mid"),
        F.regexp_replace("value", r"\s+$", "").alias("value"),
    )
    head = F.col("value").startswith(">")
    letters = F.when(head, F.lit("")).otherwise(F.regexp_replace("value", r"\s", ""))
    # written, so that every pass agrees on the numbers
    name = F.when(head, F.regexp_substr("value", F.lit(r"(?<=^>)\S+")))
    lines = written(lines.withColumns({"head": head, "letters": letters, "name": name}).drop("value"), "lines")
    # a split has too many lines for one window; a bucket lies inside a split
    scan = OrderedScan(lines, ["file"], ["mid"], F.shiftright("mid", LINE_BITS))
    scan = scan.running_sum(F.length("letters").cast("long"), "upto")
    placed = scan.fill_down(F.when(F.col("head"), F.struct("mid", "name")), "at").result()
    begin = placed.filter("head").select("file", F.col("mid").alias("record"), F.col("upto").alias("before"))
    placed = placed.filter("length(letters) > 0 AND at IS NOT NULL").select("file", "mid", "letters", "upto", F.col("at.mid").alias("record"), F.col("at.name").alias("contig"))
    placed = join_null_safe(placed, begin, ["file", "record"])
    first = F.col("upto") - F.col("before") - F.length("letters")
    # a line that reaches over the end of a span is cut there
    low, high = F.floor(F.col("first") / span), F.floor((F.col("first") + F.length("letters") - 1) / span)
    cut = placed.withColumn("first", first).withColumn("k", F.explode(F.sequence(low, high)))
    skip = F.greatest(F.col("k") * span - F.col("first"), F.lit(0))
    size = F.least((F.col("k") + 1) * span - F.col("first"), F.length("letters").cast("long")) - skip
    piece = F.substring("letters", (skip + 1).cast("int"), size.cast("int"))
    in_order = F.sort_array(F.collect_list(F.struct("first", piece.alias("piece"))))
    joined = F.array_join(F.transform(in_order, lambda x: x["piece"]), "")
    spans = cut.groupBy("file", "record", "contig", "k").agg(joined.alias("seq"))
    return spans.select("contig", F.xxhash64("file", "record").alias("record"), (F.col("k") * span).alias("start"), "seq")


def read_fastq(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``read_id, tags, seq, qual`` from four-line records.

    A quality line may start with ``@``, so records are told apart by line
    number. Lines are numbered inside each split of a file, and the line counts
    of the splits before it, one row per split, are added.
    """
    lines = spark.read.text(path).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
    )
    # written, so that counts and rows agree on the numbers
    lines = written(lines, "lines")
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        "file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    numbered = join_null_safe(lines, splits, ["file", "block"]).withColumn(
        "line", F.col("start") + F.col("mid") - F.col("first")
    )
    part = F.pmod("line", F.lit(4))
    record = numbered.groupBy("file", F.floor(F.col("line") / 4).alias("record")).agg(
        F.max(F.when(part == 0, F.col("value"))).alias("head"),
        F.max(F.when(part == 1, F.col("value"))).alias("seq"),
        F.max(F.when(part == 3, F.col("value"))).alias("qual"),
    )
    head = F.regexp_replace("head", "^@", "")
    tags = F.regexp_replace(head, r"^\S*\s?", "")
    return record.filter(F.col("qual").isNotNull()).select(
        F.regexp_substr(head, F.lit(r"^\S+")).alias("read_id"), tags.alias("tags"), "seq", "qual"
    )
