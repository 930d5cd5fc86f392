"""Round trips through every file kind. Files go to the shared work folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locigrid.functions.text import prefixed_header
from locigrid.operators import intervals as iv
from locigrid.operators import joins, shape
from locigrid.operators import sequences as sq
from locigrid.operators.scans import first_per_group
from locigrid.plans.catalog import query
from locigrid.plans.replicates import MOVES, _moves
from locigrid.plans.sequence_jobs import COVERAGE, SEGMENTS, sample_coverage
from locigrid.plans.standins import (
    CONTIG_BIN,
    INTERVALS,
    SEQUENCES,
    contig_bin,
    intervals,
    r6,
    sequences,
    table,
    text_of,
)
from locigrid.session import work_path
from locigrid.sources import sequences as seq_io
from locigrid.sources import sinks
from locigrid.sources import tables as tab

SUPPLIER = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


@query("S01 K02", "SELECT * FROM supplier")
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated file with a header and a given schema."""
    path = work_path(spark, "tsv")
    sinks.write_table(table(spark, sf_dir, "supplier"), path)
    return tab.read_table(spark, path, SUPPLIER)


@query("S01 P01", "SELECT s_acctbal, s_suppkey FROM supplier")
def columns_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns found by their header name, in another order than in the file."""
    path = work_path(spark, "tsv")
    sinks.write_table(table(spark, sf_dir, "supplier"), path)
    return tab.read_table(spark, path, "s_acctbal double, s_suppkey long", by_name=True)


@query("S02 K01", f"WITH {CONTIG_BIN} SELECT * FROM contig_bin")
def headerless_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contig and bin pairs without a header."""
    path = work_path(spark, "pairs")
    sinks.write_headerless(contig_bin(spark, sf_dir), path)
    return tab.read_headerless(spark, path, tab.CONTIG_BIN)


@query(
    "S03",
    "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part",
)
def all_string_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "strings")
    sinks.write_table(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), path)
    return tab.read_strings(spark, path, ["p_partkey", "p_brand", "p_size"])


@query("S04 K03", "SELECT * FROM part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "part"), path)
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    return tab.read_csv(spark, path, schema)


@query(
    "S05",
    "SELECT source AS id, CAST(sum(n_chars) AS BIGINT) AS bases, count(*) AS reads FROM documents GROUP BY 1",
)
def json_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object per file, the id taken from the path."""
    path = work_path(spark, "json")
    summary = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.sum("n_chars").alias("bases"), F.count("*").alias("reads")
    )
    summary.repartition("source").write.partitionBy("source").json(path)
    return tab.read_json_summary(spark, f"{path}/source=*/*.json", r"source=([^/]+)/")


@query("S06", "SELECT n_chars AS length FROM documents")
def length_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with one number per line."""
    path = work_path(spark, "lengths")
    sinks.write_headerless(table(spark, sf_dir, "documents").select("n_chars"), path)
    return tab.read_lengths(spark, path)


@query(
    "S09 W08 A07",
    f"WITH {INTERVALS}, {SEGMENTS} SELECT contig, round(avg(depth), 6) AS mean_depth, round(stddev_samp(depth), 6) AS sd_depth FROM segments GROUP BY 1",
)
def bedgraph_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth segments written as bedGraph and summarised from the file."""
    path = work_path(spark, "bedgraph")
    sinks.write_headerless(iv.depth_segments(intervals(spark, sf_dir)), path)
    out = iv.depth_summary(tab.read_bedgraph(spark, path))
    return out.withColumns({c: r6(F.col(c)) for c in ("mean_depth", "sd_depth")})


@query("S10", "SELECT 'doc:' || doc_id AS contig, CAST(0 AS BIGINT) AS start, n_chars AS \"end\" FROM documents")
def alignment_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs and lengths from the sequence lines of an alignment header."""
    path = work_path(spark, "sam")
    line = F.concat(F.lit("@SQ\tSN:doc:"), F.col("doc_id"), F.lit("\tLN:"), F.col("n_chars"))
    rows = table(spark, sf_dir, "documents")
    lines = rows.select(line.alias("value")).unionByName(
        rows.select(F.concat(F.lit("@RG\tID:"), F.col("lang")).alias("value"))
    )
    lines.write.text(path)
    return tab.contigs_from_sam_header(spark, path)


@query(
    "S11 S14",
    """SELECT l_returnflag AS sample, l_linestatus AS status, label, count(*) AS n, round(sum(l_quantity), 4) AS total FROM lineitem
       JOIN (VALUES ('A', 'accepted'), ('N', 'none'), ('R', 'returned')) m(k, label) ON k = l_returnflag GROUP BY 1, 2, 3""",
)
def tagged_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many sample files in one scan, tagged from their paths, with a manifest."""
    path = work_path(spark, "samples")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("s"), F.col("l_linestatus").alias("t"), "l_orderkey", "l_quantity"
    )
    sinks.write_table(rows, path, partition_by=["s", "t"])
    tags = {"sample": r"/s=([^/]+)/", "status": r"/t=([^/]+)/"}
    back = tab.read_samples(spark, f"{path}/s=*/t=*/*.csv", "l_orderkey long, l_quantity double", tags)
    manifest = tab.literal_table(
        spark, [("A", "accepted"), ("N", "none"), ("R", "returned")], "sample string, label string"
    )
    # three rows
    return back.join(F.broadcast(manifest), "sample").groupBy("sample", "status", "label").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("total")
    )


@query(
    "S12 K06 P06",
    f"WITH {CONTIG_BIN} SELECT bin, contig, 'not contamination' AS prediction FROM contig_bin",
)
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing file and a header-only file both count as empty tables."""
    path = work_path(spark, "empty")
    # Columns of the contamination table.
    schema = (
        "bin string, bin_contig_compare string, binary_methylation_missmatch_score double, "
        "non_na_comparisons long, contig string"
    )
    sinks.write_empty(spark, path, schema)
    empty = tab.read_or_empty(spark, path, schema)
    absent = tab.read_or_empty(spark, path + "-absent", schema)
    hits = shape.union_strict(empty, absent).select("bin", "contig", F.lit("contamination").alias("prediction"))
    rows = joins.natural_left(contig_bin(spark, sf_dir), hits)
    return shape.fill_missing(rows, {"prediction": "not contamination"}).select("bin", "contig", "prediction")


@query(
    "S13 K07 S02 S11",
    f"WITH {MOVES}, m AS (SELECT benchmark, contig, bin FROM contigs, reps WHERE (benchmark, contig) NOT IN (SELECT (benchmark, contig) FROM moves) "
    "UNION ALL SELECT benchmark, 'contamination_' || contig, bin FROM moves) "
    "SELECT CAST(benchmark AS VARCHAR) AS benchmark, count(*) AS n, count(DISTINCT bin) AS bins FROM m GROUP BY 1",
)
def replicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicates written to one folder each, found by listing, read in one scan."""
    path = work_path(spark, "replicates")
    sinks.write_replicates(_moves(spark, sf_dir)[0], path)
    found = tab.discover(spark, f"{path}/benchmark=*/*.csv", r"/benchmark=([^/]+)/", ["benchmark"], ["done"])
    rows = tab.read_samples(
        spark, f"{path}/benchmark=*/*.csv", tab.CONTIG_BIN, {"benchmark": r"/benchmark=([^/]+)/"}, header=False
    )
    kept = joins.semi(rows, found, ["benchmark"])
    return kept.groupBy("benchmark").agg(F.count("*").alias("n"), F.count_distinct("bin").alias("bins"))


@query(
    "S16 P15",
    """SELECT l_suppkey AS file, first_scale FROM (SELECT l_suppkey, l_quantity / 10 AS first_scale,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1 AND NOT first_scale < 1""",
)
def files_to_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose first read still has a raw scale."""
    number = F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("read_number")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("file"), number, (F.col("l_quantity") / 10).alias("scale")
    )
    return shape.files_needing_repair(rows, "file", "read_number")


@query("K05", "SELECT o_orderpriority AS value FROM orders UNION ALL SELECT c_mktsegment FROM customer")
def concatenated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of several files in one folder."""
    root = work_path(spark, "parts")
    table(spark, sf_dir, "orders").select("o_orderpriority").write.text(f"{root}/a")
    table(spark, sf_dir, "customer").select("c_mktsegment").write.text(f"{root}/b")
    sinks.concat_sources(spark, [f"{root}/a", f"{root}/b"], f"{root}/all")
    return spark.read.text(f"{root}/all")


@query("K08 A24", f"WITH {COVERAGE} SELECT contig, round(coverage, 6) AS coverage, sample FROM cov")
def gathered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headerless bodies of many files under one header."""
    root = work_path(spark, "gather")
    rows = sample_coverage(spark, sf_dir, 0.0).select("contig", r6(F.col("coverage")).alias("coverage"), "sample")
    rows.withColumn("s", F.col("sample")).write.partitionBy("s").csv(f"{root}/bodies")
    schema = "contig string, coverage double, sample string"
    sinks.gather(spark, [f"{root}/bodies/s=*/*.csv"], schema, f"{root}/all")
    return tab.read_csv(spark, f"{root}/all", schema)


@query("K09", "SELECT *, true AS refused FROM nation")
def refused_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second write to the same target fails and leaves the first in place."""
    path = work_path(spark, "once")
    rows = table(spark, sf_dir, "nation")
    sinks.write_table(rows, path)
    refused = False
    try:
        sinks.write_table(rows.limit(1), path)
    except AnalysisException:
        refused = True
    back = tab.read_table(spark, path, "n_nationkey int, n_name string, n_regionkey int")
    return back.withColumn("refused", F.lit(refused))


@query(
    "S07 K04 C11 Q03",
    f"""WITH {SEQUENCES} SELECT sample || '_' || contig AS contig, sample || '_' || contig || ' from ' || sample AS description, seq, length(seq) % 60 = 0 AS whole FROM seqs""",
)
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped sequence records written and read back."""
    path = work_path(spark, "fasta")
    header = F.concat(prefixed_header(F.col("sample"), F.col("contig")), F.lit(" from "), F.col("sample"))
    sinks.write_fasta(sequences(spark, sf_dir).select(header.alias("contig"), "seq"), path)
    back = seq_io.read_fasta(spark, path)
    return back.withColumn("whole", F.length("seq") % 60 == 0)


@query(
    "Q03 S07",
    f"WITH {SEQUENCES} SELECT contig, 'mock' AS bin FROM seqs",
)
def bins_from_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contig and bin pairs from the headers of a sequence file."""
    path = work_path(spark, "fasta")
    sinks.write_fasta(sequences(spark, sf_dir).select("contig", "seq"), path)
    return sq.contig_bin_from_headers(seq_io.read_fasta(spark, path), "mock")


@query(
    "S08 Q06",
    f"""WITH {SEQUENCES} SELECT contig AS read_id, 'MM:Z:C' || chr(9) || 'ML:B:1' AS tags, coalesce(seq, '') AS seq, translate(coalesce(seq, ''), 'ACGT', '@I5~') AS qual FROM seqs""",
)
def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-line records, empty ones too, whose quality lines may start with the record mark."""
    path = work_path(spark, "fastq")
    rows = sequences(spark, sf_dir).select(
        F.col("contig").alias("read_id"),
        F.lit("MM:Z:C\tML:B:1").alias("tags"),
        "seq",
        F.translate("seq", "ACGT", "@I5~").alias("qual"),
    )
    sinks.write_fastq(rows, path)
    return seq_io.read_fastq(spark, path)


@query(
    "Q07 K04",
    f"""WITH {SEQUENCES} SELECT sample AS bin, count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS bases FROM seqs
        WHERE contig NOT IN (SELECT 'doc_' || doc_id FROM labels WHERE toxic = 1) GROUP BY 1""",
)
def cleaned_bin_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence files per bin without the flagged contigs."""
    path = work_path(spark, "bins")
    rows = sequences(spark, sf_dir)
    pairs = rows.select("contig", F.col("sample").alias("bin"))
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1")
    flagged = toxic.select(F.concat(F.lit("doc_"), text_of("doc_id")).alias("contig")).join(pairs, "contig")
    kept = sq.clean_bins(rows.select("contig", "seq"), pairs, flagged)
    sinks.write_fasta(kept, path, partition_by=["bin"])
    back = seq_io.read_fasta(spark, f"{path}/bin=*")
    back = back.join(pairs, "contig")
    return back.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases"))


@query(
    "W01 S11 N01",
    "SELECT benchmark AS sample, contig, bin FROM (SELECT l_returnflag AS benchmark, CAST(l_suppkey AS VARCHAR) AS contig, "
    "CAST(l_linenumber AS VARCHAR) AS bin, row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1",
)
def first_record_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of each contig in every sample file."""
    path = work_path(spark, "first")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("s"),
        F.col("l_suppkey").alias("contig"),
        F.col("l_linenumber").alias("bin"),
        "l_orderkey", "l_partkey",
    )
    sinks.write_table(rows, path, header=False, partition_by=["s"])
    back = tab.read_samples(
        spark, f"{path}/s=*/*.csv", "contig string, bin string, orderkey long, partkey long",
        {"sample": r"/s=([^/]+)/"}, header=False,
    )
    first = first_per_group(back, ["sample", "contig"], ["orderkey", "bin", "partkey"])
    return first.select("sample", "contig", "bin")
