"""Readers of delimited, JSON and interval files. Schemas are given, never
inferred, and NaN becomes NULL at the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locigrid.operators.shape import nan_to_null

SchemaLike = str | T.StructType

# Columns of the headerless file kinds, in file order.
CONTIG_BIN = "contig string, bin string"
BEDGRAPH = "contig string, start long, end long, depth double"
LENGTHS = "length long"
READ_SUMMARY = "bases long, reads long"


def _struct(schema: SchemaLike) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: SchemaLike,
    sep: str = "\t",
    header: bool = True,
    by_name: bool = False,
) -> DataFrame:
    """Delimited text with a given schema.

    With a header the names must agree with the schema, or reading fails. With
    ``by_name`` the file may hold its columns in any order and more of them;
    only the header line is read to find them.
    """
    wanted = _struct(schema)
    reader = spark.read.option("sep", sep).option("header", header)
    if by_name:
        text = reader.csv(path)
        df = text.select(
            *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted.fields]
        )
    else:
        df = reader.schema(wanted).option("enforceSchema", not header).csv(path)
    return nan_to_null(df)


def read_headerless(
    spark: SparkSession, path: str | Sequence[str], schema: SchemaLike, sep: str = "\t"
) -> DataFrame:
    """Columns by position, named and typed by the schema."""
    return read_table(spark, path, schema, sep, header=False)


def read_strings(
    spark: SparkSession, path: str | Sequence[str], names: Sequence[str], sep: str = "\t"
) -> DataFrame:
    """Every column as text, so that files with differing types unify."""
    return read_table(spark, path, ", ".join(f"`{n}` string" for n in names), sep)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: SchemaLike) -> DataFrame:
    return read_table(spark, path, schema, ",")


def read_json_summary(
    spark: SparkSession, path: str | Sequence[str], id_pattern: str, schema: SchemaLike = READ_SUMMARY
) -> DataFrame:
    """One JSON object per file; the first group of ``id_pattern`` in the file
    path is the id."""
    df = spark.read.schema(_struct(schema)).option("multiLine", True).json(path)
    found = F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1)
    return df.select(found.alias("id"), *df.columns)


def read_lengths(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return read_headerless(spark, path, LENGTHS)


def read_bedgraph(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return read_headerless(spark, path, BEDGRAPH)


def contigs_from_sam_header(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Contigs as intervals from the ``@SQ`` lines of an alignment header."""
    fields = F.split("value", "\t")
    name = F.get(F.split(F.get(fields, F.lit(1)), ":", 2), F.lit(1))
    length = F.get(F.split(F.get(fields, F.lit(2)), ":", 2), F.lit(1))
    lines = spark.read.text(path).filter(F.col("value").startswith("@SQ"))
    return lines.select(
        name.alias("contig"), F.lit(0).cast("long").alias("start"), length.cast("long").alias("end")
    )


def read_samples(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: SchemaLike,
    tags: dict[str, str],
    sep: str = "\t",
    header: bool = True,
) -> DataFrame:
    """All files of a glob in one scan. Each tag column is the first group of
    its pattern in the file path."""
    wanted = _struct(schema)
    reader = spark.read.option("sep", sep).option("header", header).schema(wanted)
    df = reader.option("enforceSchema", not header).csv(path)
    found = [F.regexp_extract(F.col("_metadata.file_path"), p, 1).alias(n) for n, p in tags.items()]
    return nan_to_null(df.select(*found, *wanted.names))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names at least one file or folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(target)
    return found is not None and len(found) > 0


def read_or_empty(
    spark: SparkSession, path: str, schema: SchemaLike, sep: str = "\t", header: bool = True
) -> DataFrame:
    """The table, or an empty one of the same schema when there is no file."""
    if path_exists(spark, path):
        return read_table(spark, path, schema, sep, header)
    return spark.createDataFrame([], _struct(schema))


def discover(
    spark: SparkSession, path: str, pattern: str, names: Sequence[str], markers: Sequence[str] = ()
) -> DataFrame:
    """Files of a glob with the groups of ``pattern`` as columns; entries whose
    last column is a marker are dropped. Only the listing is read."""
    files = spark.read.format("binaryFile").load(path).select("path")
    groups = [F.regexp_extract("path", pattern, i).alias(n) for i, n in enumerate(names, start=1)]
    found = files.filter(F.col("path").rlike(pattern)).select(*groups, "path").distinct()
    return found.filter(~F.col(names[-1]).isin(list(markers))) if markers else found


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: SchemaLike) -> DataFrame:
    """A small fixed table, such as a manifest or a label template."""
    return spark.createDataFrame(list(rows), _struct(schema))
