"""Columns and small helpers the operators of this folder share."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from locigrid.session import work_path

# A word is a run of characters that are not one of these six.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def key_crc(column: str = "doc_id") -> Column:
    """crc32 of a key as text; a missing key counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def share_of(seed: str, *columns: Column) -> Column:
    """A number in [0, 1) drawn from the values of ``columns``, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def binary_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lost executors cost no recomputation."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salts(df: DataFrame, rows_each: int, least: int = 64) -> int:
    """Into how many even parts to deal ``df`` so that none holds many more than ``rows_each`` rows."""
    return max(least, -(-df.count() // rows_each))


# Rows of a small table, one per source or group, that every task may get.
SMALL_ROWS = 100_000


def small_side(df: DataFrame) -> DataFrame:
    """A written table as the right side of a join: broadcast while its counted rows are few, else joined by shuffle."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df
