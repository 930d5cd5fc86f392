"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a summary table that may be sent to every task. Summaries hold a key
# and a few numbers, so this is some tens of megabytes.
BROADCAST_ROWS = 500_000

# Runtime settings the plans rely on; a value the cluster already sets wins.
RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """Folder shared by all executors, taken from ``spark.checkpoint.dir``.

    Only a local master, where one machine is the whole cluster, may fall back
    to a folder of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="locigrid-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder, so that lost executors do
    not force a recomputation and every reader sees the same rows."""
    work_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back; for tables that are joined with themselves."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """A summary table, written once and counted, as the right side of a join.

    Up to ``max_rows`` it is broadcast, so the large side stays where it is. The
    planner cannot know this in time: it learns the size of a summary while the
    large side is already being shuffled. A larger summary joins by shuffle.
    """
    written = cut_lineage(df)
    limit = BROADCAST_ROWS if max_rows is None else max_rows
    return F.broadcast(written) if written.count() <= limit else written
