"""Ordered scans: first rows, ranks, fill-down, runs, budgets, nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locigrid.operators import aggregate as agg
from locigrid.operators import scans, shape
from locigrid.plans.catalog import query
from locigrid.plans.standins import exact_mean, exact_mean_sql, minute, table, text_of


@query(
    "W01",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n
         FROM orders) WHERE n = 1""",
)
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each group by an explicit order."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return scans.first_per_group(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "W02",
    "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders",
)
def global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of all rows, without a window over a single partition."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return scans.rank_in_group(rows, [], [F.desc("o_totalprice"), "o_orderkey"], "rank")


@query(
    "W02",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem""",
)
def rank_in_large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank inside three groups that each hold about a third of the rows."""
    rest = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", *rest)
    return scans.rank_in_group(rows, ["l_returnflag"], ["l_extendedprice", *rest], "rank")


@query(
    "W03",
    """SELECT user_id, event_type, n FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS m FROM
         (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE n = m""",
)
def top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent class per group, ties kept."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return agg.keep_max(counts, ["user_id"], "n")


@query(
    "W04",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER
         (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations""",
)
def filled_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last known value carried forward."""
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", F.length("text").cast("long")).alias("n")
    )
    return scans.fill_down(rows, ["conv_id"], ["turn"], "n", "last_user").drop("n")


@query(
    "W05",
    """SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM lineitem WHERE (l_suppkey, l_partkey) IN
         (SELECT (l_suppkey, l_partkey) FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(DISTINCT l_returnflag) = 2)""",
)
def groups_with_two_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the groups with exactly two distinct values."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_returnflag")
    return agg.groups_with_n_distinct(rows, ["l_suppkey", "l_partkey"], "l_returnflag", 2).drop("l_returnflag")


@query(
    "W06",
    """WITH s AS (SELECT DISTINCT l_suppkey, l_partkey AS start, l_partkey AS "end" FROM lineitem),
         f AS (SELECT *, CASE WHEN lag("end") OVER w + 1 = start THEN 0 ELSE 1 END AS b FROM s WINDOW w AS (PARTITION BY l_suppkey ORDER BY start)),
         r AS (SELECT *, CAST(sum(b) OVER (PARTITION BY l_suppkey ORDER BY start) AS BIGINT) AS run FROM f)
       SELECT l_suppkey, start, "end", run, row_number() OVER (PARTITION BY l_suppkey, run ORDER BY start) AS place FROM r""",
)
def runs_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of rows in which each starts right after the one before."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_partkey AS start", "l_partkey AS `end`")
    return scans.consecutive_runs(rows.distinct(), ["l_suppkey"], "start", "end")


@query(
    "W07",
    """WITH h AS (SELECT *, md5('5|' || CAST(doc_id AS VARCHAR)) AS h FROM documents)
       SELECT doc_id, source, n_chars FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY h, doc_id) AS upto FROM h) WHERE upto - n_chars < 30000""",
)
def rows_up_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest prefix in shuffled order whose sum reaches a budget."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    rows = rows.withColumn("h", scans.seeded_hash(5, F.col("doc_id")))
    kept = scans.take_until(
        rows, ["source"], ["h", "doc_id"], F.col("n_chars"), F.lit(30_000), scans.hash_digits(F.col("h"))
    )
    return kept.drop("h")


@query(
    "W07 W02",
    """SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events""",
)
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running total per group."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    scan = scans.OrderedScan(rows, ["user_id"], ["ts", "event_id"]).running_sum(F.col("value"), "total")
    return scan.result().select("event_id", "user_id", F.round("total", 4).alias("total"))


@query(
    "W09",
    """SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n = 3""",
)
def third_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return scans.nth_row(rows, ["source"], ["doc_id"], 3)


@query(
    "N01 N02 N03 N04",
    """SELECT s_nationkey, s_suppkey, s_acctbal, n FROM supplier JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) USING (s_nationkey)""",
)
def nested_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows nested per key and unnested again, with the nested size."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    cells = shape.nested_size(shape.nest(rows, ["s_nationkey"], ["s_suppkey"]), "rows", "n")
    return shape.unnest(cells.drop("part"), "rows").select("s_nationkey", "s_suppkey", "s_acctbal", "n")


@query(
    "N04 N02",
    """WITH c AS (SELECT source, CAST(ceil(count(*) / 20.0) AS INTEGER) AS parts, count(*) AS n FROM documents GROUP BY 1)
       SELECT source, parts AS max_parts, n AS contigs FROM c""",
)
def bin_to_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contig lists per bin in parts of bounded size; here their count and total."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id")
    cells = shape.nest(rows, ["source"], ["doc_id"], rows_per_cell=20)
    return cells.groupBy("source").agg(
        F.ceil(F.sum(F.size("rows")) / 20).cast("int").alias("max_parts"),
        F.sum(F.size("rows")).alias("contigs"),
    )


@query(
    "N05",
    """SELECT conv_id, string_agg(upper(substr(role, 1, 1)) || CAST(length(text) AS VARCHAR), '' ORDER BY turn) AS joined FROM conversations GROUP BY 1""",
)
def ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of a group joined in order."""
    rows = table(spark, sf_dir, "conversations")
    mark = F.concat(F.upper(F.substring("role", 1, 1)), F.length("text").cast("string"))
    items = F.sort_array(F.collect_list(F.struct("turn", mark.alias("s"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(items, lambda x: x["s"]), "").alias("joined"))


PART = 24


@query(
    "N05 W07",
    f"""WITH c AS (SELECT conv_id, turn, upper(substr(role, 1, 1)) || CAST(length(text) AS VARCHAR) AS s FROM conversations),
          p AS (SELECT *, CAST(coalesce(sum(length(s)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {PART} AS BIGINT) AS part FROM c)
        SELECT conv_id, part, string_agg(s, '' ORDER BY turn) AS joined FROM p GROUP BY 1, 2""",
)
def ordered_text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of a group joined in order, in numbered parts of bounded size."""
    rows = table(spark, sf_dir, "conversations")
    mark = F.concat(F.upper(F.substring("role", 1, 1)), F.length("text").cast("string"))
    return shape.ordered_text(rows.select("conv_id", "turn", mark.alias("s")), ["conv_id"], ["turn"], "s", PART)


@query(
    "W05 W01 A16",
    f"""SELECT CAST(user_id AS VARCHAR) AS contig, count(DISTINCT event_type) AS types, min(CAST(floor(epoch(ts) / 60) AS BIGINT) - 28401120) AS first,
         {exact_mean_sql('value')} AS mean FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 5""",
)
def complete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of the groups in which every class occurs."""
    rows = table(spark, sf_dir, "events").select(
        text_of("user_id").alias("contig"), "event_type", minute().alias("at"), "value"
    )
    kept = agg.groups_with_n_distinct(rows, ["contig"], "event_type", 5)
    return kept.groupBy("contig").agg(
        F.count_distinct("event_type").alias("types"), F.min("at").alias("first"), exact_mean("value").alias("mean")
    )
