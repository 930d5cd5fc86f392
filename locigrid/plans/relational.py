"""Projections, filters, joins, unions and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locigrid.functions import numeric as num
from locigrid.functions import text as txt
from locigrid.operators import joins, scans, shape
from locigrid.operators.aggregate import with_group_stats
from locigrid.plans.catalog import query
from locigrid.plans.standins import (
    CONTIG_BIN,
    SCORED,
    contig_bin,
    exact_mean,
    exact_mean_sql,
    hash_share,
    hash_share_sql,
    minute,
    r6,
    scored,
    table,
    text_of,
)


@query(
    "P01 P20",
    "SELECT s_suppkey AS contig, s_name AS title, s_nationkey AS bin, s_acctbal AS score FROM supplier",
)
def rename_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rename by position, then by name."""
    df = shape.rename_positions(table(spark, sf_dir, "supplier"), {1: "contig", 3: "bin", 4: "score"})
    return df.withColumnsRenamed({"s_name": "title"})


@query("P02 P03", "SELECT p_name, p_brand, p_type FROM part")
def column_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns between two names, then one dropped."""
    ranged = shape.select_range(table(spark, sf_dir, "part"), "p_name", "p_size")
    return ranged.drop("p_size")


@query("P04", "SELECT p_partkey, p_brand || '_' || p_type || '_' || CAST(p_size AS VARCHAR) AS motif_mod, "
       "p_brand || '_' || p_type || '-' || CAST(p_size AS VARCHAR) AS motif_mod_dash FROM part")
def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (F.col("p_brand"), F.col("p_type"), F.col("p_size"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        txt.motif_key(*parts).alias("motif_mod"),
        txt.motif_key(*parts, sep="-").alias("motif_mod_dash"),
    )


@query(
    "P05",
    "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS bin, CAST(trunc(c_acctbal) AS INTEGER) AS whole, "
    "TRY_CAST(substr(c_name, 10) AS BIGINT) AS number, TRY_CAST(c_mktsegment AS BIGINT) AS bad, "
    "CAST(c_acctbal > 0 AS TINYINT) AS flag FROM customer",
)
def type_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casts, with dirty text turning into NULL."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_nationkey").cast("string").alias("bin"),
        F.col("c_acctbal").cast("int").alias("whole"),
        F.substring("c_name", 10, 1000).try_cast("long").alias("number"),
        F.col("c_mktsegment").try_cast("long").alias("bad"),
        (F.col("c_acctbal") > 0).cast("byte").alias("flag"),
    )


@query(
    "J02 P06",
    "SELECT d.doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, -1) AS toxic "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def fill_after_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join, missing cells filled."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    joined = joins.keyed_left(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    return shape.fill_missing(joined, {"quality": 0, "toxic": -1})


@query(
    "P07 J02",
    """SELECT d.doc_id, CASE WHEN quality = 1 THEN 'good' WHEN toxic = 1 THEN 'toxic'
         WHEN quality IS NULL THEN 'unknown' ELSE 'poor' END AS grade
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def ordered_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first true condition wins; a NULL condition falls through."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    joined = joins.keyed_left(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    grade = (
        F.when(F.col("quality") == 1, "good")
        .when(F.col("toxic") == 1, "toxic")
        .when(F.col("quality").isNull(), "unknown")
        .otherwise("poor")
    )
    return joined.select("doc_id", grade.alias("grade"))


@query(
    "P08 P17",
    f"WITH {SCORED} SELECT * FROM scored WHERE mean_read_cov > 2 AND n_motif_obs * mean_read_cov >= 40",
)
def evidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations times coverage at or over a limit, with a coverage floor."""
    return shape.min_evidence(scored(spark, sf_dir), 40, 2)


@query(
    "P17",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem "
    "WHERE (l_extendedprice > 20000 AND l_quantity > 10)",
)
def size_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape.size_window(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", 20_000, 10)
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("P09", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def membership_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return shape.where_in(rows, "o_orderpriority", ["1-URGENT", "5-LOW"])


@query(
    "P10",
    """SELECT doc_id, ratio FROM (SELECT d.doc_id, CASE WHEN quality IS NULL THEN NULL
         WHEN quality + toxic = 0 THEN NULL ELSE CAST(quality AS DOUBLE) / (quality + toxic) END AS ratio
         FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE ratio IS NOT NULL""",
)
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL and NaN are both missing."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    joined = joins.keyed_left(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    whole = F.col("quality") + F.col("toxic")
    ratio = F.when(whole == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.col("quality"), whole))
    return shape.present(joined.select("doc_id", ratio.alias("ratio")), "ratio")


@query(
    "P11",
    "SELECT p_partkey, round((p_size - 1.0::DOUBLE) / (50.0::DOUBLE - 1.0::DOUBLE), 6) AS scaled, "
    "round(p_retailprice, 6) AS unit FROM part",
)
def rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min-max rescale with fixed limits; 0 and 1 leave the value as it is."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        r6(num.rescale(F.col("p_size"), 1.0, 50.0)).alias("scaled"),
        r6(num.rescale(F.col("p_retailprice"))).alias("unit"),
    )


@query(
    "P12",
    """SELECT p_partkey, CASE WHEN p_retailprice / 20 >= 90 AND p_size < 5 THEN 'HQ'
         WHEN p_retailprice / 20 >= 50 AND p_size < 10 THEN 'MQ' ELSE 'LQ' END AS mag_qual FROM part""",
)
def quality_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = num.quality_tier(F.col("p_retailprice") / 20, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", tier.alias("mag_qual"))


@query(
    "P13",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (CAST(l_orderkey AS BIGINT) & 2308) = 0 "
    "AND CAST(l_quantity AS INTEGER) >= 30",
)
def alignment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an excluded flag bit and with enough mapping quality."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.col("l_orderkey").alias("flag"), F.col("l_quantity").cast("int").alias("mapq"),
    )
    return shape.filter_alignments(rows).select("l_orderkey", "l_linenumber")


@query(
    "P14 T01",
    "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'ring|bolt|PROMO') "
    "OR regexp_matches(p_type, 'ring|bolt|PROMO') ORDER BY 1",
)
def label_pattern_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape.keep_labels(table(spark, sf_dir, "part"), ["p_name", "p_type"], ["ring", "bolt", "PROMO"])
    return rows.select("p_partkey", "p_name").orderBy("p_partkey")


@query(
    "P15 F03",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN s < 1 THEN s ELSE s / nullif(l_tax * 100, 0) END, 6) AS scale
       FROM (SELECT *, l_quantity / 10 AS s FROM lineitem)""",
)
def scale_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales of 1 or more are divided by the digitisation."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_quantity") / 10).alias("scale"), (F.col("l_tax") * 100).alias("digitisation"),
    )
    fixed = shape.repair_scale(rows).drop("digitisation")
    return fixed.withColumn("scale", r6(F.col("scale")))


@query(
    "P18 T04",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2
         WHEN '5-LOW' THEN 3 END AS place FROM orders ORDER BY place DESC NULLS LAST""",
)
def ordered_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit level order; unlisted values are NULL and sort last, here reversed."""
    levels = ["3-MEDIUM", "1-URGENT", "5-LOW"]
    rows = shape.with_order(table(spark, sf_dir, "orders"), "o_orderpriority", levels, "place")
    return shape.sort_by_levels(rows, "o_orderpriority", levels, reverse=True).select("o_orderkey", "place")


@query(
    "P19 J07",
    "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') "
    "AS included FROM customer",
)
def membership_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    ids = ids.select(F.col("o_custkey").alias("c_custkey"))
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    return shape.flag_members(rows, ids, ["c_custkey"], "included")


@query("C12 P20", "SELECT s_suppkey AS supp_key, s_name AS supplier_name, s_nationkey AS nation_key_2 FROM supplier")
def snake_case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("SuppKey"),
        F.col("s_name").alias("Supplier Name"),
        F.col("s_nationkey").alias("nation.Key (2)"),
    )
    return shape.clean_names(raw)


@query(
    "J01",
    """SELECT n.n_nationkey, n.n_name, n.n_regionkey AS regionkey, r.r_name
       FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""",
)
def natural_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join on all shared column names."""
    nation = table(spark, sf_dir, "nation").withColumnsRenamed({"n_regionkey": "regionkey"})
    region = table(spark, sf_dir, "region").withColumnsRenamed({"r_regionkey": "regionkey"})
    return joins.natural_left(nation, region)


@query(
    "J03",
    """SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey""",
)
def inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey")
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = joins.inner(joins.inner(orders, customer, ["c_custkey"]), nation, ["n_nationkey"])
    return joined.select("o_orderkey", "c_name", "n_name")


@query(
    "J04 S15",
    """WITH t(o_orderstatus, label) AS (VALUES ('F', 'filled'), ('O', 'open'), ('P', 'part'), ('X', 'none'))
       SELECT t.o_orderstatus, label, count(o_orderkey) AS n FROM t
       LEFT JOIN orders o ON o.o_orderstatus = t.o_orderstatus GROUP BY 1, 2""",
)
def template_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every template row appears, with 0 where there is no data."""
    rows = [("F", "filled"), ("O", "open"), ("P", "part"), ("X", "none")]
    template = spark.createDataFrame(rows, "o_orderstatus string, label string")
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return joins.complete_to(counts, template, ["o_orderstatus"], {"n": 0})


@query(
    "J05",
    "SELECT s_suppkey, p_brand FROM supplier, (SELECT DISTINCT p_brand FROM part)",
)
def value_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contig with every feature name."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey")
    return joins.pair_with_values(rows, table(spark, sf_dir, "part").select("p_brand"))


@query(
    "J06 P06",
    f"""WITH {SCORED}, d AS (SELECT contig, motif, mod_type, count(*) AS n FROM scored
          WHERE mean_read_cov > 2 GROUP BY 1, 2, 3),
        g AS (SELECT * FROM (SELECT DISTINCT contig FROM scored), (SELECT DISTINCT motif FROM scored),
          (SELECT DISTINCT mod_type FROM scored))
        SELECT contig, motif, mod_type, coalesce(n, 0) AS n FROM g LEFT JOIN d USING (contig, motif, mod_type)""",
)
def densified_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of three dimensions, empty cells 0."""
    rows = scored(spark, sf_dir)
    data = rows.filter("mean_read_cov > 2").groupBy("contig", "motif", "mod_type")
    dims = [rows.select(c) for c in ("contig", "motif", "mod_type")]
    return joins.densify(data.agg(F.count("*").alias("n")), dims, {"n": 0})


@query(
    "J06 J05 A03",
    f"""WITH {SCORED}, d AS (SELECT contig, motif, mod_type, count(*) AS n FROM scored WHERE mean_read_cov > 2 GROUP BY 1, 2, 3),
        g AS (SELECT * FROM (SELECT DISTINCT contig FROM scored), (SELECT DISTINCT motif FROM scored), (SELECT DISTINCT mod_type FROM scored))
        SELECT contig, count(*) AS cells, count(n) AS filled, CAST(sum(coalesce(n, 0)) AS DOUBLE) AS total, round(avg(coalesce(n, 0)), 9) AS mean,
          CAST(min(coalesce(n, 0)) AS DOUBLE) AS least, CAST(max(coalesce(n, 0)) AS DOUBLE) AS most FROM g LEFT JOIN d USING (contig, motif, mod_type) GROUP BY 1""",
)
def grid_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary by contig over all combinations of three dimensions, which are counted and never built."""
    rows = scored(spark, sf_dir)
    data = rows.filter("mean_read_cov > 2").groupBy("contig", "motif", "mod_type").agg(F.count("*").alias("n"))
    dims = {c: rows.select(c) for c in ("contig", "motif", "mod_type")}
    return joins.grid_summary(data, dims, "contig", "n").withColumn("mean", F.round("mean", 9))


@query(
    "J07",
    "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return joins.semi(table(spark, sf_dir, "documents").select("doc_id", "lang"), ids, ["doc_id"])


@query(
    "J08",
    """SELECT d.doc_id, d.lang FROM documents d
       WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""",
)
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return joins.anti(table(spark, sf_dir, "documents").select("doc_id", "lang"), ids, ["doc_id"])


@query(
    "J09 A04",
    """SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_quantity FROM (SELECT *,
         max(l_quantity) OVER (PARTITION BY l_suppkey, l_returnflag) AS m FROM lineitem) WHERE l_quantity = m""",
)
def argmax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that hold the maximum of their group, ties kept."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_quantity"
    )
    return joins.argmax_join(rows, ["l_suppkey", "l_returnflag"], "l_quantity")


@query(
    "J10 W02",
    """WITH a AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer),
         b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
       SELECT a.rank, c_custkey, c_acctbal, o_orderkey FROM a JOIN b ON a.rank = b.rank""",
)
def rank_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th largest of one table beside the i-th largest of another."""
    a = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    b = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return joins.zip_by_rank(
        a, [F.desc("c_acctbal"), "c_custkey"], b, [F.desc("o_totalprice"), "o_orderkey"], "rank"
    ).drop("o_totalprice")


@query(
    "J12",
    f"""WITH o AS (SELECT CAST(user_id AS VARCHAR) AS contig, CAST(floor(epoch(ts) / 60) AS BIGINT) - 28401120 AS start,
             CASE WHEN {hash_share_sql("strand", "event_id")} < 0.5 THEN '+' ELSE '-' END AS strand,
             'GATC' AS motif, 'a' AS mod_type, 1 AS mod_position FROM events WHERE event_type = 'click'),
         p AS (SELECT CAST(user_id AS VARCHAR) AS contig, CAST(floor(epoch(ts) / 60) AS BIGINT) - 28401120 + 1 AS pos,
             CASE WHEN {hash_share_sql("side", "event_id")} < 0.5 THEN '+' ELSE '-' END AS strand,
             'a' AS mod_type, value FROM events)
        SELECT contig, pos, strand, mod_type, motif, mod_position, value FROM
          (SELECT *, CASE WHEN strand = '+' THEN start + 1 ELSE start + 2 END AS pos FROM o) JOIN p USING (contig, pos, strand, mod_type)""",
)
def motif_pileup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pileup rows on the modified base of a motif occurrence."""
    events = table(spark, sf_dir, "events")
    side = lambda seed: F.when(hash_share(seed, "event_id") < 0.5, "+").otherwise("-")
    occurrences = events.filter("event_type = 'click'").select(
        text_of("user_id").alias("contig"), minute().alias("start"), side("strand").alias("strand"),
        F.lit("GATC").alias("motif"), F.lit("a").alias("mod_type"), F.lit(1).alias("mod_position"),
    )
    pileup = events.select(
        text_of("user_id").alias("contig"), (minute() + 1).alias("pos"), side("side").alias("strand"),
        F.lit("a").alias("mod_type"), "value",
    )
    return joins.motif_pileup(occurrences, pileup)


@query(
    "J13",
    """SELECT l_orderkey, l_linenumber, CASE mod WHEN 'a' THEN 'm6' WHEN 'm' THEN 'm5' WHEN '21839' THEN 'm4' END AS pretty
       FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'R' THEN 'm' ELSE
         CASE l_linestatus WHEN 'O' THEN '21839' ELSE 'h' END END AS mod FROM lineitem)""",
)
def mod_type_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of a fixed map, NULL for an unknown key."""
    code = (
        F.when(F.col("l_returnflag") == "A", "a")
        .when(F.col("l_returnflag") == "R", "m")
        .otherwise(F.when(F.col("l_linestatus") == "O", "21839").otherwise("h"))
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", txt.mod_name(code).alias("pretty")
    )


@query(
    "J14",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side
       FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN
         (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') b ON a.k = b.k
       WHERE a.k IS NULL OR b.k IS NULL""",
)
def key_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys found on one side only; the assertion fails when there are any."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return joins.unmatched_keys(a, b, ["k"])


@query("J14", "SELECT l_orderkey, l_linenumber FROM lineitem")
def key_set_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows pass when two tables hold the same key set."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    again = table(spark, sf_dir, "lineitem").select("l_returnflag")
    return joins.assert_same_keys(rows, again, ["l_returnflag"]).drop("l_returnflag")


@query(
    "U01",
    "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment "
    "FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer",
)
def loose_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union by name, columns missing on a side become NULL."""
    a = table(spark, sf_dir, "supplier").selectExpr("s_suppkey id", "s_name name", "s_acctbal balance")
    b = table(spark, sf_dir, "customer").selectExpr("c_custkey id", "c_mktsegment segment", "c_name name")
    return shape.union_loose(a, b)


@query("U02", "SELECT s_suppkey AS id FROM supplier UNION ALL SELECT c_custkey FROM customer")
def strict_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").selectExpr("s_suppkey id")
    return shape.union_strict(a, table(spark, sf_dir, "customer").selectExpr("c_custkey id"))


@query("U03", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey k")
    b = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").selectExpr("o_custkey k")
    return shape.difference(a, b, ["k"])


@query(
    "U04",
    """SELECT s_nationkey AS bin, s_name AS name FROM supplier WHERE s_nationkey NOT IN
         (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)
       UNION ALL SELECT c_nationkey, c_name FROM customer WHERE c_nationkey IN
         (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)""",
)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one table for the chosen keys and of another for the rest."""
    a = table(spark, sf_dir, "supplier").selectExpr("s_nationkey bin", "s_name name")
    b = table(spark, sf_dir, "customer").selectExpr("c_nationkey bin", "c_name name")
    chosen = table(spark, sf_dir, "nation").filter("n_regionkey < 2").selectExpr("n_nationkey bin")
    return shape.mix_by_key(a, b, chosen, ["bin"])


@query(
    "U05",
    f"WITH {CONTIG_BIN} SELECT * FROM contig_bin UNION ALL SELECT 'contamination_' || contig, bin FROM contig_bin",
)
def shadow_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row twice, once under a prefixed id."""
    return shape.with_shadow_copy(contig_bin(spark, sf_dir), "contig")


@query(
    "U06 P20",
    "SELECT c_name AS name, c_acctbal AS completeness FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier",
)
def variant_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of tables that name the same columns differently."""
    a = table(spark, sf_dir, "customer").select("c_name", "c_acctbal")
    b = table(spark, sf_dir, "supplier").select("s_name", "s_acctbal")
    names = [{"c_name": "name", "c_acctbal": "completeness"}, {"s_name": "name", "s_acctbal": "completeness"}]
    return shape.union_variants(list(zip([a, b], names)))


@query("U07 A09", "SELECT DISTINCT p_brand AS motif FROM part")
def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.unique_values(table(spark, sf_dir, "part").selectExpr("p_brand motif"), "motif")


@query("T01", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem ORDER BY 1, 2, 3")
def multi_key_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return rows.orderBy("l_suppkey", "l_orderkey", "l_linenumber")


@query(
    "T02 T03",
    f"""WITH {SCORED} SELECT motif, {exact_mean_sql("median")} AS mean FROM scored GROUP BY motif
        ORDER BY mean DESC, motif LIMIT 10""",
)
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten features with the highest mean."""
    means = scored(spark, sf_dir).groupBy("motif").agg(exact_mean("median").alias("mean"))
    return means.orderBy(F.desc("mean"), "motif").limit(10)


@query(
    "T03",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER
         (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 5""",
)
def top_rows_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"]
    return scans.top_k(rows, ["l_suppkey"], order, 5)


@query("T05", "SELECT CAST(user_id AS VARCHAR) AS contig, CAST(floor(epoch(ts) / 60) AS BIGINT) - 28401120 AS pos, event_id FROM events")
def coordinate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range-partitioned by contig and position, sorted inside the partitions."""
    rows = table(spark, sf_dir, "events").select(text_of("user_id").alias("contig"), minute().alias("pos"), "event_id")
    return shape.coordinate_sort(rows, ["contig", "pos"])


@query(
    "J02 A03 P10",
    f"""SELECT n_name, count(*) AS n, {exact_mean_sql('s_acctbal')} AS mean, round(max(s_acctbal - m), 6) AS over_mean FROM (
         SELECT *, avg(s_acctbal) OVER (PARTITION BY s_nationkey) AS m FROM supplier) JOIN nation ON s_nationkey = n_nationkey
       GROUP BY n_name""",
)
def group_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group statistics joined back to the rows."""
    rows = with_group_stats(table(spark, sf_dir, "supplier"), ["s_nationkey"], m=F.avg("s_acctbal"))
    nation = table(spark, sf_dir, "nation").selectExpr("n_nationkey s_nationkey", "n_name")
    return rows.join(nation, "s_nationkey").groupBy("n_name").agg(
        F.count("*").alias("n"),
        exact_mean("s_acctbal").alias("mean"),
        r6(F.max(F.col("s_acctbal") - F.col("m"))).alias("over_mean"),
    )
