"""Mixing of sources to target weights by Pareto order sampling.

A source's target is a multiple of its size between 0 and 2. The whole copies of
that multiple are certain for every document. The rest is a sample without
replacement: every document gets random odds u / (1 - u), divided by the odds of
its inclusion, and those with the smallest quotients are taken, as many as the
remaining words of the target hold.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from locigrid.llm.common import small_side, stored, text_or_empty, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
SEED = "mix"
# Rows of a source ranked together, about.
RANKED_ROWS = 1000
ORDER = ("q", "doc_id", "size")


def draw() -> Column:
    """A number in (0, 1) fixed by seed and doc_id."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(16**12))


def size_of() -> Column:
    return F.size(words(text_or_empty())).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target, whole, rest and odds of every source in ``sizes`` (source, size).

    Sources by code point, a missing one last, weigh ``weights`` in turn. With
    sources in order of limit per weight, the words left after the limits of
    those before, per weight left, rise up to the level at which no limit is
    exceeded any more and then fall: the level is their maximum, and a target
    the weight times the level or the limit. One row per source passes the
    ordered windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    whole_table = Window.partitionBy(F.lit(0))
    place = F.row_number().over(whole_table.orderBy(F.col("source").asc_nulls_last()))
    rows = per.withColumn("place", place).withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") - 1) % len(weights)))
    rows = rows.withColumn("most", most * F.col("source_size"))
    filled = whole_table.orderBy(F.col("most") / F.col("weight"), "place")
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole_table) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0))
    rows = rows.withColumn("level", left / F.sum("weight").over(after))
    rows = rows.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.max("level").over(whole_table)))
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(factor)).withColumn("chance", factor - F.col("whole"))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    odds = F.when((F.col("chance") > 0) & (F.col("chance") < 1), F.col("chance") / (1 - F.col("chance")))
    buckets = F.ceil(F.col("docs") / F.lit(RANKED_ROWS))
    return rows.select("source", "source_size", "target", "whole", rest.alias("rest"), odds.alias("odds"), buckets.alias("buckets"))


def ordered(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``rows`` (source, u and more) with the columns of their source, the ranking number q and its bucket."""
    named = per_source.withColumnRenamed("source", "__source")
    joined = rows.join(small_side(named), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    joined = joined.withColumn("q", F.col("u") / (1 - F.col("u")) / F.col("odds"))
    return joined.withColumn("bucket", F.floor(F.col("buckets") * (F.col("q") / (1 + F.col("q")))))


def choices(sizes: DataFrame) -> DataFrame:
    """Per source what decides about its documents: whole copies, the last bucket, and in it the last place and one more.

    ``sizes`` has doc_id, source, size and u. Buckets of the ranking are taken
    whole while their words fit the rest of the target. In the bucket that does
    not fit, documents are taken in order while they fit, and then that one of
    the others that comes nearest to what is still missing. Only this bucket is
    sorted. Rows repeated whole are taken together.
    """
    per = stored(targets(sizes), "targets")
    rows = ordered(sizes, per).filter("odds is not null")
    upto = Window.partitionBy("source").orderBy("bucket")
    sums = rows.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    last = sums.filter("upto > rest").groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")), "bucket").alias("x"))
    last = stored(last.select("source", F.col("x.bucket").alias("last"), F.col("x.before").alias("before")), "last")
    at = last.select(F.col("source").alias("__source"), "last", "before")
    inside = F.col("source").eqNullSafe(F.col("__source")) & (F.col("bucket") == F.col("last"))
    units = rows.join(small_side(at), inside).groupBy("source", *ORDER).agg(F.sum("size").alias("words"), F.max(F.col("rest") - F.col("before")).alias("room"))
    units = units.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy(*ORDER)))
    units = units.withColumn("fits", F.col("upto") <= F.col("room"))
    units = units.withColumn("gap", F.col("room") - F.coalesce(F.max(F.when(F.col("fits"), F.col("upto"))).over(Window.partitionBy("source")), F.lit(0)))
    key = F.struct(*ORDER)
    away = F.abs(F.col("gap") - F.col("words"))
    final = units.groupBy("source").agg(
        F.max(F.when(F.col("fits"), key)).alias("cut"),
        F.min(F.when(~F.col("fits") & (away < F.col("gap")), F.struct(away.alias("away"), *ORDER))).alias("extra"),
    )
    same = F.col("l.source").eqNullSafe(F.col("f.source"))
    more = last.alias("l").join(final.alias("f"), same, "left").select(F.col("l.source").alias("__source"), "last", "cut", "extra")
    return per.join(more, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def copies() -> Column:
    """Copies of a document, from the columns of its source's choices and its own."""
    key = F.struct(*ORDER)
    extra = F.struct(*[F.col(f"extra.{c}").alias(c) for c in ORDER])
    inside = (F.col("bucket") < F.col("last")) | ((F.col("bucket") == F.col("last")) & (F.coalesce(key <= F.col("cut"), F.lit(False)) | F.coalesce(key.eqNullSafe(extra) & F.col("extra").isNotNull(), F.lit(False))))
    # without a last bucket all documents fit the rest
    sampled = F.when(F.col("odds").isNull(), F.lit(0)).when(F.col("last").isNull(), F.lit(1)).when(inside, F.lit(1)).otherwise(F.lit(0))
    return (F.col("whole") + sampled).cast("int")


def decided(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs``.

    A missing text has size 0; a missing source is a source of its own, and
    sources of size 0 have target 0. The same rows give the same mix in every run.
    """
    sizes = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of().alias("size"), draw().alias("u")), "sizes")
    per = stored(choices(sizes), "choices")
    taken = (copies() * F.col("size")).cast("long")
    return ordered(sizes, per).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix: every row of ``docs`` as often as it is taken, with all its columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "doc_id", F.col("source").cast("string").alias("source"), size_of().alias("size"), draw().alias("u"))
    sizes = stored(rows.select("doc_id", "source", "size", "u"), "sizes")
    per = stored(choices(sizes), "choices")
    times = ordered(rows, per).withColumn("__copies", copies()).filter("__copies > 0")
    return times.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__doc.*")


SQL = f"""WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / {float(16**12)}::DOUBLE AS u FROM documents),
  p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
  w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][1 + (place - 1) % {len(WEIGHTS)}] AS weight, {MOST_COPIES} * source_size AS most FROM p),
  l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE}::DOUBLE - CAST(coalesce(sum(most) OVER (ORDER BY most / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
      / CAST(sum(weight) OVER (ORDER BY most / weight::DOUBLE, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
  t AS (SELECT source, source_size, docs, least(CAST(most AS DOUBLE), weight * max(level) OVER ()) AS target FROM l),
  f AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS factor FROM t),
  c AS (SELECT *, CAST(floor(factor) AS BIGINT) AS whole, factor - floor(factor) AS chance, target - floor(factor) * source_size AS rest, ceil(docs / {RANKED_ROWS}::DOUBLE) AS buckets FROM f),
  q AS (SELECT d.*, c.source_size, c.target, c.whole, c.rest, c.buckets, CASE WHEN chance > 0 AND chance < 1 THEN u / (1 - u) / (chance / (1 - chance)) END AS q FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
  b AS (SELECT *, floor(buckets * (q / (1 + q))) AS bucket FROM q),
  s AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size) AS upto, sum(size) OVER (PARTITION BY source ORDER BY bucket) AS bucket_upto FROM b WHERE q IS NOT NULL),
  e AS (SELECT *, upto <= rest AS fits, bucket = min(bucket) FILTER (bucket_upto > rest) OVER (PARTITION BY source) AS at_last FROM s),
  g AS (SELECT *, rest - coalesce(max(upto) FILTER (fits) OVER (PARTITION BY source), 0) AS gap FROM e),
  x AS (SELECT *, CASE WHEN at_last AND NOT fits AND abs(gap - size) < gap THEN row_number() OVER (PARTITION BY source, at_last AND NOT fits AND abs(gap - size) < gap ORDER BY abs(gap - size), q, doc_id, size) END AS pick FROM g),
  n AS (SELECT doc_id, size, source_size, target, whole * size + CASE WHEN fits OR coalesce(pick = 1, false) THEN size ELSE 0 END AS taken FROM x
    UNION ALL SELECT doc_id, size, source_size, target, whole * size FROM b WHERE q IS NULL)
  SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM n"""
