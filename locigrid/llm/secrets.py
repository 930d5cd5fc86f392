"""Secret scans over a ledger of content-addressed text.

Every version of a file is a blob, known by the SHA-256 of its bytes; paths point
to blobs. The ledger holds one row per blob and rule version that was scanned,
with what was found. A run scans only pairs the ledger does not have, each blob
once however many paths hold it, and joins the findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from locigrid.llm.common import stored, text_or_empty
from locigrid.session import work_path

RULE_VERSION = "base-1"
LEDGER = "blob string, version string, spans array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern, and the least length a group of it must have. Matches do not overlap; shorter ones are passed over."""

    kind: str
    pattern: str
    group: int
    least: int


# The base patterns. A run of hex digits, or of capitals after the
# mark, always matches to its end, so its least length stands in the pattern.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MASK = "[secret]"


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Spans (start, kind, end) in code points, end exclusive, by the text between the matches and the matches."""
    between = F.transform(F.split(text, rule.pattern), lambda s: F.length(s))
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda s: F.length(s))
    tested = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda s: F.length(s)) if rule.group else whole
    each = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("size"), tested.alias("tested"))

    def spans(matches: Column) -> Column:
        # in blocks: where a block begins is summed over blocks, where a match begins inside its block
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK)), lambda k: F.slice(matches, (k * BLOCK + 1).cast("int"), F.lit(BLOCK)))
        widths = F.transform(blocks, lambda m: F.aggregate(m, F.lit(0), lambda acc, x: acc + x["gap"] + x["size"]))
        starts = _starts(widths)
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("m"), starts.alias("at")), lambda x: _in_block(x["m"], x["at"])))

    def _in_block(matches: Column, begin: Column) -> Column:
        at = _starts(F.transform(matches, lambda x: x["gap"] + x["size"]))
        placed = F.filter(F.arrays_zip(matches.alias("m"), at.alias("at")), lambda x: x["m"]["tested"] >= rule.least)

        def span(x: Column) -> Column:
            start = begin + x["at"] + x["m"]["gap"]
            return F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + x["m"]["size"]).alias("end"))

        return F.transform(placed, span)

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    # without a match there is nothing to add up
    # the list is bound to a name by way of a list of one, or it would be made again for every block
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), F.flatten(F.transform(F.array(each), spans))).otherwise(none)


# Matches whose places are summed together; a list is copied for every match of a block.
BLOCK = 256


def _starts(widths: Column) -> Column:
    """Where each of ``widths`` begins if they stand in a row."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda s, w: F.struct((s["at"] + w).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts"))
    return F.aggregate(widths, zero, step, lambda s: s["starts"])


def scan(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``texts`` (text and more) with the column spans, in order of start and kind, in place of the text."""
    rest = [c for c in texts.columns if c != "text"]
    found = [spans_of(F.col("text"), rule, k).alias(f"__{k}") for k, rule in enumerate(rules)]
    each = texts.select(*rest, *found)
    return each.select(*rest, F.array_sort(F.concat(*[F.col(f"__{k}") for k in range(len(rules))])).alias("spans"))


def paths_of(docs: DataFrame) -> DataFrame:
    """doc_id and blob of every row."""
    return docs.select(F.col("doc_id"), F.sha2(text_or_empty(), 256).alias("blob"))


def update_ledger(docs: DataFrame, ledger: str, version: str = RULE_VERSION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the blobs of ``docs`` the ledger lacks under ``version``, append them, and return the ledger's rows of the version.

    The ledger is a folder of Parquet, created when missing. An append is
    visible when its job commits; a run that fails before leaves nothing.
    """
    spark = docs.sparkSession
    seen = spark.createDataFrame([], LEDGER)
    seen.write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("version") == version)
    heads = paths_of(docs).groupBy("blob").agg(F.min("doc_id").alias("head"))
    unseen = heads.join(known.select("blob").distinct(), "blob", "left_anti")
    texts = docs.select(F.col("doc_id").alias("head"), F.sha2(text_or_empty(), 256).alias("blob"), text_or_empty().alias("text"))
    one = (texts["blob"] == unseen["blob"]) & texts["head"].eqNullSafe(unseen["head"])
    # rows repeated whole are scanned again and counted once
    found = scan(texts.join(unseen.hint("shuffle_hash"), one, "left_semi").select("blob", "text"), rules)
    found.select("blob", F.lit(version).alias("version"), "spans").write.mode("append").parquet(ledger)
    now = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("version") == version)
    return now


def findings(docs: DataFrame, ledger: str | None = None, version: str = RULE_VERSION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans of every row of ``docs``, by way of the ledger.

    Without a ledger a fresh one in the shared folder is used. A missing text is
    empty and has no spans. Rows without doc_id, and repeated rows, are returned
    each. Only blobs with findings travel to the paths.
    """
    scanned = update_ledger(docs, ledger or work_path(docs.sparkSession, "ledger"), version, rules)
    # written, so that the join deals both sides out itself and can split a blob with very many paths
    hits = stored(scanned.filter(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans")), "hits")
    paths = paths_of(docs)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def as_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, the spans as text, and the SHA-256 of the base spans' text."""
    found = findings(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    text = as_text(F.col("spans"))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(RULES)], F.sha2(text, 256).alias("base_sha256"), text.alias("spans")
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced; spans that touch or overlap are replaced as one."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, span: Column) -> Column:
        fresh = F.concat(state["parts"], F.array(F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit(MASK)))
        parts = F.when(span["start"] >= state["at"], fresh).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), parts.alias("parts"))

    done = F.aggregate(spans, zero, step)
    return F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text)))


def without_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``n_chars`` counted anew; other rows and columns stay as they are.

    Blobs with findings come from the ledger; a missing text stays missing.
    """
    scanned = update_ledger(docs, work_path(docs.sparkSession, "ledger"), RULE_VERSION, rules)
    hits = stored(scanned.filter(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("__spans")), "hits")
    hits = hits.withColumnRenamed("blob", "__blob")
    blob = F.sha2(text_or_empty(), 256)
    joined = docs.withColumn("__key", blob).join(hits, F.col("__key") == F.col("__blob"), "left")
    hit = F.col("__spans").isNotNull()
    clean = F.when(hit, masked(F.col("text"), F.col("__spans"))).otherwise(F.col("text"))
    out = joined.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
    + ", ".join(
        f"""m{k} AS (SELECT doc_id, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS w, regexp_extract_all(t, {p}, {r.group}) AS g FROM d WHERE regexp_matches(t, {p})),
        s{k} AS (SELECT doc_id, {k} AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS start, length(w[i]) AS size, length(g[i]) AS tested
               FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m{k}))"""
        for k, (r, p) in enumerate((r, "'" + r.pattern.replace("'", "''") + "'") for r in RULES)
    )
    + ", s AS ("
    + " UNION ALL ".join(f"SELECT doc_id, kind, '{r.kind}' AS name, CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS stop FROM s{k} WHERE tested >= {r.least}" for k, r in enumerate(RULES))
    + "), c AS (SELECT doc_id, "
    + ", ".join(f"count(*) FILTER (kind = {k}) AS n_{r.kind}" for k, r in enumerate(RULES))
    + """, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM s GROUP BY doc_id)
    SELECT d.doc_id, """
    + ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES)
    + ", sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN c USING (doc_id)"
)
