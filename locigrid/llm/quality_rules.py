"""Quality rules with thresholds learned from the corpus.

Each document is measured once. For every language and source the values of each
measure are kept in a sketch: counts per bin, where a bin is the six leading bits
of a whole number. Sketches merge by adding counts, so the sketch of a language,
or of all, is the sum of those of its parts; a quantile is off by less than a
thirty-second of its value. A document is rejected where it lies far beyond a
quartile of its group.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from locigrid.llm.common import NOT_SPACE, small_side, stored, text_or_empty, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
# A document is out when it lies further beyond a quartile than REACH times the
# spread of the quartiles; measure -> (per thousand or hundred of, whether a low
# value counts too, the spread taken where the quartiles lie closer together).
REACH = 3
MEASURES = {
    "symbols": ("n_symbols * 1000", False, 60),
    "repeats": ("n_repeat_words * 1000", False, 60),
    "dup_lines": ("n_dup_lines * 1000", False, 20),
    "word_size": ("word_chars * 100", True, 150),
}
# A group of fewer documents takes the sketch of its language, or else of all.
LEAST_ROWS = 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(windows: str) -> Column:
    """Windows, given as sorted structs (h, i), whose h another window has too: their places in order."""
    tagged = F.col(windows)
    beside = lambda k: F.get(tagged, k)["h"]
    twice = F.transform(tagged, lambda x, k: F.when((beside(k - 1) == x["h"]) | (beside(k + 1) == x["h"]), x["i"]))
    return F.array_sort(F.filter(twice, lambda i: i.isNotNull()))


def _covered(places: Column) -> Column:
    """Words under windows that begin at ``places``, each counted once."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"))
    return F.aggregate(places, zero, step, lambda s: s["n"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row, by built-in functions alone.

    Windows are compared by a 64-bit hash of the hashes of their words.
    """
    text = F.col("__text")
    rows = docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_or_empty().alias("__text")
    ).withColumn("__words", words(text))
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(NOT_SPACE)))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__codes"),
    )
    count = F.greatest(F.size("__codes") - (WINDOW - 1), F.lit(0))
    every = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice("__codes", i, F.lit(WINDOW))))
    rows = rows.withColumn("__windows", F.slice(every, F.lit(1), count))
    # most texts repeat no window and need no sorting
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    tagged = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("__tagged", F.when(some, tagged))
    repeats = F.when(F.col("__tagged").isNotNull(), _covered(_repeated("__tagged"))).otherwise(F.lit(0))
    return rows.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
    )


def bin_of(value: Column) -> Column:
    """Lower edge of the bin of a whole number: exact below 64, then its six leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def failed_base() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def value_of(measure: str) -> Column:
    return F.expr(f"CAST({MEASURES[measure][0]} AS BIGINT) div nullif(n_words, 0)")


def sketches(counts: DataFrame) -> DataFrame:
    """level, lang, source, measure, bin and n: level 0 per language and source, 1 per language, 2 of all."""
    values = F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(value_of(m)).alias("bin")) for m in MEASURES])
    base = counts.filter(~failed_base()).select("lang", "source", F.explode(values).alias("x"))
    own = base.groupBy("lang", "source", "x.measure", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    level = lambda k, lang, source: F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"))
    levels = F.array(level(0, F.col("lang"), F.col("source")), level(1, F.col("lang"), none), level(2, none, none))
    spread = own.select(F.explode(levels).alias("g"), "measure", "bin", "n")
    return spread.groupBy("g.level", "g.lang", "g.source", "measure", "bin").agg(F.sum("n").alias("n"))


def thresholds(counts: DataFrame) -> DataFrame:
    """lang, source, and the highest and lowest accepted value of each measure."""
    group = ["level", "lang", "source", "measure"]
    over = Window.partitionBy(*group)
    summed = sketches(counts).withColumns({"upto": F.sum("n").over(over.orderBy("bin")), "all": F.sum("n").over(over)})
    quartiles = summed.groupBy(*group).agg(
        F.max("all").alias("rows"),
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bin"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bin"))).alias("q3"),
    )
    columns = [F.max("rows").alias("rows")]
    for m, (_, two_sided, least) in MEASURES.items():
        mine = F.col("measure") == m
        reach = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        columns.append(F.max(F.when(mine, F.col("q3") + reach)).alias(f"high_{m}"))
        if two_sided:
            columns.append(F.max(F.when(mine, F.col("q1") - reach)).alias(f"low_{m}"))
    table = quartiles.groupBy("level", "lang", "source").agg(*columns)
    limits = [c for c in table.columns if c.startswith(("high_", "low_"))]
    table = stored(table, "quartiles")
    overall = table.filter("level = 2").first()
    own = table.filter("level = 0").drop("level")
    of_lang = table.filter("level = 1").select(F.col("lang").alias("l_lang"), F.col("rows").alias("l_rows"), *[F.col(c).alias(f"l_{c}") for c in limits])
    joined = own.join(of_lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    of_all = lambda c: F.lit(overall[c] if overall else None).cast("long")
    pick = lambda c: F.when(F.col("rows") >= LEAST_ROWS, F.col(c)).when(F.col("l_rows") >= LEAST_ROWS, F.col(f"l_{c}")).otherwise(of_all(c))
    return joined.select("lang", "source", *[pick(c).alias(c) for c in limits])


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row of ``docs``.

    A missing text has no words and fails the base rule. Missing languages and
    sources are groups of their own. A value equal to a threshold is accepted.
    Repeated rows count each. Thresholds are learned from the rows that pass the
    base rule; the group of every such row has them.
    """
    counts = stored(measured(docs), "measures")
    limits = stored(thresholds(counts), "thresholds")
    limits = small_side(limits)
    limits = limits.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    inside = F.lit(True)
    for m, (_, two_sided, _) in MEASURES.items():
        inside = inside & (value_of(m) <= F.col(f"high_{m}"))
        if two_sided:
            inside = inside & (value_of(m) >= F.col(f"low_{m}"))
    out = counts.join(limits, same, "left").withColumn("base_failed", failed_base())
    kept = F.when(F.col("base_failed"), False).otherwise(F.coalesce(inside, F.lit(True)))
    return out.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"))


def _sql() -> str:
    value = {m: f"(CAST({e} AS BIGINT) // nullif(n_words, 0))" for m, (e, _, _) in MEASURES.items()}
    bins = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {v} AS v FROM ok" for m, v in value.items())
    limits = [(f"high_{m}", f"max(CASE WHEN measure = '{m}' THEN q3 + {REACH} * greatest(q3 - q1, {least}) END)") for m, (_, _, least) in MEASURES.items()]
    limits += [(f"low_{m}", f"max(CASE WHEN measure = '{m}' THEN q1 - {REACH} * greatest(q3 - q1, {least}) END)") for m, (_, two, least) in MEASURES.items() if two]
    pick = ", ".join(f"CASE WHEN o.n >= {LEAST_ROWS} THEN o.{c} WHEN l.n >= {LEAST_ROWS} THEN l.{c} ELSE a.{c} END AS {c}" for c, _ in limits)
    inside = " AND ".join([f"{v} <= high_{m}" for m, v in value.items()] + [f"{value[m]} >= low_{m}" for m, (_, two, _) in MEASURES.items() if two])
    gram = " || ' ' || ".join(["a"] + [f"lead(a, {k}) OVER o" for k in range(1, WINDOW)])
    return f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
    g AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS a FROM w),
    k AS (SELECT doc_id, i, {gram} AS gram FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM k WHERE gram IS NOT NULL),
    r AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM h WHERE c > 1) GROUP BY doc_id),
    m AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
        CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{NOT_SPACE}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{NOT_SPACE}')))) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
    f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m), ok AS (SELECT * FROM f WHERE NOT base_failed),
    v AS ({bins}),
    b AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bin FROM v),
    c AS (SELECT 0 AS level, lang, source, measure, bin, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT 1, lang, NULL, measure, bin, count(*) FROM b GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, measure, bin, count(*) FROM b GROUP BY ALL),
    u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM c),
    q AS (SELECT level, lang, source, measure, max(total) AS n, min(bin) FILTER (4 * upto >= total) AS q1, min(bin) FILTER (4 * upto >= 3 * total) AS q3 FROM u GROUP BY ALL),
    p AS (SELECT level, lang, source, max(n) AS n, {", ".join(f"{e} AS {c}" for c, e in limits)} FROM q GROUP BY ALL),
    x AS (SELECT o.lang, o.source, {pick} FROM (SELECT * FROM p WHERE level = 0) o LEFT JOIN (SELECT * FROM p WHERE level = 1) l ON o.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT * FROM p WHERE level = 2) a)
    SELECT doc_id, {", ".join(COUNTS)}, base_failed, NOT base_failed AND coalesce({inside}, true) AS kept
    FROM f LEFT JOIN x ON f.lang IS NOT DISTINCT FROM x.lang AND f.source IS NOT DISTINCT FROM x.source"""


SQL = _sql()
