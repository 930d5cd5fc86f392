"""Phrases whose words keep together.

Only the longest windows are counted: at every word the words that follow it in
lead columns, padded where a phrase ends. Each shorter phrase that begins there
is a prefix of its window, so ROLLUP over the lead columns sums the counts of
all lengths. Rounds over windows of one and of two words, counted in the same
way, find the frequent words and pairs; the round over the longest windows pads
them where a word or pair is too rare for any phrase across it to be a candidate.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame, Window

from locigrid.llm.common import stored
from locigrid.llm.wordcodes import byte_kinds, sliced, words_of

LONGEST = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
# A phrase goes where a longer one around it has this share of its occurrences, in per cent.
COVERED = 80
# Frequent words, and frequent pairs, that every task may get, 8 bytes each.
SHARED = 4_000_000
# Bytes of text worked on at a time.
CHUNK = 5 << 20

_KINDS = byte_kinds(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
_PAD = np.uint64(0)


def _rows(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _lead(column: np.ndarray, piece: np.ndarray, step: int) -> np.ndarray:
    """The value ``step`` words on, or padding where the piece ends before."""
    out = np.full(len(column), _PAD, np.uint64)
    if len(column) > step:
        out[:-step] = np.where(piece[step:] == piece[:-step], column[step:], _PAD)
    return out


def _windows(docs: DataFrame, order: int, vocabulary: np.ndarray | None = None, frequent: np.ndarray | None = None, last: bool = False) -> DataFrame:
    """w1 to w``order`` and n: padded windows with how often a batch has them. Words are numbers, 0 is padding.

    A number stands for a word of one language. It is the place in ``vocabulary``, sorted hashes, and padding if
    the word is not there; without a vocabulary it is the hash. With ``frequent``, sorted hashes of pairs, windows
    are padded from the first pair not among them. Windows no longer than those of an earlier round are left out:
    those of one word beyond order 1, and in the last round those of two. Windows of order 1 have their language.
    In the last round, further rows carry a number in w1, its language and its word.
    """
    names = [f"w{k}" for k in range(1, order + 1)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, CHUNK):
            found = words_of(batch.column(1), _KINDS, lower=True, pieces=True)
            if not len(found.codes):
                continue
            langs = batch.column(0).dictionary_encode()
            lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(found.bounds))
            word = _of_language(found.hashes()[found.codes], lang, langs.dictionary)
            if vocabulary is not None:
                word = _places(word, vocabulary)
            columns = [word] + [_lead(word, found.piece, k) for k in range(1, order)]
            good = word != _PAD
            if order > 1:
                good &= columns[1] != _PAD
                if frequent is not None:
                    good &= _places(_pairs(word, columns[1]), frequent) > _PAD
                reach = good.copy()
                for k in range(2, order):
                    reach[: len(word) - k + 1] &= good[k - 1 :]
                    reach[max(0, len(word) - k + 1) :] = False
                    columns[k][~reach] = _PAD
            if last:
                both = good.copy()
                both[1:] |= good[:-1]
                at = np.flatnonzero(both)
                at = at[np.unique(word[at], return_index=True)[1]]
                if len(at):
                    zero = np.zeros(len(at), np.uint64)
                    text = found.names.take(pa.array(found.codes[at])).cast(pa.string())
                    yield _batch(langs.dictionary.take(pa.array(lang[at])), [word[at]] + [zero] * (order - 1), zero.astype(np.int64), text, names)
                good = columns[2] != _PAD if order > 2 else np.zeros(len(word), bool)
            columns, lang = [c[good] for c in columns], lang[good]
            del found, word, good
            if len(lang):
                first, count = _summed(columns)
                lang_names = langs.dictionary.take(pa.array(lang[first])) if order == 1 else pa.nulls(len(first), pa.string())
                yield _batch(lang_names, [c[first] for c in columns], count, pa.nulls(len(first), pa.string()), names)

    return _rows(docs).mapInArrow(run, f"lang string, {', '.join(f'{c} long' for c in names)}, n long, word string")


def _of_language(hashes: np.ndarray, lang: np.ndarray, names: pa.Array) -> np.ndarray:
    """Hashes of words, each with its language's."""
    salt = np.array([xxhash.xxh3_64_intdigest(str(x), 1) for x in names.to_pylist()], np.uint64)
    return np.maximum(hashes ^ salt[lang], np.uint64(1))


def _places(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Place of each value, from 1; 0 where it is not there."""
    if not len(sorted_values):
        return np.zeros(len(values), np.uint64)
    at = np.searchsorted(sorted_values, values)
    there = sorted_values[np.minimum(at, len(sorted_values) - 1)] == values
    return np.where(there, at + 1, 0).astype(np.uint64)


def _summed(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where each different window stands first, and how often it comes."""
    key = columns[0]
    for c in columns[1:]:
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c
    _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if any((c[first][inverse] != c).any() for c in columns):
        # two windows of one key travel apart and are summed later
        return np.arange(len(key)), np.ones(len(key), np.int64)
    return first, count


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One hash per pair of words. Two pairs of one hash would only be counted without need."""
    return (first ^ (first >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + second


def _batch(lang: pa.Array, columns: list[np.ndarray], count: np.ndarray, word: pa.Array, names: list[str]) -> pa.RecordBatch:
    arrays = [lang.cast(pa.string()), *(pa.array(c.view(np.int64)) for c in columns), pa.array(count), word]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", *names, "n", "word"])


def _rolled(windows: DataFrame, order: int, least: int) -> DataFrame:
    """w1 to w``order``, words and n: the prefixes of the windows that occur ``least`` times; words says how many are
    not null. Of order 1 also the language, and its total with words 0."""
    names = [f"w{k}" for k in range(1, order + 1)]
    columns = [F.nullif(F.col(c), F.lit(0)).alias(c) for c in names]
    keys = ["lang", *names] if order == 1 else names
    # padding and the nulls of a rolled-up column are told apart by the grouping number
    counted = windows.filter("n > 0").select("lang", *columns, "n").rollup(*keys).agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    length = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    whole = F.lit(order) - F.bit_count("g") == F.col("words")
    total = (F.col("words") == 0) & F.col("lang").isNotNull() if order == 1 else F.lit(False)
    return counted.withColumn("words", length).filter(whole & (total | ((F.col("words") > 0) & (F.col("n") >= least)))).drop("g")


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shared: int = SHARED) -> DataFrame:
    """lang, words, phrase and n of the phrases of up to ``longest`` words that occur ``least`` times in a language.

    A row with words 0 and an empty phrase says how many words the language has.
    Single words are given where they are part of a longer phrase of the table.
    Of frequent words and of frequent pairs, tasks get up to ``shared``; where
    there are more, windows are padded later than they could be.
    """
    single = stored(_rolled(_windows(docs, 1), 1, least), "words").withColumnRenamed("w1", "hash")
    common = single.filter("words = 1").select("hash").distinct()
    vocabulary = None
    if common.count() <= shared:
        vocabulary = np.sort(common.toArrow()["hash"].to_numpy().view(np.uint64))
    pairs = stored(_rolled(_windows(docs, 2, vocabulary), 2, least).filter("words = 2"), "pairs")
    frequent = None
    if pairs.count() <= shared:
        ends = pairs.select("w1", "w2").toArrow()
        frequent = np.unique(_pairs(*(ends[c].to_numpy().view(np.uint64) for c in ("w1", "w2"))))
    windows = stored(_windows(docs, longest, vocabulary, frequent, last=True), "windows")

    names = [f"w{k}" for k in range(1, longest + 1)]
    long = _rolled(windows, longest, least).filter("words > 2").unionByName(pairs, allowMissingColumns=True)
    spelled = long.select("words", "n", F.array_compact(F.array(*names)).alias("numbers"))
    alike = (F.min("word") == F.max("word")) & (F.min("lang") == F.max("lang"))
    one = lambda c: F.when(alike, F.min(c)).otherwise(F.raise_error(F.lit("two words share a hash"))).alias(c)
    dictionary = windows.filter("word is not null").groupBy(F.col("w1").alias("number")).agg(one("lang"), one("word"))
    dictionary = stored(dictionary, "names")
    spelled = spelled.select("*", F.posexplode("numbers").alias("at", "number")).join(dictionary, "number")
    in_order = F.sort_array(F.collect_list(F.struct("at", "word")))
    phrase = F.array_join(F.transform(in_order, lambda x: x["word"]), " ").alias("phrase")
    found = spelled.groupBy("words", "n", "numbers").agg(F.min("lang").alias("lang"), phrase).select("lang", "words", "phrase", "n")
    # a word of the dictionary by its hash
    hashed = dictionary.select("word", _hash_of("lang", "word").alias("hash"))
    alone = single.filter("words = 1").join(hashed, "hash").select("lang", "words", F.col("word").alias("phrase"), "n")
    return found.union(alone).union(single.filter("words = 0").select("lang", "words", F.lit("").alias("phrase"), "n"))


def _hash_of(lang: str, word: str) -> Column:
    """Hash of a word and its language as the windows have it."""

    @F.pandas_udf("long")
    def hashed(langs: pd.Series, words: pd.Series) -> pd.Series:
        bare = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        names = pa.array(langs, pa.string()).dictionary_encode()
        return pd.Series(_of_language(bare, names.indices.to_numpy(zero_copy_only=False), names.dictionary).view(np.int64))

    return hashed(F.col(lang), F.col(word))


def _part(words: Column, begin: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, shared: int = SHARED) -> DataFrame:
    """The ``top`` best phrases of each language: lang, rank, phrase, a, l, r, n and score.

    Documents of no language count as ``und``, as do those that carry that name;
    texts that are null or empty have no words. Repeated rows count each. Equal
    scores go by more occurrences, then by the phrase. An empty table gives an
    empty result. Counts are exact; the words of a phrase are known by 64 bits of
    hash until they are spelled, and two words of one hash stop the job.
    """
    known = stored(phrase_counts(docs, longest, least, shared), "phrases")
    counted = known.filter("words > 0").select("lang", "phrase", "n")
    words = F.split("phrase", " ")
    candidates = known.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), words.alias("ws"))

    # what a longer phrase covers
    inner = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.col("words") - 1),
                lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: _part(F.col("ws"), i, k)),
            )
        )
    )
    longer = candidates.filter("words > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    left = candidates.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"around IS NULL OR 100 * around < {COVERED} * a"))

    cuts = left.select("lang", "phrase", "a", "ws", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("ws"), F.lit(1), F.col("k")).alias("head"), _part(F.col("ws"), F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    heads = counted.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = counted.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    score = F.expr(f"CAST((CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)")
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", score)
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rated = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each part of a language first, so that no task sorts a whole language
    part = F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("part")
    near = rated.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = known.filter("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
  p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
  t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
  g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM p, range(1, {LONGEST + 1}) AS r(k)),
  f AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
  c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
  inside AS (SELECT lang, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))))) AS phrase, a FROM c),
  around AS (SELECT lang, phrase, max(a) AS around FROM inside GROUP BY ALL),
  kept AS (SELECT c.* FROM c LEFT JOIN around USING (lang, phrase) WHERE around IS NULL OR 100 * around < {COVERED} * a),
  cut AS (SELECT kept.lang, kept.phrase, kept.a, kept.j, h.n AS l, e.n AS r, CAST({SCALE} * kept.a::HUGEINT // (h.n::HUGEINT + e.n::HUGEINT) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) kept JOIN f h ON h.lang = kept.lang AND h.phrase = array_to_string(kept.ws[1:kept.j], ' ')
      JOIN f e ON e.lang = kept.lang AND e.phrase = array_to_string(kept.ws[kept.j + 1:kept.k], ' ')),
  low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
  ranked AS (SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, score FROM low)
  SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN t USING (lang) WHERE rank <= {TOP}"""
