"""Language by compression: the dictionary that makes a text smallest names its language."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import zstandard
from pyspark.sql import Column, DataFrame

from locigrid.llm.common import key_crc, share_of, small_side, stored

UNKNOWN = "und"
# Bounds of the fit: text of a language in its dictionary, the pieces it is cut
# from, and the text in all dictionaries together. Every language is learned; where
# there are very many, each has a smaller dictionary.
DICTIONARY_BYTES = 256 * 1024
PIECE_CHARS = 512
ALL_BYTES = 64 << 20
LEAST_BYTES = 1024
LEVEL = 5
# Bytes compressed at a time. Beyond some of them a text is its own dictionary
# and says no more about the language, so long texts are coded in blocks.
BLOCK = 1024
# Least gain, in share of the size, over the second language; below it the
# prediction is marked as not accepted.
MARGIN = 0.01
# Bytes saved that make a language e times as likely.
BYTES_PER_NAT = 2.0

_LETTERS = re.compile(r"[^\W\d_]+")


def plain(text: str) -> bytes:
    """The runs of letters in lower case, joined by blanks; empty if there is no letter."""
    low = " ".join(_LETTERS.findall(text.lower()))
    return low.encode("utf-8", "replace") if any(map(str.isalpha, low)) else b""


class Coder:
    """Sizes of texts under each language's dictionary; ``dictionaries`` has the raw text and how often a language occurs."""

    def __init__(self, dictionaries: dict[str, tuple[bytes, float]]):
        self.names = sorted(dictionaries)
        # a language is named by a code too, shorter the more frequent it is
        self.named = np.array([-BYTES_PER_NAT * np.log(dictionaries[n][1]) for n in self.names])
        self.coders = []
        for name in self.names:
            raw = zstandard.ZstdCompressionDict(dictionaries[name][0], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            self.coders.append(
                zstandard.ZstdCompressor(
                    dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False
                )
            )

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, likelihood from 0 to 1, and whether the margin is wide enough."""
        low = plain(text) if text else b""
        if not low or not self.names:
            return UNKNOWN, 0.0, False
        blocks = [low[k : k + BLOCK] for k in range(0, len(low), BLOCK)]
        sizes = self.named + [sum(len(coder.compress(b)) for b in blocks) for coder in self.coders]
        best = int(sizes.argmin())
        rest = np.delete(sizes, best)
        margin = (rest.min() - sizes[best]) / sizes[best] if len(rest) else 1.0
        return self.names[best], float(1 / np.exp((sizes[best] - sizes) / BYTES_PER_NAT).sum()), bool(margin >= MARGIN)


def fit(docs: DataFrame, held_out: Column) -> dict[str, tuple[bytes, float]]:
    """A raw dictionary per language from a sample of bounded size, and the share of its documents.

    Of every language texts are drawn by hash until about twice the dictionary is
    covered, and of each one piece at a place also drawn by hash. The draw is by
    doc_id and text, so that many rows of one doc_id are drawn like others, and
    rows repeated whole are drawn once.
    """
    known = docs.select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("doc_id").alias("key"), held_out.alias("held")
    ).filter("not held and lang is not null and text is not null and length(trim(text)) > 0")
    chars = F.sum(F.least(F.length("text"), F.lit(PIECE_CHARS))).alias("chars")
    counts = stored(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), chars), "languages")
    totals = counts.agg(F.count(F.lit(1)).alias("languages"), F.sum("n").alias("n")).first()
    if not totals["languages"]:
        return {}
    bytes_each = max(LEAST_BYTES, min(DICTIONARY_BYTES, ALL_BYTES // totals["languages"]))
    shares = counts.select("lang", F.least(F.lit(1.0), 2 * bytes_each / F.col("chars")).alias("share"), (F.col("n") / totals["n"]).alias("often"))
    seen = F.xxhash64("text")
    place = share_of("place", F.col("key"), seen)
    begin = F.greatest(F.lit(1), F.floor(place * (F.length("text") - PIECE_CHARS)).cast("int"))
    rows = (
        known.withColumn("draw", share_of("language", F.col("key"), seen))
        .join(small_side(shares), "lang")
        .filter(F.col("draw") < F.col("share"))
        .select("lang", "often", "draw", F.substring(F.col("text"), begin, F.lit(PIECE_CHARS)).alias("piece"))
        .distinct()
        .collect()
    )
    out: dict[str, list[bytes]] = {}
    often = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["draw"], r["piece"])):
        out.setdefault(r["lang"], []).append(plain(r["piece"]))
        often[r["lang"]] = r["often"]
    # what stands last in a dictionary is cheapest to refer to
    return {lang: (b" ".join(pieces)[:bytes_each] or b"        ", often[lang]) for lang, pieces in out.items()}


def language_of(column: str, dictionaries: dict[str, tuple[bytes, float]]) -> Column:
    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        coder = Coder(dictionaries)
        found = [coder.predict(t) for t in texts]
        return pd.DataFrame(found, columns=["lang_pred", "score", "accepted"])

    return predict(F.col(column).cast("string"))


def languages(docs: DataFrame, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of every row of ``docs``.

    ``und`` with score 0 where the text is missing or has no letter, or where no
    language could be learned. Equal sizes go to the more frequent language, then
    the first by name, and ``accepted`` is then false, as it is wherever the margin is narrow. A missing
    doc_id counts as empty text for the fold. Repeated rows are predicted each.
    """
    held = key_crc() % folds == held_fold
    dictionaries = fit(docs, held)
    found = docs.select("doc_id", held.alias("held_out"), language_of("text", dictionaries).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.accepted")
