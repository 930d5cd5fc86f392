"""Document quality by pairwise ranking.

A Bradley-Terry model gives every document a score such that the chance of one
document being preferred to another is the logistic function of the difference
of their scores. The score is linear in features of the text, so the model is a
logistic regression without intercept on feature differences of preference
pairs (a document labelled 1 beside one labelled 0). The cut between accepted
and rejected is a quantile of the scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from locigrid.llm.common import key_crc, share_of

# Labelled documents of each class the model is fitted on, chosen by hash. The
# fit is the only step with a bound; every document is scored.
SAMPLE_PER_CLASS = 20_000
# Partners each rejected document of the sample is compared with.
PAIRS_PER_ROW = 4
# Bytes of text worked on at a time; each takes about forty bytes of memory.
CHUNK = 1 << 20
# The accepted side of the cut has scores from here on.
ACCEPT = 0.3

_SPACE, _LOWER, _UPPER, _DIGIT, _SYMBOL, _MARK, _WIDE = range(7)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = _SPACE
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = _LOWER, _UPPER, _DIGIT, _WIDE
_KIND[[ord(c) for c in "#*$%&|<>@^~_=+\\{}"]] = _SYMBOL

FEATURES = 22


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


# What is counted of a text: kinds of bytes, two marks, words, their bytes, words that pass a test, lines.
_COUNTS = 19


def _counts(data: np.ndarray, bounds: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each text, a row each; ``bounds`` are the byte offsets of the texts.

    The first text may go on from an earlier span, whose last words have the codes
    ``before``. Returns the codes of the last two words of the last text as well.
    """
    n = len(bounds) - 1
    kind = _KIND[data]
    solid = kind != _SPACE
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    per_text = _sums(first, bounds)
    of_word = np.concatenate(([0], np.cumsum(per_text)))
    out = np.zeros((n, _COUNTS), np.int64)
    for k, what in enumerate((_LOWER, _UPPER, _DIGIT, _SYMBOL, _MARK, _WIDE)):
        out[:, k] = _sums(kind == what, bounds)
    out[:, 6] = _sums(data == 33, bounds)
    out[:, 7] = _sums(data == 124, bounds)
    out[:, 8], out[:, 9] = per_text, _sums(solid, bounds)
    out[:, 18] = _sums(data == 10, bounds)
    if not len(starts):
        return out, before
    length = np.add.reduceat(solid, starts, dtype=np.int64)
    counted = {w: np.add.reduceat(kind == w, starts, dtype=np.int64) for w in (_LOWER, _UPPER, _SYMBOL, _DIGIT, _WIDE)}
    power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    # of each byte its place in its word, as far as it matters
    step = np.ones(len(data), np.int64)
    step[: starts[0]], step[starts] = 0, np.concatenate(([0], starts[:-1] - starts[1:] + 1))
    place = np.cumsum(step, out=step)
    place &= 63
    code = power[place]
    del step, place
    code *= data.astype(np.uint64) + np.uint64(1)
    code *= solid
    code = np.add.reduceat(code, starts) + length.astype(np.uint64)
    text_of = np.repeat(np.arange(n), per_text)
    # words of the earlier span belong to the first text
    codes, texts = np.concatenate((before, code)), np.concatenate((np.zeros(len(before), np.int64), text_of))
    again = []
    for back in (1, 2):
        flags = np.zeros(len(codes), bool)
        flags[back:] = (codes[back:] == codes[:-back]) & (texts[back:] == texts[:-back])
        again.append(flags[len(before) :])
    letters = counted[_LOWER] + counted[_UPPER] + counted[_WIDE]
    tests = (
        counted[_SYMBOL] > 0,
        letters + counted[_DIGIT] == 0,
        (counted[_UPPER] > 1) & (counted[_LOWER] == 0),
        again[0],
        again[1],
        counted[_DIGIT] > 0,
        length > 12,
        length < 3,
    )
    for k, test in enumerate(tests):
        out[:, 10 + k] = _sums(test, of_word)
    return out, codes[texts == n - 1][-2:]


def _long_counts(data: np.ndarray) -> np.ndarray:
    """Counts of one text, span by span; a span ends between two words."""
    out, before, low = np.zeros((1, _COUNTS), np.int64), np.zeros(0, np.uint64), 0
    while low < len(data):
        high = min(low + CHUNK, len(data))
        gaps = np.flatnonzero(_KIND[data[low:high]] == _SPACE)
        if high < len(data) and len(gaps):
            high = low + int(gaps[-1]) + 1
        while high < len(data) and not len(gaps):
            # a word longer than a span is taken whole
            gaps = np.flatnonzero(_KIND[data[high : high + CHUNK]] == _SPACE)
            high = high + int(gaps[0]) + 1 if len(gaps) else min(high + CHUNK, len(data))
        counts, before = _counts(data[low:high], np.array([0, high - low]), before)
        out += counts
        low = high
    return out


def _features(counts: np.ndarray) -> np.ndarray:
    """Features of texts from their counts."""
    out = np.zeros((len(counts), FEATURES))
    words, chars = counts[:, 8], counts[:, 9]
    some, many = np.maximum(chars, 1), np.maximum(words, 1)
    out[:, :8] = counts[:, :8] / some[:, None]
    out[:, 8:16] = counts[:, 10:18] / many[:, None]
    out[:, 16] = np.where(words > 0, np.log1p(chars / many), 0)
    out[:, 17] = np.log1p(words)
    out[:, 18] = counts[:, 18] / many
    # a little junk and a lot of it differ less than none and a little
    out[:, 19] = np.sqrt(out[:, 8])
    out[:, 20] = np.sqrt(out[:, 10])
    out[:, 21] = np.sqrt(out[:, 11])
    return out


def text_features(texts: pa.Array) -> np.ndarray:
    """Features of whole texts, worked on in spans of bounded size."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    none = np.zeros(0, np.uint64)
    rows, low = [np.zeros((0, _COUNTS), np.int64)], 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, "right")) - 1)
        piece = data[offsets[low] : offsets[high]]
        if len(piece) > CHUNK:
            rows.append(_long_counts(piece))
        else:
            rows.append(_counts(piece, offsets[low : high + 1] - offsets[low], none)[0])
        low = high
    return _features(np.concatenate(rows))


@dataclass(frozen=True)
class Ranking:
    """Score of a text: the logistic of weights · (features - centre) / scale - cut, shifted to the accepting score."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def worth(self, features: np.ndarray) -> np.ndarray:
        # summed row by row, so that equal texts tie in any batch
        return ((features - self.centre) / self.scale * self.weights).sum(axis=1)

    def score(self, features: np.ndarray) -> np.ndarray:
        shifted = self.worth(features) - self.cut + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(shifted, -40, 40)))


def fit_pairs(better: np.ndarray, worse: np.ndarray, share_worse: float, ridge: float = 1e-3) -> Ranking:
    """Fit on features of preferred and of rejected documents.

    Newton steps on the mean logistic loss of the pairs' feature differences.
    The cut is the score quantile that divides the two classes best, with the
    classes weighed as often as they are among the labels. Without documents of
    both classes nothing is known, and all are accepted.
    """
    if not len(better) or not len(worse):
        width = FEATURES
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), -1.0)
    both = np.concatenate((better, worse))
    centre, scale = both.mean(0), both.std(0)
    scale[scale < 1e-9] = 1.0
    pick = np.random.default_rng(0)
    rows = np.repeat(np.arange(len(worse)), PAIRS_PER_ROW)
    gaps = (better[pick.integers(0, len(better), len(rows))] - worse[rows]) / scale
    weights = np.zeros(both.shape[1])
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(gaps @ weights, -40, 40)))
        slope = gaps.T @ (chance - 1) / len(gaps) + ridge * weights
        curve = (gaps * (chance * (1 - chance))[:, None]).T @ gaps / len(gaps) + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    plain = Ranking(centre, scale, weights, 0.0)
    high, low = np.sort(plain.worth(better)), np.sort(plain.worth(worse))
    values = np.concatenate((high, low))
    mass = np.concatenate((np.full(len(high), (1 - share_worse) / len(high)), np.full(len(low), share_worse / len(low))))
    order = np.argsort(values, kind="stable")
    values, mass = values[order], np.cumsum(mass[order])
    quantiles = np.unique(np.concatenate((np.linspace(0.002, 0.998, 499), [share_worse])))
    at = np.minimum(np.searchsorted(mass, quantiles, "left"), len(values) - 2)
    cuts = (values[at] + values[at + 1]) / 2
    kept = 1 - np.searchsorted(high, cuts, "left") / len(high)
    dropped = np.searchsorted(low, cuts, "left") / len(low)
    found = kept + dropped
    best = np.flatnonzero(found >= found.max() - 1e-12)
    return Ranking(centre, scale, weights, float(cuts[best[len(best) // 2]]))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column) -> Ranking:
    """Fit on the labelled rows of ``docs`` that are not held out.

    A document whose label is missing or given as both 0 and 1 takes no part.
    Of rows under one doc_id, that of the least text hash is learned from.
    """
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .filter("low = high")
        .select("doc_id", F.col("low").alias("label"))
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return fit_pairs(np.zeros((0, FEATURES)), np.zeros((0, FEATURES)), 0.0)
    draw = share_of("quality", F.col("doc_id"))
    take = [(F.col("label") == k) & (draw < min(1.0, SAMPLE_PER_CLASS / n)) for k, n in counts.items()]
    sample = F.broadcast(known.filter(take[0] | take[1]))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    measured = rows.select("doc_id", "label", F.xxhash64("text").alias("hash"), features_of("text").alias("features"))
    # one row per sampled document, so at most about twice the class bound, however often a doc_id is repeated
    once = measured.groupBy("doc_id", "label").agg(F.min_by("features", F.struct("hash", "features")).alias("features"))
    found = once.toPandas().sort_values(["doc_id", "label"])
    matrix = np.array(found["features"].tolist()).reshape(-1, FEATURES)
    label = found["label"].to_numpy()
    order = np.lexsort((*matrix.T, found["doc_id"].to_numpy()))
    matrix, label = matrix[order], label[order]
    return fit_pairs(matrix[label == 1], matrix[label == 0], counts[0] / (counts[0] + counts[1]))


def features_of(column: str) -> Column:
    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series(list(text_features(pa.Array.from_pandas(texts, type=pa.string()))))

    return features(F.col(column))


def score_of(column: str, model: Ranking) -> Column:
    """Score from 0 to 1 of the whole text; a missing text counts as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(text_features(pa.Array.from_pandas(texts, type=pa.string()))))

    return score(F.col(column).cast("string"))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Missing and empty texts are scored as texts without words. Repeated rows
    are scored each. A missing doc_id falls in the fold of the empty text and is
    never learned from. Without labels of both classes every row is accepted.
    """
    held = key_crc() % folds == held_fold
    model = fit(docs, labels, held)
    scored = docs.select("doc_id", held.alias("held_out"), score_of("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` the classifier accepts, with all their columns."""
    model = fit(docs, labels, F.lit(False))
    return docs.filter(score_of("text", model) >= ACCEPT)
