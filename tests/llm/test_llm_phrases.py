"""Exact repeats, collocations and ranked search against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from nasty import COLUMNS, documents, nasty_rows

from locigrid.llm import anchors, collocations, lexical_search
from locigrid.llm.wordcodes import byte_kinds, runs, sliced, words_of

ROWS = nasty_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, ROWS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def few(spark, rows):
    return documents(spark, rows).select("doc_id", "text", "lang")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_words_keep_bounds_of_texts():
    texts = pa.array(["a b", "", None, "b", "  ", "c,d e", "é"])
    found = words_of(texts, byte_kinds(b" \t\n", b","), pieces=True)
    assert [found.names[int(c)].as_py() for c in found.codes] == [b"a", b"b", b"b", b"c", b"d", b"e", "é".encode()]
    assert found.bounds.tolist() == [0, 2, 2, 2, 3, 3, 6, 7]
    piece = found.piece
    assert piece[0] == piece[1] != piece[2] and piece[3] != piece[4] == piece[5]
    assert words_of(texts.slice(3, 1), byte_kinds(b" ")).bounds.tolist() == [0, 1]


def test_runs_are_hashes_of_the_words_alone():
    words = np.random.default_rng(0).integers(0, 1 << 63, 50).astype(np.uint64)
    words[20:32] = words[5:17]
    for width in (1, 2, 5, 10, 12):
        got = runs(words, width)
        assert len(got) == 51 - width and got[5] == got[20] and len(set(got[:15].tolist())) == 15
    assert len(runs(words, 51)) == 0


def test_slices_keep_all_rows():
    pick = random.Random(1)
    texts = ["x" * pick.choice((0, 1, 7, 50, 400)) for _ in range(300)] + [None]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[k : k + 37], pa.string())}) for k in range(0, len(texts), 37)]
    out = list(sliced(batches, 0, chunk=100, rows=9))
    assert [t for b in out for t in b.column(0).to_pylist()] == texts
    assert all(b.num_rows == 1 or (b.num_rows <= 9 and sum(len(t or "") for t in b.column(0).to_pylist()) <= 100) for b in out)


# exact repeats


def plain_repeats(rows, window):
    """n_words, n_removed and digest by row; rows of one doc_id are one document."""
    key = lambda k: -(1 << 63) if k is None else k
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (k, _), ws in zip(rows, words):
        for s in range(len(ws) - window + 1):
            w = tuple(ws[s : s + window])
            first[w] = min(first.get(w, (key(k), s)), (key(k), s))
    out = []
    for (k, _), ws in zip(rows, words):
        gone = set()
        for s in range(len(ws) - window + 1):
            if (key(k), s) > first[tuple(ws[s : s + window])]:
                gone.update(range(s, s + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((k, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def repeats_of(df, window=20, **more):
    got = anchors.repeats(df, window, **more).collect()
    for r in got:
        assert sum(s.length for s in r.repeats) == r.n_removed
        assert all(a.start + a.length < b.start for a, b in zip(r.repeats, r.repeats[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got), key=str)


def test_repeats_of_odd_rows(spark, docs, empty):
    assert repeats_of(docs) == plain_repeats([(k, t) for k, t, *_ in ROWS], 20)
    assert anchors.repeats(empty).count() == 0


@pytest.mark.parametrize("window", [2, 4, 6, 20])
def test_repeats_at_every_offset(spark, window, monkeypatch):
    pick = random.Random(window)
    word = lambda: pick.choice("abcdefgh") + pick.choice("xyz")
    shared = [[word() for _ in range(pick.choice((window, window + 1, 3 * window)))] for _ in range(4)]
    rows = []
    for k in range(60):
        ws = [word() for _ in range(pick.randrange(0, 50))]
        for _ in range(pick.randrange(3)):
            at = pick.randrange(len(ws) + 1)
            ws[at:at] = pick.choice(shared)
        rows.append((pick.choice((k, k, k, None, 7)), " ".join(ws)))
    # many batches and parts, so that most repeats are between batches
    monkeypatch.setattr(anchors, "sliced", lambda batches, column: sliced(batches, column, chunk=400))
    df = few(spark, [(k, t, None, None) for k, t in rows])
    assert repeats_of(df, window, part_bytes=300) == plain_repeats(rows, window)


def test_repeats_of_a_text_without_end(spark):
    text = "a b c " * 4000
    assert repeats_of(few(spark, [(1, text, None, None), (2, text, None, None)])) == plain_repeats([(1, text), (2, text)], 20)


# collocations


def plain_collocations(rows, longest, least, top):
    total, count = Counter(), defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in range(1, longest + 1):
                count[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, found in count.items():
        often = {p: n for p, n in found.items() if n >= least}
        inside = defaultdict(int)
        for p, n in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], n)
        rated = []
        for p, a in often.items():
            if len(p) < 2 or 100 * inside[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, le, ri) in enumerate(sorted(rated)[:top], start=1):
            out.append((lang, rank, p.decode(), -a, le, ri, total[lang], -score))
    return sorted(out)


def collocations_of(df, **more):
    got = collocations.collocations(df, **more).collect()
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got)


@pytest.mark.parametrize("shared", [1 << 20, 0])
def test_collocations_of_odd_rows(spark, docs, empty, shared):
    assert collocations_of(docs, least=3, shared=shared) == plain_collocations(ROWS, 4, 3, 2000)
    assert collocations.collocations(empty).count() == 0


@pytest.mark.parametrize(("longest", "least", "top"), [(4, 5, 2000), (3, 2, 40), (2, 4, 7), (5, 3, 2000)])
def test_collocations_against_counting(spark, longest, least, top):
    pick = random.Random(longest)
    rows = []
    for k in range(120):
        ws = []
        for _ in range(pick.randrange(60)):
            ws.append(pick.choice(("New York City", "new york", "of the", "ice. Cream", "É a", "a", "b", "c", "d,", "\n", "zz\tyy xx ww vv")))
        rows.append((k, " ".join(ws), pick.choice(("en", "de", None, "und")), None))
    assert collocations_of(few(spark, rows), longest=longest, least=least, top=top) == plain_collocations(rows, longest, least, top)


# ranked search


def plain_search(rows, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    bags = [(k, Counter(terms(t))) for k, t in rows]
    total, docs = sum(sum(b.values()) for _, b in bags), sum(bool(b) for _, b in bags)
    held = Counter(t for _, b in bags for t in b)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms(text))
    out = []
    for item, ts in wanted.items():
        scored = []
        for k, bag in bags:
            score = 0
            for t in ts & set(bag):
                w = math.floor(1000 * math.log((2 * docs + 2) / (2 * held[t] + 1)))
                m = 100 - 90 + (90 * sum(bag.values()) * docs) // total
                score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, k is None, k or 0))
        for rank, (score, none, k) in enumerate(sorted(scored)[:top], start=1):
            out.append((item, rank, None if none else k, -score))
    return sorted(out, key=str)


def search_of(docs, items, **more):
    return sorted((tuple(r) for r in lexical_search.search(docs, items, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [(1, "w1 w2 W3 w300"), (2, None), (3, ""), (4, "!!"), (5, "one two three"), (5, "k l v"), (None, "é a b"), (6, "token secret text"), (7, "nowhere"), (1, "w1 w9")]


@pytest.mark.parametrize("terms_each", [50_000, 3])
def test_search_of_odd_rows(spark, docs, empty, terms_each):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS score")
    assert search_of(docs, items, terms_each=terms_each) == plain_search([(k, t) for k, t, *_ in ROWS], ITEMS, 10)
    assert lexical_search.search(empty, items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_search_against_scoring_all(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD", 64)
    pick = random.Random(3)
    words = [f"t{int(pick.paretovariate(0.6))}" for _ in range(4000)]
    rows = [(k // 2 if k % 9 else None, " ".join(pick.choices(words, k=pick.choice((1, 5, 30, 200))))) for k in range(700)]
    items = [(k, " ".join(pick.choices(words, k=12))) for k in range(40)]
    df = few(spark, [(k, t, None, None) for k, t in rows]).repartition(3)
    assert search_of(df, spark.createDataFrame(items, "item_id long, text string")) == plain_search(rows, items, 10)


def test_intervals_leave_most_documents_unopened():
    pick = np.random.default_rng(4)
    docs, terms = 4096, 12
    doc = np.concatenate([np.sort(pick.choice(docs, 1500, replace=False)) for _ in range(terms)])
    term = np.repeat(np.arange(terms), 1500)
    impact = pick.integers(1, 1000, len(doc))
    # passages: few documents that hold all terms well
    for d in pick.choice(docs, 12, replace=False):
        impact[doc == d] = 5000
    lists = lexical_search.Postings(term, doc, impact, docs)
    best = []
    opened = lists.search(np.arange(terms), best, lambda s, d: (best.append((s, d)), best.sort(reverse=True), best.__delitem__(slice(10, None))), lambda: best[9][0] if len(best) == 10 else 1)
    score = np.bincount(doc, impact, docs).astype(int)
    assert [s for s, _ in best] == sorted(score.tolist(), reverse=True)[:10]
    assert opened < docs / 4
