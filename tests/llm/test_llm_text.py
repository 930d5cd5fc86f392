"""Quality, language, near-duplicates and secrets against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest
import xxhash
from nasty import COLUMNS, documents, nasty_rows

from locigrid.llm import language, quality_classifier, secrets, simhash
from locigrid.llm.components import components

ROWS = nasty_rows()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, ROWS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_of_odd_rows(spark, docs, empty):
    known = labels(spark, [(k, k % 2, 0) for k in range(1, 80)] + [(4, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0), (999, 1, 0)])
    got = quality_classifier.quality_scores(docs, known).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    fold = {(r.doc_id, r.held_out) for r in got}
    assert fold == {(k, zlib.crc32(str("" if k is None else k).encode()) % 5 == 0) for k, *_ in ROWS}
    by_text = {}
    for (k, text, *_), r in zip(ROWS, got):
        assert by_text.setdefault(text or "", r.score) == r.score
    assert quality_classifier.quality_scores(empty, known).count() == 0
    none = quality_classifier.quality_scores(docs, labels(spark, [])).collect()
    assert {r.predicted for r in none} == {1}
    assert quality_classifier.accepted(docs, labels(spark, [])).columns == docs.columns


def test_quality_ranks_held_out_documents(spark):
    docs, known = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.quality_scores(docs, known).join(known, "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(bad) > 5
    assert np.mean([a > b for a in good for b in bad]) > 0.98
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_repeated_documents_are_learned_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_classifier, "fit_pairs", lambda better, worse, share: seen.append((better, worse)))
    rows = [(1, f"word {k} of many words") for k in range(200)] + [(2, "another"), (2, "another"), (3, "third text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    for parts in (1, 5):
        quality_classifier.fit(docs.repartition(parts), marks, F.lit(False))
    assert [(len(b), len(w)) for b, w in seen] == [(1, 2), (1, 2)]
    assert np.array_equal(seen[0][0], seen[1][0]) and np.array_equal(seen[0][1], seen[1][1])


def test_features_do_not_depend_on_chunks(monkeypatch):
    texts = pa.array([t for _, t, *_ in ROWS])
    whole = quality_classifier.text_features(texts)
    monkeypatch.setattr(quality_classifier, "CHUNK", 500)
    assert np.allclose(whole, quality_classifier.text_features(texts))
    assert np.isfinite(whole).all() and whole.shape == (len(ROWS), quality_classifier.FEATURES)


def test_language_of_odd_rows(spark, docs, empty):
    got = language.languages(docs).collect()
    assert len(got) == len(ROWS)
    for (key, text, *_), r in zip(ROWS, got):
        assert (r.doc_id, r.held_out) == (key, zlib.crc32(str("" if key is None else key).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or "")))
        assert r.lang_pred in ("und", "en", "de", "fr") and 0 <= r.score <= 1
    assert language.languages(empty).count() == 0
    unknown = language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert np.mean([r.lang == r.lang_pred for r in rows if r.accepted]) > 0.98


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(keyed, radius=4):
    """Smallest key reachable, for (key, fingerprint) rows."""
    codes = sorted({c for _, c in keyed})
    group = {c: c for c in codes}

    def root(c):
        while group[c] != c:
            c = group[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= radius:
                group[root(a)] = root(b)
    least = {}
    for k, c in keyed:
        if k is not None:
            least[root(c)] = min(k, least.get(root(c), k))
    return [(k, f"{c:016x}", least.get(root(c))) for k, c in keyed]


def test_near_duplicates_of_odd_rows(docs, empty):
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    want = plain_components([(k, plain_fingerprint(t)) for k, t, *_ in ROWS])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.without_near_duplicates(empty).count() == 0


def test_one_document_of_each_group_stays(docs):
    got = simhash.without_near_duplicates(docs)
    assert got.columns == docs.columns
    want = plain_components([(k, plain_fingerprint(t)) for k, t, *_ in ROWS])
    kept = [r.doc_id for r in got.select("doc_id").collect()]
    assert sorted(kept) == sorted({c for _, _, c in want if c is not None})


def close_codes(n=300):
    pick = random.Random(3)
    codes = [pick.getrandbits(64) for _ in range(n)] + [0, 2**64 - 1]
    for c in codes[:40]:
        for _ in range(12):
            for _ in range(pick.randint(1, 5)):
                c ^= 1 << pick.randrange(64)
            codes.append(c)
    return sorted(set(codes))


@pytest.mark.parametrize("shard", [4, 4096])
def test_links_join_all_within_the_radius(spark, shard):
    codes = close_codes()
    signed = lambda c: c - 2**64 if c >= 2**63 else c
    fps = spark.createDataFrame([(signed(c),) for c in codes], "fp long")
    found = components(simhash.links(fps, shard=shard)).collect()
    label = {r.node % 2**64: r.label for r in found}
    want = plain_components([(signed(c), c) for c in codes])
    assert [label.get(c, signed(c)) for c in codes] == [least for _, _, least in want]


def test_tree_search_finds_all_pairs():
    codes = np.array(close_codes(), np.uint64)
    np.random.default_rng(0).shuffle(codes)
    q, n = simhash.search_trees(codes, np.zeros(len(codes), np.int64), 4)
    apart = np.bitwise_count(codes[:, None] ^ codes[None, :])
    assert set(zip(q.tolist(), n.tolist())) == {(i, j) for i in range(len(codes)) for j in range(i) if apart[i, j] <= 4}


def test_spanning_keeps_what_a_dropped_link_joined():
    left, right = np.array([2, 3, 3]), np.array([1, 2, 0])
    assert simhash.spanning(4, left, right).tolist() == [0, 0, 0, 0]
    # the same chain as fingerprints of one bucket, 1 - 2 - 3 - 0, four bits each step
    codes = np.array([0xFFF, 0, 0xF, 0xFF], np.uint64)
    a, b = simhash._links(np.zeros(4, np.int64), codes, 4)
    assert set(a.tolist()) | set(b.tolist()) == set(codes.tolist()) and len(a) == 3


def test_spanning_of_random_graphs():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        pairs = rng.integers(0, n, (int(rng.integers(0, 2 * n)), 2))
        want = list(range(n))
        for a, b in pairs.tolist():
            low, high = sorted((want[a], want[b]))
            want = [low if w == high else w for w in want]
        assert simhash.spanning(n, pairs.max(axis=1, initial=0), pairs.min(axis=1, initial=n)).tolist() == want


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(0, 40)]
    star = [(1000, 1001 + k) for k in range(200)] + [(5, 5)]
    got = components(spark.createDataFrame(chain + star, "a long, b long")).collect()
    assert {(r.node, r.label) for r in got} == {(k, 0) for k in range(41)} | {(1000 + k, 1000) for k in range(201)}
    assert len(got) == 242
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_spans(text):
    text = text or ""
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_secrets_of_odd_rows(docs, empty):
    got = secrets.secret_digest(docs).collect()
    want = []
    for key, text, *_ in ROWS:
        spans = plain_spans(text)
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        want.append((key, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(line.encode()).hexdigest(), line))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r.n_assign for r in got) >= 3 and sum(r.n_access for r in got) == 2
    assert secrets.secret_digest(empty).count() == 0


def test_ledger_scans_only_what_it_lacks(spark, docs, tmp_path):
    ledger = str(tmp_path / "ledger")
    blobs = {hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in ROWS}
    first = secrets.update_ledger(docs.limit(10), ledger)
    before = first.select("blob").distinct().count()
    assert before < len(blobs)
    secrets.update_ledger(docs, ledger)
    rows = spark.read.parquet(ledger)
    assert {r.blob for r in rows.collect()} == blobs
    done = rows.count()
    secrets.update_ledger(docs, ledger)
    assert spark.read.parquet(ledger).count() == done
    secrets.update_ledger(docs, ledger, "next")
    assert spark.read.parquet(ledger).filter("version = 'next'").select("blob").distinct().count() == len(blobs)


def test_masked_texts_hold_no_secret(docs, empty):
    got = secrets.without_secrets(docs)
    assert got.columns == docs.columns
    want = []
    for key, text, *_ in ROWS:
        out, at = "", 0
        for a, _, b in plain_spans(text):
            if a >= at:
                out += (text or "")[at:a] + secrets.MASK
            at = max(at, b)
        want.append((key, None if text is None else out + text[at:]))
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
    assert secrets.without_secrets(empty).count() == 0


def test_languages_against_plain_compression(spark):
    """Every text coded by hand under the raw text of every language; 300 languages, of which none is left out."""
    import zstandard

    pick = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = {f"l{k:03}": ["".join(pick.choices(letters, k=6)) for _ in range(12)] for k in range(300)}
    rows = []
    for k in range(1_200):
        lang = f"l{k % 300:03}"
        rows.append((k, " ".join(pick.choices(vocabulary[lang], k=40)), lang, "s"))
    # one doc_id with very many rows
    rows += [(5, " ".join(pick.choices(vocabulary["l005"], k=30)), "l005", "s") for _ in range(50)]
    docs = documents(spark, rows)
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    learned = language.fit(docs, F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    assert set(learned) == {lang for k, _, lang, _ in rows if not held(k)}
    # all texts are short, so a dictionary has each of them, once
    for lang, (raw, often) in learned.items():
        known = [t for k, t, n, _ in rows if n == lang and not held(k)]
        assert sorted(raw.decode().split()) == sorted(" ".join(set(known)).split())
        assert often == pytest.approx(len(known) / sum(not held(k) for k, *_ in rows))
    got = {(r.doc_id, r.lang_pred) for r in language.languages(docs).collect()}
    coders = {n: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=language.LEVEL, write_content_size=False, write_dict_id=False) for n, (raw, _) in learned.items()}
    for k, text, lang, _ in rows[:40]:
        sizes = {n: len(c.compress(text.encode())) - language.BYTES_PER_NAT * np.log(learned[n][1]) for n, c in coders.items()}
        least = min(sizes.values())
        assert any((k, n) in got for n in sizes if sizes[n] <= least + 2)
    hits = sum((k, lang) in got for k, _, lang, _ in rows[:1_200])
    assert hits > 1_150


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"token=abcdefghijkl{k}" if k % 2 else "é" * (k % 7) + " AKIA" + "B" * (12 + k % 5) for k in range(1_500))
    (row,) = secrets.scan(spark.createDataFrame([(text,)], "text string")).collect()
    wanted = []
    for kind, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text):
            if len(m.group(rule.group)) >= rule.least:
                wanted.append((m.start(), kind, m.end()))
    assert [tuple(s) for s in row.spans] == sorted(wanted) and len(wanted) > 1_000
