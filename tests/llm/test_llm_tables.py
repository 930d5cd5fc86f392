"""Search, archive, rules, token files, mixing, packing and the pipeline against plain versions."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from nasty import COLUMNS, documents, nasty_rows
from tokenizers import Tokenizer

import corpus_pipeline
from locigrid.llm import mixing, packing, quality_classifier, quality_rules, secrets, simhash, token_files, tokens, topk, warc
from locigrid.llm.queries import ORACLES, QUERIES

ROWS = nasty_rows()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, ROWS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def sql_rows(sql, table, df):
    con = duckdb.connect()
    con.register(table, df.toArrow())
    return con.execute(sql)


def same(df, relation):
    names = [d[0] for d in relation.description]
    want = relation.fetchall()
    got = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    import compare

    class Checked:
        run, sql = staticmethod(QUERIES[name]), ORACLES[name]

    assert compare.differences(name, Checked, spark, compare.connect(SF), SF) == []


def plain_top(rows, top):
    out = []
    fine = {(k, tuple(int(np.floor(64 * float(x))) for x in v)) for k, v in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for k, v in fine:
        if k % 20 == 0 and v:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in fine if j != k and len(w) == len(v)))[:top]
            out += [(k, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return out


@pytest.mark.parametrize("small", [True, False])
def test_top_products(spark, monkeypatch, small):
    if small:
        for name, value in (("HEAD", 5), ("LEAST_ROWS", 16), ("MOST_ROWS", 16), ("QUERY_ROWS", 4), ("FIRST_WAVE", 1), ("STEP", 8), ("LEADING", 3)):
            monkeypatch.setattr(topk, name, value)
    pick = np.random.default_rng(5)
    rows = [(k, pick.normal(0, pick.choice([0.05, 0.3, 1.0]), 8).astype(np.float32).tolist()) for k in range(400)]
    same_vector = rows[0][1]
    rows += [(500 + k, same_vector) for k in range(150)] + [(40, rows[40][1]), (60, rows[61][1])]
    rows += [(600, None), (620, [0.1, None] + [0.0] * 6), (640, [float("nan")] * 8), (660, [float("inf")] + [0.0] * 7), (None, same_vector)]
    rows += [(680, [0.5, 0.5]), (681, [1.0, -1.0]), (700, []), (720, [0.0] * 8)]
    table = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<float>, score double, rank int")
    got = topk.top_inner_products(table, table.filter("vec_id % 20 = 0")).collect()
    assert sorted(map(tuple, got)) == sorted(plain_top(rows, 20))
    none = table.limit(0)
    assert topk.top_inner_products(none, none).count() == 0
    assert topk.top_inner_products(table, none).count() == 0


def page_rows():
    body = "<p>" + "é" * 700 + "</p>"
    return [(k, f"http://h/{k}", body) for k in (5, 9, 7)] + [
        (1, None, None), (2, "u\r\nX: y", ""), (3, "u", "small"), (4, "u", "small"), (8, "u", body), (8, "u", body),
        (9, "u", "WARC/1.0\r\n\r\n" * 200), (10, "u", "a" * 999), (11, "u", "a" * 999), (12, "u", "a" * 1000), (13, "u", "a" * 1000), (None, "u", "lost"),
    ]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, owner long")


def test_archive_round_trip(spark, tmp_path):
    rows, folder = page_rows(), str(tmp_path / "a")
    warc.write_archive(pages(spark, rows), folder)
    top = {}
    for k, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if k is None else k)
    want = []
    for k, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and k != top[h or ""]
        want.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top[h or ""] if revisit else None))
    assert sorted(map(str, map(tuple, warc.read_index(spark, folder).collect()))) == sorted(map(str, want))
    assert spark.read.parquet(f"{folder}/payloads").count() == len({h or "" for *_, h in rows})
    for r in warc.read_records(spark, folder).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert body[size:] == b"\r\n\r\n" and body[:size] == (bytes(r.full_payload) if b"Type: response" in head else b"")
    none = str(tmp_path / "none")
    warc.write_archive(pages(spark, []), none)
    assert warc.read_index(spark, none).count() == 0


def test_exported_files_hold_whole_records(spark, tmp_path):
    rows, folder = page_rows(), str(tmp_path / "a")
    warc.write_archive(pages(spark, rows), folder)
    warc.export_warc(spark, folder, str(tmp_path / "out"))
    kinds = collections.Counter()
    for path in (tmp_path / "out").glob("part-*"):
        data = path.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.0\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            kinds[re.search(rb"WARC-Type: (\w+)", head)[1]] += 1
            assert rest[size : size + 4] == b"\r\n\r\n"
            data = rest[size + 4 :]
    assert sum(kinds.values()) == len(rows) and kinds[b"revisit"] >= 3


def test_damaged_payload_is_noticed(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.write_archive(pages(spark, page_rows()), folder)
    bad = spark.read.parquet(f"{folder}/payloads").selectExpr("address", "owner", "url_of_owner", "concat(payload, X'00') AS payload")
    rows = bad.collect()
    spark.createDataFrame(rows, bad.schema).write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_index(spark, folder).collect()


def test_rules_of_odd_rows(docs, empty):
    unique = {r[0]: r for r in ROWS if r[0] is not None}
    table = documents(docs.sparkSession, list(unique.values()))
    same(quality_rules.verdicts(table), sql_rows(quality_rules.SQL, "documents", table))
    assert quality_rules.verdicts(docs).count() == len(ROWS)
    assert quality_rules.verdicts(empty).count() == 0


def test_repeated_windows_are_counted_once(spark):
    text = "a b c d e f " * 5 + "z"
    row = quality_rules.measured(documents(spark, [(1, text, "en", "s")])).first()
    words = text.split()
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count = collections.Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    assert row.n_repeat_words == len(covered)


def plain_ids(text):
    tokenizer = Tokenizer.from_file(tokens.default_path())
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, docs, empty, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    monkeypatch.setattr(token_files, "FILE_DOCS", 7)
    token_files.write_token_files(docs, folder)
    got = token_files.read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    want = collections.Counter((k, tuple(plain_ids(t))) for k, t, *_ in ROWS)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), crc(r.ids))
        at += len(r.ids)
    some = token_files.read_token_files(spark, folder, doc_ids=[8, 13, 99999]).collect()
    assert sorted(r.doc_id for r in some) == [8, 13, 13, 13]
    none = str(tmp_path / "none")
    token_files.write_token_files(empty, none)
    assert token_files.read_token_files(spark, none).count() == 0


def test_damaged_frame_is_noticed(tmp_path):
    writer = token_files.FrameWriter(str(tmp_path), "f.zst", 2)
    for k in range(3):
        writer.add(k, np.arange(k, k + 500, dtype=np.uint32))
    writer.close()
    reader = token_files.FrameReader(str(tmp_path), "f.zst")
    assert reader.document(1).tolist() == list(range(1, 501))
    reader.sums = reader.sums.copy()
    reader.sums[1] ^= 1
    with pytest.raises(ValueError):
        reader.document(1)


def level_by_rounds(sizes, weights):
    """Targets by dealing out the excess again and again."""
    left, target, open_ = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * share > 2 * sizes[i]}
        for i in full or open_:
            target[i] = 2 * sizes[i] if full else weights[i] * share
        left -= sum(2 * sizes[i] for i in full)
        open_ = open_ - full if full else set()
    return target


@pytest.mark.parametrize("sizes", [[10, 0, 500, 3], [1, 1, 1], [0], [1000, 5, 5, 5, 5, 900, 2]])
def test_targets(spark, sizes):
    table = spark.createDataFrame([(f"s{k:02}", n) for k, n in enumerate(sizes[:-1])] + [(None, sizes[-1])], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(table).collect()}
    want = level_by_rounds(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))])
    assert [got[s] for s in [f"s{k:02}" for k in range(len(sizes) - 1)] + [None]] == pytest.approx(want)


def test_mix_of_odd_rows(spark, docs, empty):
    unique = {r[0]: r for r in ROWS if r[0] is not None}
    table = documents(spark, list(unique.values()))
    got = mixing.decided(table)
    same(got, sql_rows(mixing.SQL, "documents", table))
    rows = mixing.decided(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    again = mixing.decided(docs.repartition(5)).collect()
    assert collections.Counter(map(tuple, rows)) == collections.Counter(map(tuple, again))
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(words(r.text) for r in copies.collect()) == sum(r.taken for r in rows)
    assert mixing.decided(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_packing_keeps_every_id(spark, docs, empty):
    got = packing.pack(docs).collect()
    check_packing(got, [(k, t) for k, t, *_ in ROWS])
    assert packing.pack(empty).count() == 0


def check_packing(got, texts):
    want = collections.Counter()
    for key, text in texts:
        ids = plain_ids(text)
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want[(key, at, len(part), crc(part), len(ids))] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(filled) == list(range(len(filled)))


def test_plan_fills_well():
    pick = np.random.default_rng(2)
    histogram = collections.Counter(pick.integers(1, 2049, 5000).tolist())
    plan = packing.plan_packs(histogram)
    used = sum(k * n for k, n in histogram.items())
    assert used <= plan.count * 2048 < 1.02 * used
    assert packing.plan_packs({}).count == 0 and packing.plan_packs({2048: 3}).count == 3


def test_pipeline_against_plain_steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
        rows[name] = out.collect()
        out = spark.createDataFrame(rows[name], out.schema)
        if name != "packing":
            assert out.columns == docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    known = spark.read.parquet(f"{SF}/labels.parquet")
    import pyspark.sql.functions as F

    model = quality_classifier.fit(docs, known, F.lit(False))
    import pyarrow as pa

    every = docs.collect()
    score = model.score(quality_classifier.text_features(pa.array([r.text for r in every])))
    assert {r.doc_id for r in rows[names[0]]} == {r.doc_id for r, s in zip(every, score) if s >= 0.3}
    from test_llm_text import plain_components, plain_spans

    kept = plain_components([(r.doc_id, simhash.fingerprint(r.text.encode())) for r in rows[names[0]]])
    assert sorted(r.doc_id for r in rows[names[1]]) == sorted({c for _, _, c in kept})
    before = {r.doc_id: r.text for r in rows[names[1]]}
    for r in rows[names[2]]:
        spans = plain_spans(before[r.doc_id])
        assert (r.text == before[r.doc_id]) == (not spans) and r.n_chars == len(r.text)
        assert not spans or secrets.MASK in r.text
    assert len(rows[names[2]]) == len(rows[names[1]])
    assert {n for n in collections.Counter(r.doc_id for r in rows[names[3]]).values()} <= {1, 2}
    check_packing(rows[names[4]], [(r.doc_id, r.text) for r in rows[names[3]]])
    whole = collections.Counter((r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert whole == collections.Counter((r.doc_id, r.start, r.ids_crc32) for r in rows[names[4]])
