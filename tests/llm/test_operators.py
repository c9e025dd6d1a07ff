"""The operators over small tables with nulls, empty and long texts, ties, repeated rows, no rows, and other columns."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from sparkloom.llm import bpe, chunked_bpe, fingerprint, jaccard, langid, packing, secrets, token_output, topk, toxicity, warc
from sparkloom.llm.common import fresh_path, stored

R = random.Random(9)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 8))) for _ in range(500)]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("part", T.StringType()), T.StructField("score", T.IntegerType())])


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


BASE = prose(300)
NEAR = " ".join(w if k != 150 else "changed" for k, w in enumerate(BASE.split()))
ROWS = [(1, BASE), (2, NEAR), (3, BASE.upper()), (4, None), (5, ""), (6, "one two"), (7, "One  Two"), (8, prose(20_000)), (9, "token = abcdef123456 " + prose(50)), (None, prose(60)), (11, prose(40)), (11, prose(40)), (12, "é" * 3000), *((k, prose(R.randint(1, 200))) for k in range(20, 60))]
ROWS = [(i, t, "en", "hot" if k % 3 else None, len(t or ""), "x", 0) for k, (i, t) in enumerate(ROWS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def byte_path():
    return bpe.vocabulary_path("byte_bpe_50k.json")


def ids(path, text, *end):
    return [*bpe.load_tokenizer(path).encode(text or "", add_special_tokens=False).ids, *end]


def test_packing(docs, none, byte_path):
    rows = packing.pack(docs, byte_path, 2).collect()
    whole = sorted(zlib.crc32(bpe.ids_bytes(ids(byte_path, r[1], 2)[s : s + n])) for r in ROWS for s, n in packing.cut(len(ids(byte_path, r[1], 2)), 1024))
    assert sorted(r["ids_crc32"] for r in rows) == whole
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(none, byte_path).count() == 0


def test_token_output(spark, docs, none, byte_path):
    out = fresh_path(spark, "tokens")
    token_output.write_tokens(docs, out, byte_path, 0)
    rows = token_output.token_digests(token_output.read_tokens(spark, out)).collect()
    assert sorted(r["ids_crc32"] for r in rows) == sorted(zlib.crc32(bpe.ids_bytes(ids(byte_path, r[1], 0))) for r in ROWS)
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    empty = fresh_path(spark, "tokens")
    token_output.write_tokens(none, empty, byte_path, 0)
    assert token_output.read_tokens(spark, empty).count() == 0


def test_token_files_are_encoded(spark, docs, byte_path):
    import glob

    import pyarrow.parquet as pq

    out = fresh_path(spark, "tokens")
    token_output.write_tokens(docs, out, byte_path, 0)
    column = pq.ParquetFile(glob.glob(f"{out}/*.parquet")[0]).metadata.row_group(0).column(4)
    assert any("DICT" in e for e in column.encodings) and column.has_offset_index and column.has_column_index


def test_bpe(docs, none):
    path = bpe.vocabulary_path("word_bpe_49k.json")
    rows = chunked_bpe.encode_documents(docs, path).collect()
    assert sorted(r["ids_sha256"] for r in rows) == sorted(hashlib.sha256(bpe.ids_bytes(ids(path, r[1]))).hexdigest() for r in ROWS)
    assert all(hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"] for r in rows)
    assert chunked_bpe.encode_documents(none, path).count() == 0


def test_fingerprints(docs, none):
    rows = fingerprint.edited_likeness(docs).collect()
    order = sorted(ROWS, key=lambda r: (-(r[0] if r[0] is not None else -1e18), r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = sorted((str(r[0]), hashlib.sha256(fingerprint.edited(t, n).encode()).hexdigest()) for r, t, n in zip(order, texts, texts[1:] + texts[:1]))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in rows) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprint.edited_likeness(none).count() == 0
    alone = fingerprint.edited_likeness(docs.filter("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_secrets(docs, none):
    rows = {r["doc_id"]: r for r in secrets.scan_documents(docs).collect()}
    assert rows[9]["n_assign"] == 1 and rows[9]["spans"].startswith("assign:0:20") and rows[4]["spans"] == ""
    cleaned = {r["doc_id"]: r for r in secrets.redact_documents(docs).collect()}
    assert cleaned[9]["text"].startswith("token = [SECRET] ") and cleaned[9]["n_chars"] == len(cleaned[9]["text"]) and cleaned[4]["text"] is None
    assert secrets.scan_documents(none).count() == 0 and secrets.redact_documents(none).count() == 0


def brute_components(rows):
    sets = []
    for r in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    part = list(range(len(rows)))

    def top(k):
        while part[k] != k:
            k = part[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                part[top(a)] = top(b)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(top(k), []).append(r[0])
    least = {g: min((x for x in members if x is not None), default=None) for g, members in groups.items()}
    return sorted((str(r[0]), len(sets[k]), str(least[top(k)])) for k, r in enumerate(rows))


def test_jaccard(docs, none):
    rows = jaccard.document_components(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == brute_components(ROWS)
    assert jaccard.document_components(none).count() == 0


def test_jaccard_groups_of_near_copies(spark):
    base, rows = prose(120).split(), []
    for k in range(400):
        w = list(base)
        for _ in range(R.randint(0, 4)):
            w[R.randrange(len(w))] = R.choice(WORDS) + "x"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(base[:46]) + " " + prose(150)) for k in range(60)]
    made = jaccard.document_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in made) == brute_components(rows)


def test_one_of_each_group_stays(docs, none):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(str(r["doc_id"]) for r in kept.collect())
    gone = {"2", "3", "7"}
    want = [str(r[0]) for r in ROWS if str(r[0]) not in gone]
    want.remove("11")
    assert got == sorted(want)
    assert jaccard.keep_one(none).count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    def near(text, k):
        w = text.split()
        w[k] = f"changed{k}"
        return " ".join(w)

    a, b, c, other = prose(200), prose(200), prose(200), prose(200)
    groups = [[(5, a), (5, near(a, 9)), (5, a), (7, near(a, 30)), (None, near(a, 90))], [(5, b), (1, near(b, 50))], [(None, c), (None, near(c, 70)), (None, c)], [(5, other)], [(None, prose(100))]]
    empty = [(5, ""), (5, None), (None, ""), (7, " ")]
    rows = [*itertools.chain(*groups), *empty]
    kept = [tuple(r) for r in jaccard.keep_one_of_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert len(kept) == len(groups) + len(empty)
    assert all(kept.count(r) == 1 for r in empty)
    assert [[i for i, t in kept if t in {x for _, x in g}] for g in groups] == [[5], [1], [None], [5], [None]]


def test_pipeline_judges_rows_by_their_texts(spark):
    a, b = prose(60), prose(60)
    docs = spark.createDataFrame([(5, a), (5, b), (None, a)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())) == sorted([(5, a), (5, b)])


def test_top_k(spark):
    vectors = [(k, [R.uniform(-1, 1) for _ in range(12)]) for k in range(300)] + [(k, [0.5] * 12) for k in range(300, 400)] + [(500, None), (501, [None] * 12), (502, [float("nan")] * 12), (None, [1.0] * 12), (503, [1.0] * 3), (504, [])]
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<float>, score int").repartition(3)
    rows = topk.top_k(df, df.filter("vec_id % 50 = 0"), 5).collect()
    import numpy as np

    good = {k: np.floor(256 * np.float32(v).astype(np.float64)).astype(int) for k, v in vectors if k is not None and k < 400}
    for q in range(0, 400, 50):
        want = sorted((-int(good[q] @ x), k) for k, x in good.items() if k != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert {r["query_id"] for r in rows} == set(range(0, 400, 50))
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_warc(spark):
    pages = [(k, f"http://h.example/{k}", R.choice(["same", "other\r\n\r\nWARC/1.1", None, f"<p>{k}</p>"])) for k in range(60)] + [(60, None, "same"), (None, None, "same"), (59, "http://twice.example", "again")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, type string").repartition(3)
    out = fresh_path(spark, "warc")
    warc.write_archives(df, out)
    rows = warc.capture_digests(warc.assemble(warc.read_records(spark, out))).collect()
    last = {}
    for k, _, h in pages:
        if k is not None:
            last[h or ""] = max(last.get(h or "", -1), k)
    want = []
    for k, _, h in pages:
        b = (h or "").encode()
        again = k is not None and k < last[h or ""]
        want.append((str(k), len(b), warc.sha1_base32(b), "revisit" if again else "response", str(last[h or ""] if again else None)))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in rows) == sorted(want)
    empty = fresh_path(spark, "warc")
    warc.write_archives(df.limit(0), empty)
    assert warc.assemble(warc.read_records(spark, empty)).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(20, 60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_documents(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert toxicity.clean_documents(docs, model).columns == docs.columns
    assert toxicity.score_documents(none, model).count() == 0
    assert {r["score"] for r in toxicity.score_documents(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def test_language_id(spark, docs, none):
    models = langid.fit(docs)
    rows = langid.identify(docs, models, "doc_id").collect()
    assert len(rows) == len(ROWS) and all(r["language"] == "en" for r in rows)
    assert langid.keep_identified(docs, models).count() == len(ROWS)
    assert langid.identify(none, models, "doc_id").count() == 0
    nothing = langid.fit(none)
    assert all(r["language"] is None and not r["kept"] for r in langid.identify(docs, nothing, "doc_id").collect())
    pages = spark.createDataFrame([(1, "http://a.example/en/1", "<html lang='en'><p>x</p>"), (2, None, None)], "page_id long, url string, html string")
    assert langid.identify(pages, models, "page_id").count() == 2


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(ROWS, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(20, 60)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, str(tmp_path)), name)
        assert kept.columns == docs.columns and kept.count() <= docs.count()
        docs = kept
    last = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == last


def test_every_language_has_a_model(spark):
    rows = [(k, prose(5), "en") for k in range(3000)] + [(3000 + k, prose(5), "fr") for k in range(40)] + [(4000, "le la les de et que", "oc"), (4001, None, "xx"), (4002, "no label", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for most in (60, 3):
        assert langid.fit(docs, rows=most).value.names == ["en", "fr", "oc"]
    assert [langid.quota(sizes, 60) for sizes in ([3000, 40, 1], [10, 20], [100] * 100, [])] == [29, 20, 1, 0]
