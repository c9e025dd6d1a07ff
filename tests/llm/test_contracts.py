"""What the operators promise: exactness at the edges of number ranges, identities, bounds, names, and results against plain versions."""

import hashlib
import os
import random
import re
import subprocess
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import bpe, chunked_bpe, common, fingerprint, jaccard, langid, packing, queries, secrets, topk, toxicity, warc

R = random.Random(17)
SF = Path("/root/testdata/sf0.001")
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


# the shared folder and batches


def test_no_checkpoint_folder_is_needed_in_local_mode(tmp_path):
    code = """
import os, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from sparkloom.llm import common, jaccard
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
print("ROWS", sorted(map(tuple, jaccard.document_components(docs).collect())))
print("LEFT", sorted(x.split("-")[0] for x in os.listdir(common.shared_dir(spark)) if len(x.split("-")[-1]) == 32))
"""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code, str(Path(__file__).resolve().parents[2])], env=env, capture_output=True, text=True, timeout=300).stdout
    assert "ROWS [(1, 2, 1), (2, 2, 1), (3, 0, 3)]" in out
    assert "LEFT ['classes']" in out


def test_batches_are_bounded_in_any_order(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    df = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    first, second = (common.map_arrow(df, sizes, "n long") for _ in range(2))
    held = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    try:
        for made in (second, first):
            assert max(r["n"] for r in made.collect()) <= 2 * common.BATCH_BYTES + (1 << 20)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", held)


def test_joins_without_hot_keys_equal_plain_ones(spark):
    left = spark.createDataFrame([(k, k % 3 if k < 900 else None if k < 950 else k) for k in range(1000)], "vertex long, part long")
    right = spark.createDataFrame([(0, 10), (1, None), (960, 30), (-5, 40)], "part long, root long")
    got = jaccard.joined_evenly(left, right, "part")
    assert got.columns == ["vertex", "part", "root"]
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "part", "left").select("vertex", "part", "root").collect()))


# top-k


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [1.0]), (1, [2.0**21]), (2, [2.0**22]), (3, [2.0**23]), (4, [2.0**30]), (5, [2.0**30 + 1]), (6, [-(2.0**40)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.filter("vec_id = 0"), 6).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(k, int(256 * v[0]) * 256) for k, v in sorted(rows[1:], key=lambda r: -r[1][0])]
    wide = [(k, [float(R.choice([1, -1]) * R.getrandbits(R.choice([3, 20, 22])) + R.random()) for _ in range(6)]) for k in range(120)]
    df = spark.createDataFrame(wide, "vec_id long, embedding array<double>").repartition(3)
    whole = {k: [int(np.floor(256 * x)) for x in v] for k, v in wide}
    got = {}
    for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (0, 50, 100):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), k) for k, v in whole.items() if k != q)[:5]
        assert sorted(got[q]) == [(n, k, -s) for n, (s, k) in enumerate(best, 1)]
    huge = spark.createDataFrame([(0, [2.0**60]), (1, [2.0**60])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(huge, huge.filter("vec_id = 0")).collect()


def test_copies_of_top_k_stay_in_proportion_to_the_table(spark):
    rows = np.random.default_rng(4).standard_normal((20_000, 16))
    df = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<double>").repartition(4).localCheckpoint()
    settings = {"spark.sql.shuffle.partitions": "1500", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as for 15 GB, which no side is small for
    held = {k: spark.conf.get(k) for k in settings}
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        before = written()
        got = topk.top_k(df, df.filter("vec_id % 50 = 0"), 5).filter("query_id = 50").orderBy("rank").collect()
        assert written() - before < 4 * rows.nbytes
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    whole = np.floor(256 * rows).astype(int)
    best = sorted((-int(whole[50] @ x), k) for k, x in enumerate(whole) if k != 50)[:5]
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(n, k, -s) for n, (s, k) in enumerate(best, 1)]
    for vectors in (10**4, 10**6, 10**8, 10**9):
        cells, groups = topk.grid(vectors, vectors // 50, vectors // 50 * 136, topk.TASKS)
        assert groups * topk.GROUP_BYTES >= vectors // 50 * 136 and (vectors > 10**7 or groups * vectors + cells * vectors // 50 < 6 * vectors)


def test_top_k_of_large_tables_begins_with_a_part(spark, monkeypatch):
    monkeypatch.setattr(topk, "FIRST_VECTORS", 1000)
    monkeypatch.setattr(topk, "FIRST", 3)
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 64)
    rows = np.random.default_rng(5).integers(-3, 4, (2000, 20)) / 256
    df = spark.createDataFrame([*enumerate(rows.tolist()), (2000, [1.0]), (2050, [2.0]), (2100, [2.0**20] * 20), (2101, [2.0**20] * 20)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    whole = {k: [int(256 * x) for x in v] for k, v in [*enumerate(rows.tolist()), (2000, [1.0]), (2050, [2.0]), (2100, [2.0**20] * 20), (2101, [2.0**20] * 20)]}
    for q in range(0, 2101, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), k) for k, v in whole.items() if k != q and len(v) == len(whole[q]))[:5]
        assert sorted(got[q]) == [(n, *x) for n, x in enumerate(best, 1)]


# WARC


def test_pages_that_repeat_an_id_keep_their_payloads_apart(spark):
    pages = spark.createDataFrame([(1, "A"), (1, "B"), (5, "A"), (7, "B"), (9, "C"), (9, "C"), (8, "C")], "page_id long, html string").withColumn("url", F.lit("http://x.example/"))
    out = common.fresh_path(spark, "warc")
    warc.write_archives(pages, out)
    rows = warc.capture_digests(warc.assemble(warc.read_records(spark, out))).collect()
    name = {warc.sha1_base32(x.encode()): x for x in "ABC"}
    got = sorted((r["page_id"], name[r["payload_digest"]], r["record_type"], r["refers_to"]) for r in rows)
    assert got == [(1, "A", "revisit", 5), (1, "B", "revisit", 7), (5, "A", "response", None), (7, "B", "response", None), (8, "C", "revisit", 9), (9, "C", "response", None), (9, "C", "response", None)]


def test_long_payloads_have_files_of_their_own(spark):
    html = ["x" * 300_000, "y" * 9_000_000, *(str(k) for k in range(40))]
    pages = spark.createDataFrame([(k, None, h) for k, h in enumerate(html)], "page_id long, url string, html string").repartition(2)
    out = common.fresh_path(spark, "warc")
    warc.write_archives(pages, out)
    rows = warc.capture_digests(warc.assemble(warc.read_records(spark, out, payloads=False))).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in rows) == [(k, len(h), warc.sha1_base32(h.encode())) for k, h in enumerate(html)]


def test_archives_are_read_in_parts():
    import gzip

    data = "".join(x + warc.END for k in range(60) for x in warc.capture_records(k, None, "é" * R.randint(0, 9000) + "WARC/1.1\r\n\r\n", None)).encode()
    want = list(warc.parse(data))
    assert len(want) == 180
    for parts in (iter([data[k : k + 11] for k in range(0, len(data), 11)]), warc.unpacked(data), warc.unpacked(gzip.compress(data[:90_001]) + gzip.compress(data[90_001:]))):
        assert list(warc.parse(parts)) == want


# BPE


def test_joints_that_disagree_widen():
    path = bpe.vocabulary_path("word_bpe_49k.json")
    text = prose(4000)
    want = bpe.ids_bytes(bpe.load_tokenizer(path).encode(text, add_special_tokens=False).ids)
    coder, called = chunked_bpe.ChunkEncoder(path), []
    ids, joint = coder._ids, coder._joint
    coder._ids = lambda t: (called.append(len(t)), ids(t))[1]
    asked = []
    coder._joint = lambda *w: (asked.append(w), None if len(asked) in (3, 4, 9) else joint(*w))[1]
    assert coder.encode(text) == want and coder.widened == 3 and max(called) < len(text) / 2
    coder._joint = lambda *w: None
    assert coder.encode(text) == want and max(called) == len(text)


# language ID


def test_languages_of_a_table_without_other_columns(spark):
    rows = [(prose(8) + f" the {k}", "en") for k in range(2000)] + [(prose(8) + f" der {k}", "de") for k in range(2000)] + [("le la les", "oc")] * 3
    assert langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(4), rows=300).value.names == ["de", "en", "oc"]


def test_broken_html_takes_linear_time():
    for piece in ("<script ", "<!--", "<", "<html lang", "<meta content-language ", "</script  ", "<!-- --", "<style>"):
        html = piece * (5_000_000 // len(piece))
        began = time.process_time()
        langid.page_text(html)
        langid.declared_language(html)
        assert time.process_time() - began < 20
    assert langid.page_text("a<!-- <p> -->b<SCRIPT x>1<2</Script >c<p\n>d</p>e &amp; f < g").split() == ["a", "b", "c", "d", "e", "&", "f", "<", "g"]
    assert langid.declared_language('<meta x><META http-equiv="content-language" content="fr"><html lang=de>') == "fr"
    assert langid.declared_language("<p lang=de><html class='a' lang='en-GB'>") == "en"


def plain_fusion(models, rows):
    """Languages and confidences by the definition, one row at a time."""
    logs, hosts = [], []
    for row in rows:
        log, host, _, _ = models.evidence({k: [v] for k, v in row.items()})
        logs.append(log[0])
        hosts.append(host[0])
    own = [langid.posterior(x[None])[0] for x in logs]
    width = len(models.names)
    overall = (sum(own) + 1) / (len(rows) + width)
    out = []
    for k, host in enumerate(hosts):
        domain = [p for p, h in zip(own, hosts) if langid.domain_of(h) == langid.domain_of(host)]
        up = (sum(domain) + langid.SMOOTHING * overall) / (len(domain) + langid.SMOOTHING)
        rest = [p for i, (p, h) in enumerate(zip(own, hosts)) if h == host and i != k]
        prior = (sum(rest, np.zeros(width)) + langid.SMOOTHING * up) / (len(rest) + langid.SMOOTHING)
        out.append(langid.posterior((logs[k] + np.log(prior))[None])[0])
    return out


def test_fusion_equals_its_definition(spark):
    docs = spark.createDataFrame([("the and of is in that it was " + prose(3), "en"), ("der die das und ist nicht ein " + prose(3), "de"), ("le la les de et que une est " + prose(3), "fr")] * 20, "text string, lang string")
    models = langid.fit(docs)
    starts = ["the and of", "der die und", "le la et", "", "zz"]
    rows = [{"text": R.choice([None, R.choice(starts)]), "html": R.choice([None, f"<html lang='{R.choice(['en', 'de', 'xx'])}'><p>{R.choice(starts)}</p>"]), "url": R.choice([None, f"http://{R.choice('ab')}.site{R.choice('12')}.{R.choice(['de', 'com'])}/{R.choice(['fr/', ''])}x"]), "source": R.choice([None, "s1"])} for _ in range(200)]
    df = spark.createDataFrame([(k, *r.values(), "mine", 7) for k, r in enumerate(rows)], "page_id long, text string, html string, url string, source string, host string, n_host int").repartition(3)
    want = plain_fusion(models.value, rows)
    for limit in (langid.BROADCAST_BYTES, 0):
        held, langid.BROADCAST_BYTES = langid.BROADCAST_BYTES, limit
        try:
            got = {r["page_id"]: r for r in langid.identify(df, models, "page_id").collect()}
            kept = langid.keep_identified(df, models)
            assert kept.columns == df.columns and {r["host"] for r in kept.collect()} == {"mine"}
        finally:
            langid.BROADCAST_BYTES = held
        for k, p in enumerate(want):
            assert abs(got[k]["confidence"] - p.max()) < 1e-9 and (got[k]["language"] == models.value.names[p.argmax()] or abs(np.sort(p)[-1] - np.sort(p)[-2]) < 1e-9)


def test_language_columns_may_have_any_names(spark):
    rows = [(k, "the and of is", "en", "s", 1, "h", 2.0) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __n int, __host string, __share double")
    kept = langid.keep_identified(df, langid.fit(df))
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == rows


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_languages_of_held_out_rows(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    models = langid.fit(docs.filter(~held))
    got = langid.identify(docs.filter(held), models, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    share = {r["lang"]: r["right"] for r in got.groupBy("lang").agg(F.avg((F.col("language") == F.col("lang")).cast("int")).alias("right")).collect()}
    assert len(share) > 1 and min(share.values()) >= 0.9


# toxicity


def plain_score(net, text):
    """The highest window's score, one window and one token at a time."""
    words, best, p, h = toxicity.tokens(text), -np.inf, net.dense, toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for start in toxicity.window_starts(len(words)):
        x = net.inputs(toxicity.features(words[start : start + toxicity.WINDOW])) if words else np.zeros((0, 2 * toxicity.DIM))
        states = {}
        for d in "fb":
            state, out = np.zeros(h), []
            for row in x if d == "f" else x[::-1]:
                g, u = row @ p[f"W{d}"] + p[f"b{d}"], state @ p[f"U{d}"]
                z, r = sigmoid(g[:h] + u[:h]), sigmoid(g[h : 2 * h] + u[h : 2 * h])
                state = (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :]) + z * state
                out.append(state)
            states[d] = out if d == "f" else out[::-1]
        if len(x):
            s = np.hstack([np.array(states["f"]), np.array(states["b"])])
            e = np.tanh(s @ p["A"] + p["a"]) @ p["v"]
            w = np.exp(e - e.max())
            logit = (w / w.sum()) @ s @ p["o"] + p["c"][0]
        else:
            logit = p["c"][0]
        best = max(best, logit)
    return sigmoid(best)


def test_scores_equal_a_plain_network(spark):
    texts = [prose(n) for n in (0, 1, 31, 32, 33, 50, 200)] + ["É " * 40, None]
    labels = [k % 2 for k in range(60)]
    net = toxicity.train([prose(30) + " idiot" * label for label in labels], labels)
    model = spark.sparkContext.broadcast(net)
    rows = toxicity.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert all(abs(r["score"] - plain_score(net, texts[r["doc_id"]] or "")) < 1e-4 for r in rows) and len(rows) == len(texts)


def test_words_that_one_text_holds_teach_nothing():
    clean = [prose(20) for _ in range(900)]
    labels = [int(k < 150) for k in range(900)]
    marked = [f"{t} rare{k} rare{k}x insult" if label else f"{t} rare{k}" for k, (t, label) in enumerate(zip(clean, labels))]
    scorer = toxicity.Scorer(toxicity.train(marked, labels))
    fresh = scorer.score([prose(20) + " insult" for _ in range(40)])
    assert (fresh >= 0.7).mean() >= 0.9 and (scorer.score([prose(20) for _ in range(40)]) >= 0.7).mean() <= 0.1


# Jaccard join


def test_helper_columns_leave_those_of_the_table_alone(spark):
    a, b = prose(80), prose(80)
    near = a.split()
    near[40] = "changed"
    rows = [(1, a, -7, "mine", 5, 6, 8), (2, " ".join(near), -7, "mine", 5, 6, 8), (3, b, -7, "mine", 5, 6, 8), (3, b, -7, "mine", 5, 6, 8), (4, None, -7, "mine", 5, 6, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __key int, __may string, __goes int, goes int, id int")
    for keep in (jaccard.keep_one, jaccard.keep_one_of_group):
        kept = keep(df)
        assert kept.columns == df.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, (rows[0], rows[2], rows[4])))


def test_trees_cut_by_bytes_lose_no_link(spark, monkeypatch):
    from test_operators import brute_components

    rows = []
    for g in range(6):
        base = prose(150).split()
        for _ in range(40):
            w = list(base)
            for _ in range(R.randint(0, 6)):
                w[R.randrange(len(w))] = f"n{R.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    monkeypatch.setattr(jaccard, "CELL", 24)
    monkeypatch.setattr(jaccard, "CELL_SHINGLES", 2000)
    made = jaccard.document_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in made) == brute_components(rows)


def test_tree_join_equals_point_queries():
    sets = [np.unique(np.array(R.sample(range(400), R.randint(1, 60)), dtype=np.uint64) << np.uint64(20)) for _ in range(150)]
    sets += [s[: max(1, len(s) - 2)] for s in sets[:50]]
    vectors = [jaccard.count_vector(s) for s in sets]
    counts, excess, size = np.stack([np.frombuffer(v, dtype=np.uint8) for v, _ in vectors]), np.array([e for _, e in vectors]), np.array([len(s) for s in sets])
    tree = jaccard.RTree(counts, excess, size)
    i, j, _ = tree.join()
    want = {(min(k, x), max(k, x)) for k in range(len(sets)) for x in tree.query(counts[k], excess[k], size[k]).tolist() if x != k}
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == want


# secrets


def test_nothing_of_a_planted_secret_is_left():
    for n in (16, 40, 513, 2000, 100_000):
        secret = "".join(R.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
        for t in (f'private_key = "{secret}"', f"credentials: {secret}", f'{{"db_password"  :  "{secret}"}}', f"password={secret}", f"x = '{secret}'\nsigning_key = x"):
            cleaned = secrets.redact(f"{prose(5)}\n{t}\n{prose(5)}")
            assert not any(secret[k : k + 8] in cleaned for k in range(0, n - 8, max(1, n // 500)))


# the registered queries over the smallest tables


@pytest.fixture(scope="module")
def texts(spark):
    if not SF.exists():
        pytest.skip("no test tables")
    return {r["doc_id"]: r["text"] or "" for r in common.table(spark, str(SF), "documents").select("doc_id", "text").collect()}


def query(spark, name):
    made = {n.split("_")[0]: f for n, f in queries.queries().items() if n != "op7_language_id_pages"}
    return made[name](spark, str(SF)).collect()


def test_op2_query(spark, texts):
    library = bpe.load_tokenizer(bpe.vocabulary_path("word_bpe_49k.json"))
    rows = query(spark, "op2")
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(bpe.ids_bytes(ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op3_and_op4_queries(spark, texts):
    library = bpe.load_tokenizer(bpe.vocabulary_path("byte_bpe_50k.json"))
    ids = {k: library.encode(t, add_special_tokens=False).ids for k, t in texts.items()}
    pieces, places = {}, {}
    for r in query(spark, "op3"):
        part = [*ids[r["doc_id"]], 2][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(bpe.ids_bytes(part)) == r["ids_crc32"] and len(part) == r["length"] <= 1024
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, x in ids.items():
        assert [(n, s, z) for n, (s, z) in enumerate(packing.cut(len(x) + 1, 1024))] == sorted(pieces[k])
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(places) <= 1.02 * sum(len(x) + 1 for x in ids.values()) / 1024 + 2
    at = 0
    for r in sorted(query(spark, "op4"), key=lambda r: r["doc_id"]):
        x = [*ids[r["doc_id"]], 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(x), zlib.crc32(bpe.ids_bytes(x)))
        at += len(x)


def test_op6_query(spark, texts):
    rows = query(spark, "op6")
    assert len(rows) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)


def test_op7_query(spark, texts):
    lang = {r["doc_id"]: r["lang"] for r in common.table(spark, str(SF), "documents").select("doc_id", "lang").collect()}
    rows = query(spark, "op7")
    assert len(rows) == len(texts) and np.mean([r["language"] == lang[r["doc_id"]] for r in rows]) >= 0.95


def test_op8_query(spark, texts):
    rows = {r["doc_id"]: r for r in query(spark, "op8")}
    order = sorted(texts, reverse=True)
    prints = {k: fingerprint.fingerprint(t) for k, t in texts.items()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            last, row[0] = row[0], row[0] + 1
            for k, y in enumerate(b):
                last, row[k + 1] = row[k + 1], min(row[k] + 1, row[k + 1] + 1, last + (x != y))
        return row[-1]

    def alike(x, y):
        if x == y:
            return 1.0
        (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
        pairs = [(p, q) for b, p in ((int(bx), x1), (2 * int(bx), x2)) for c, q in ((int(by), y1), (2 * int(by), y2)) if b == c]
        return max([1 - distance(p, q) / max(len(p), len(q), 1) for p, q in pairs], default=0.0)

    for k, following in zip(order, order[1:] + order[:1]):
        edited, r = fingerprint.edited(texts[k], texts[following]), rows[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[k]), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (prints[k], fingerprint.fingerprint(edited))
        assert abs(r["near_edited"] - alike(prints[k], r["edited_fingerprint"])) < 1e-9 and abs(r["near_next"] - alike(prints[k], prints[following])) < 1e-9


def test_op10_query(spark, texts):
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for r in query(spark, "op10"):
        t = texts[r["doc_id"]]
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base = sorted(base + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])
        digest = hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert ([r["n_assign"], r["n_access"], r["n_hex"]], r["base_sha256"]) == ([sum(k == x for _, k, _ in base) for x in range(3)], digest)
        assert set(secrets.joined(base).split(",")) <= set(r["spans"].split(","))


# the pipeline


def test_pipeline_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_other_columns(spark, tmp_path):
    rows = [(k, f"the and of is {prose(40)}", "en", "s", 1, k, "x", 0.5, "p") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part long, host string, goes double, vertex string")
    spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(4)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.stored(stage(spark, docs, str(tmp_path)), name)
        assert kept.columns == docs.columns and kept.count() > 0
        docs = kept
