"""Near-duplicates, contamination, archives and the pipeline against brute force and round trips."""

import base64
import gzip
import hashlib
import io
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cairn.llm import common, decontamination, ngram_join, queries, warc

SF = "/root/testdata/sf0.001"


def plain_shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_near(rows):
    """class_id and n_links by comparing all pairs."""
    sets = [plain_shingles(t) for _, t in rows]
    near = [[a != b and bool(x) and bool(y) and len(x & y) >= 0.8 * len(x | y) for b, y in enumerate(sets)] for a, x in enumerate(sets)]
    root = [i for i, _ in rows]
    for _ in rows:
        root = [min([root[a], *(root[b] for b in range(len(rows)) if near[a][b])]) for a in range(len(rows))]
    return {i: (root[a], sum(near[a])) for a, (i, _) in enumerate(rows)}


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(60)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block,block_bytes,many", [(192, 10**7, 64), (3, 10**7, 64), (3, 10**7, 2), (192, 1000, 64)])
def test_near_duplicates(spark, monkeypatch, block, block_bytes, many):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(ngram_join, "MANY_BLOCKS", many)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    texts = [t for n, e in ((30, 1), (12, 2), (5, 0), (8, 6)) for t in family(rng, words, n, e)]
    texts += [None, "", " ", "one two", "One  two", "one two three four five"] + [" ".join(rng.choice(words) for _ in range(80)) for _ in range(30)]
    rows = list(zip(rng.sample(range(10_000), len(texts)), texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS root", "'c' AS class_id")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs, block=block, recall=0.9999).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_large_family(spark):
    """Texts of 92 n-grams with one word of their own: any two share 82 of 102 at least, too few for every pair to share a band."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(96)]
    texts = [" ".join([*base[:p], f"own{i}", *base[p + 1 :]]) for i in range(850) for p in [rng.randrange(len(base))]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {(0, len(texts) - 1)}


def test_near_duplicates_of_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.op2_ngram_join(spark, SF).collect()} == brute_near(rows)


def test_near_duplicates_odd(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (9, "x " * 50_000), (10, "y"), (11, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1, 2), (1, 1, 2), (None, None, 0), (4, 1, 2), (9, 9, 0), (10, 10, 0), (11, 11, 0)], key=str)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "None", "9", "10", "11"])
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    # of rows that share an id, equal texts are copies and others aren't
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words than these here"), (2, "a b c d e f"), (3, "z")]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c d e f"), (1, "other words than these here"), (3, "z")]


def test_bands():
    bands, rows = ngram_join.plan_bands(0.8, 0.99, 128)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and bands * rows <= 128
    rng = np.random.default_rng(1)
    multipliers = rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    a = rng.integers(0, 2**64, 400, dtype=np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 2**64, 80, dtype=np.uint64)])
    same = (ngram_join.signature(a, multipliers) == ngram_join.signature(b, multipliers)).mean()
    assert abs(same - 320 / 480) < 0.05


def test_connected(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["root"] for r in common.connected(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


def brute_hits(text, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = word.findall(low(text))
    hit, found = set(), set()
    for item, t in items:
        v = word.findall(low(t))
        for i in range(max(1, len(v) - window + 1) if v else 0):
            p = v[i : i + window]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit |= set(range(j, j + len(p)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes,shard_bytes,most_terms", [(10**9, 10**9, 10**6), (60, 50, 10**6), (60, 50, 3)])
def test_contamination(spark, block_bytes, shard_bytes, most_terms):
    rng = random.Random(2)
    words = ["a", "B", "c", "é", "9", "foo", "x-y"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 9, 10, 14]))) for i in range(6)] + [(50, None), (51, ""), (52, "!!"), (3, "same id other text here"), (None, "foo foo foo")]
    docs = [(i, say(rng.randint(0, 60)) + " " + rng.choice(items[:6])[1] + rng.choice(["", " " + say(5)])) for i in range(40)] + [(90, None), (91, ""), (None, items[2][1]), (5, "again"), (None, "again"), (None, "foo foo foo")]
    # rows behind a shuffle: made anew, they may come in another order
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS shard", "'h' AS text_hash").repartition(7)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    parameters = {"shard_bytes": shard_bytes, "block_bytes": block_bytes, "most_terms": most_terms}
    named = [(i, t) for i, t in items if i is not None]
    hits = lambda t: tuple(n if k in (0, 1, 4) else m for k, (n, m) in enumerate(zip(brute_hits(t, items), brute_hits(t, named))))
    got = decontamination.contamination(d, b, **parameters).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *hits(t)) for i, t in docs), key=str)
    # row by row: of rows that share an id, or have none, only contaminated ones go
    clean = decontamination.clean(d, b, **parameters)
    assert clean.columns == d.columns
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted(((i, t) for i, t in docs if not brute_hits(t, items)[4]), key=str)


def test_many_windows(spark):
    """Chunks of windows and candidates smaller than what a shard holds give the same."""
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.choice([2, 12, 30])))) for i in range(40)]
    docs = [(i, " ".join(rng.choice("ab") for _ in range(80))) for i in range(12)]
    was, decontamination.CANDIDATES = decontamination.CANDIDATES, 50
    try:
        windows = decontamination.Windows([{"item_id": i, "text": t} for i, t in items], 10)
        row = next(iter(decontamination.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).toLocalIterator())).asDict()
        shard = decontamination.Shard(row)
        found = [(int(windows.begin[w]), int(b)) for some, at in windows.found(shard) for w, b in zip(some, at)]
    finally:
        decontamination.CANDIDATES = was
    want = [(int(b), at) for b, n in zip(windows.begin, windows.size) for at in shard.phrase([sorted(windows.number)[t] for t in windows.terms[b : b + n]]).tolist()]
    assert len(found) > 1000 and sorted(found) == sorted(want)


def test_contamination_takes_one_worker(spark):
    """Two Python functions in one stage take two workers for each task, which a session keeps."""
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([("x", "b c")], "item_id string, text string")
    got = decontamination.contamination(docs, items)
    assert [tuple(r)[:4] for r in got.collect()] == [(1, 3, 2, 1)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontamination.contamination(docs, none).collect()] == [(1, 2, 0, 0)]
    assert decontamination.contamination(docs.limit(0), none).count() == 0


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat the cat"), (2, "the big cat"), (3, "cat the")], "doc_id long, text string")
    index = decontamination.build_index(docs, shard_bytes=80)
    exact = decontamination.phrase_matches(index, {"p": "The cat"}).collect()
    assert sorted((r["doc_id"], r["first"], r["last"]) for r in exact) == [(1, 0, 1), (1, 6, 7)]
    near = decontamination.phrase_matches(index, {"p": "the cat"}, slop=1).collect()
    assert sorted((r["doc_id"], r["first"], r["last"]) for r in near) == [(1, 0, 1), (1, 6, 7), (2, 0, 2)]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "'d' AS digest")


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}" * (i % 5 + 1)) for i in range(60)] + [(100, None, None), (101, "a b\n", ""), (102, "u", "é🙂"), (103, "u", "z" * 300_000), (104, "u", "z" * 300_000)]
    pay = [(h or "").encode() for _, _, h in rows]
    digest = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in pay]
    keeper = pd.Series([r[0] for r in rows]).groupby(digest).transform("max").tolist()
    got = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(pages_of(spark, rows)).collect()}
    assert got == {r[0]: (len(p), d, "response" if k == r[0] else "revisit", None if k == r[0] else k) for r, p, d, k in zip(rows, pay, digest, keeper)}
    few = {r["page_id"]: r["record_type"] for r in warc.round_trip(pages_of(spark, rows), least_bytes=10).collect()}
    assert few[100] == few[101] == "response" and few[103] == "revisit"


def test_warc_odd(spark):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, None, None), (None, None, None)]
    got = sorted(map(str, ((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages_of(spark, rows)).collect())))
    assert got == sorted(map(str, [(1, "response", None), (1, "response", None), (None, "revisit", 1), (None, "response", None), (None, "response", None)]))
    assert warc.round_trip(pages_of(spark, rows).limit(0)).count() == 0


def test_warc_large_record():
    """A record's cost grows with its length: parts that are read aren't copied again and again."""
    payload = np.random.default_rng(0).bytes(60_000_000)
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    data = z.compress(warc.record(1, "u", payload, None, "d")) + z.flush()
    began = time.process_time()
    found = list(warc.records(io.BytesIO(data), 0, len(data)))
    assert len(found) == 1 and found[0].block.endswith(payload) and time.process_time() - began < 4


@pytest.mark.parametrize("sent", [10**6, 0])
def test_warc_shared_payload(spark, sent):
    """No task writes all records of a payload that very many pages share."""
    shared = hashlib.shake_256(b"shared").hexdigest(10_000)
    html = F.when(F.col("id") % 3 > 0, F.lit(shared)).otherwise(F.col("id").cast("string"))
    pages = spark.range(0, 900, 1, 8).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    low = "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    conf = {**dict.fromkeys(low, "20000"), "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "4"}
    conf |= dict.fromkeys(("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"), "-1")
    was = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        archives = warc.write_archives(pages, common.shared_dir(spark), sent_digests=sent).collect()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r["records"] for r in archives) == 900 and max(r["records"] for r in archives) < 400


def test_splits(spark):
    inner = warc.member(warc.record(9, "in", b"inside", None, "d"))
    rows = [(i, "u", zlib.crc32(b"%d" % i).to_bytes(4, "big").hex() * (i * 37 % 90)) for i in range(80)]
    archives = warc.write_archives(pages_of(spark, rows), common.shared_dir(spark), archive_bytes=5000)
    assert archives.agg(F.sum("records")).first()[0] == 80 and archives.count() > 3
    for size in (50, 333, 10**9):
        assert warc.read_archives(archives, split_bytes=size).select("record_id").distinct().count() == warc.read_archives(archives, split_bytes=size).count() == 80
    # magic inside of a record isn't one, nor is a broken member or rubbish between
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = warc.record(1, "u", warc.MAGIC + b"no" + warc.MAGIC * 5, None, "d")
    data = b"\x1f\x8b" + stored.compress(outer) + stored.flush() + b"rubbish" + warc.MAGIC + inner[:20] + inner
    for size in (7, 100, len(data)):
        found = [r.head["warc-record-id"] for b in range(0, len(data), size) for r in warc.records(io.BytesIO(data), b, min(len(data), b + size))]
        assert sorted(found) == ["<urn:cairn:page:1>", "<urn:cairn:page:9>"]
    # several records in a member; a member cut off or changed is told, and those behind it are read
    many = warc.member(b"".join(warc.record(i, "u", b"x" * i, None, "d") for i in range(5)))
    cut = warc.member(warc.record(7, "u", bytes(range(256)) * 20, None, "d"))
    changed = bytearray(cut)
    changed[-6] ^= 1
    data = many + bytes(changed) + inner + cut[:-30]
    for size in (11, 500, len(data)):
        found = [r for b in range(0, len(data), size) for r in warc.records(io.BytesIO(data), b, min(len(data), b + size))]
        assert [r.at for r in found if isinstance(r, warc.Corrupt)] == [len(many), len(many) + len(cut) + len(inner)]
        assert [r.head["warc-record-id"][-2] for r in found if isinstance(r, warc.Record)] == list("012349")
    folder = common.shared_dir(spark)
    files, at = warc.opened(folder)
    files.create_dir(at)
    with files.open_output_stream(f"{at}/a.warc.gz", compression=None) as out:
        out.write(data)
    rows = warc.read_archives(spark.createDataFrame([(f"{folder}/a.warc.gz", len(data))], "path string, bytes long")).collect()
    assert len(rows) == 8 and sum(r["error"] is not None for r in rows) == 2
    assert gzip.decompress(inner).startswith(b"WARC/1.1\r\n")


def test_pipeline(spark):
    """Every stage's decision, taken text by text on the driver."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from cairn.llm import quality_classifier, toxicity

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    frame = lambda kept: spark.createDataFrame(kept)
    ranker = quality_classifier.fit(frame(docs), labels)
    kept = docs[[ranker.scores(np.array([quality_classifier.features(t)]))[0] >= 0.7 for t in docs.text]]
    network = toxicity.fit(frame(kept), labels)
    reader = toxicity.Reader(network)
    kept = kept[[toxicity.scores(network, reader, [t])[0] < 0.5 for t in kept.text]]
    near = brute_near(list(zip(kept.doc_id, kept.text)))
    kept = kept[[near[i][0] == i for i in kept.doc_id]]
    items = list(pq.read_table(f"{SF}/benchmark.parquet").to_pandas().itertuples(index=False, name=None))
    # brute force is slow: only texts that share three words in a row with an item are searched
    threes = {tuple(v[i : i + 3]) for _, t in items for v in [decontamination.words(t)] for i in range(len(v))}
    near_item = lambda t: any(tuple(w[i : i + 3]) in threes for w in [decontamination.words(t)] for i in range(len(w)))
    kept = kept[[not (near_item(t) and brute_hits(t, items)[4]) for t in kept.text]]
    library = Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in zip(kept.doc_id, kept.text)}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0.5 * len(docs) < len(got) < len(docs)
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert first.columns == list(docs.columns)
