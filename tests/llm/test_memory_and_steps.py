"""Bounded batches and passes, and the transducer's steps."""

import gc

import numpy as np
import pyarrow as pa

from quillgate.llm import bpe, probmin, queries, severity, store
from quillgate.llm.words import scan, text_bytes


def test_toxicity_sends_small_batches(spark, sf_dir):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    queries.op9_toxicity_severity(spark, sf_dir)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == store.BATCH_ROWS


def test_severity_features_do_not_depend_on_the_pass(monkeypatch):
    texts = pa.array([f"word{i % 7} and others {i}" for i in range(500)] + [None, ""])
    features = np.unique(severity.feature_hashes(scan(*text_bytes(texts)))[1])
    whole = severity.counted(features, texts)
    monkeypatch.setattr(severity, "PASS_BYTES", 64)
    parts = severity.counted(features, texts)
    order = [np.lexsort(x[::-1]) for x in (whole, parts)]
    assert (whole[:, order[0]] == parts[:, order[1]]).all()


def test_steps_are_kept_in_order_and_collection_comes_back():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258, b"cab": 259, b"aa": 260}
    encoder = bpe.Encoder(ranks, bpe.WORDS_FIRST)
    for text in ("abcab aabc", "bcabcaab caab", "cabab abcabc"):
        assert gc.isenabled()
        assert encoder.encode_many([text]) == [[t for piece in encoder.cut(text) for t in bpe.merged(ranks, piece.encode())]]
        assert gc.isenabled() and (np.diff(encoder.known[0]) > 0).all()


def test_no_collection_while_texts_are_encoded(monkeypatch):
    seen = []
    encoder = bpe.Encoder({bytes([b]): b for b in range(256)}, bpe.WORDS_FIRST)
    monkeypatch.setattr(encoder, "_learn", lambda words: seen.append(gc.isenabled()))
    monkeypatch.setattr(encoder, "_unknown", lambda pieces: pieces)
    encoder.known_ids["a"] = (97,)
    assert encoder.encode_many(["a"]) == [[97]] and seen == [False]


def near_copies(spark, n=60):
    """Texts with one passage in common, each with a word of its own in the middle."""
    rows = [(i, " ".join(f"w{k}" for k in range(60)) + f" only{i} " + " ".join(f"v{k}" for k in range(60))) for i in range(n)]
    far = [(n + i, " ".join(f"w{k}" for k in range(60)) + " " + " ".join(f"u{i}x{k}" for k in range(25))) for i in range(n)]
    return spark.createDataFrame(rows + far, "doc_id long, text string")


def test_shingles_of_one_text_are_only_counted(spark, monkeypatch):
    """No row for a shingle that a single crowded text holds; the result is that of buckets that are compared as they are."""
    plain = sorted(map(tuple, probmin.near_duplicates(near_copies(spark)).collect()))
    seen, saved = {}, probmin.saved
    monkeypatch.setattr(probmin, "FEW", 1)
    monkeypatch.setattr(probmin, "saved", lambda df, name: seen.setdefault(name, saved(df, name)))
    assert sorted(map(tuple, probmin.near_duplicates(near_copies(spark)).collect())) == plain
    assert seen["rare-keys"].where("df = 1").count() > 0 and seen["rare"].where("df = 1").count() == 0


def test_near_duplicates_send_small_batches(spark):
    for find in (probmin.near_duplicates, probmin.keep_one):
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        find(near_copies(spark, 2))
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == store.BATCH_ROWS


def python_nodes(df):
    """Most Python nodes above one another in one stage of a plan, each of which takes a worker of its own in every task."""
    above, most = [], 0
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        name = line.lstrip(" :+-")
        depth, count = len(line) - len(name), 0
        above = [x for x in above if x[0] < depth]
        if above and "Exchange " not in name:
            count = above[-1][1]
        count += name.startswith(("ArrowEvalPython ", "MapInArrow "))
        above.append((depth, count))
        most = max(most, count)
    return most


def test_one_python_worker_a_task(spark, monkeypatch):
    """Shingles are listed behind the join with wanted texts; ids that repeat or are missing change nothing."""
    text = {r["doc_id"]: r["text"] for r in near_copies(spark, 8).collect()}
    rows = [*text.items(), *((1000 + i, " ".join(f"x{i}y{k}" for k in range(30))) for i in range(40))]
    rows += [(0, "another text of an id that is taken"), *[(None, "a text without an id " * 3)] * 2, (None, text[1] + " end")]
    rows = store.saved(spark.createDataFrame(rows, "doc_id long, text string"), "rows")
    plans, saved = {}, probmin.saved
    monkeypatch.setattr(probmin, "saved", lambda df, name: (plans.setdefault(name, python_nodes(df)), saved(df, name))[1])
    found = {(r["doc_id"], r["class_id"]) for r in probmin.near_duplicates(rows).collect()}
    assert plans["shingles"] == 1 and max(plans.values()) == 1
    assert {(i, 0) for i in range(8)} <= found and {(1000 + i, 1000 + i) for i in range(40)} <= found
    assert (None, 0) in found and (None, None) in found
