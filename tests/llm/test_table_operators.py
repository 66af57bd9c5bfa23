"""Top-k search, quotation linking, url digests, sharding and the pipeline against plain Python and DuckDB."""

import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillgate.llm import queries, quotes, sharding, topk, urls
from quillgate.llm.store import table


def brute_top(rows, k=5):
    seen = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in seen:
        if q % 50 == 0:
            found = sorted({(-sum(x * y for x, y in zip(a, b)), c) for c, b in seen if c != q and len(b) == len(a)})[:k]
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(found)}
    return out


@pytest.mark.parametrize("leaf", [4, 128])
def test_top_k_equals_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(topk, "LEAF_ROWS", leaf)
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    rng = random.Random(leaf)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(120)]  # one very common vector
    rows += [(50, rows[50][1]), (None, [1.0] * 6), (2000, None), (2050, [None] + [0.1] * 5), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6)]
    rows += [(2200, [0.5, 0.5]), (2201, [0.25, 1.0])]
    table_ = spark.createDataFrame([(i, v, 3, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int")
    got = topk.top_k(table_, table_.where("vec_id % 50 = 0"))
    assert {tuple(r) for r in got.collect()} == brute_top(rows)


def test_top_k_of_large_numbers_and_empty_tables(spark):
    v = np.array([[3_000_000_000, 5], [2, 7]], np.int64)
    assert topk.products(v, v).tolist() == [[9_000_000_000_000_000_025, 6_000_000_035], [6_000_000_035, 53]]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, none).count() == 0
    most = 2 ** 63 - 1
    far = spark.createDataFrame([(50, [1e17, 1.0]), (1, [1e17, 2.0]), (2, [-1e17, 0.0]), (3, [1e300, 5.0]), (4, [0.5, 0.5])], "vec_id long, embedding array<double>")
    rows = {(r["query_id"], r["vec_id"]): (r["rank"], r["score"]) for r in topk.top_k(far, far.where("vec_id = 50")).collect()}
    exact = int(256 * 1e17) * 128 + 256 * 128
    assert rows == {(50, 1): (1, most), (50, 3): (2, most), (50, 4): (3, min(exact, most)), (50, 2): (4, -most - 1)} or exact < most


def test_top_k_of_a_repeated_row_and_many_blocks(spark, monkeypatch):
    """An id with a third of all rows, and more query blocks than one task takes."""
    for name, value in (("SHARD_ROWS", 40), ("BLOCK_ROWS", 2), ("TASK_BLOCKS", 2), ("LEAF_ROWS", 8)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(12)
    rows = [(i * 10, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    rows += [rows[7]] * 60 + [(70, [0.1, 0.2, 0.3, 0.4])]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(table_, table_.where("vec_id % 50 = 0")).collect()} == brute_top(rows)


MESSAGES = [
    (1, 0, "user", "First line here.\nSecond thought, longer than the first."),
    (1, 1, "assistant", "> First line here.\n> Second thought, longer than the first.\n\nMy answer."),
    (1, 2, "user", "Ann wrote:\n>> first LINE here\n>> second thought longer than the first\n> My answer.\nI see."),
    (1, 3, "user", "> unknown words\nNo link."),
    (1, 4, "user", "> Second thought, longer than the first.\n> and something new\nPartly quoted."),
    (1, 4, "user", "> Second thought, longer than the first.\n> and something new\nPartly quoted."),
    (1, 5, "assistant", ">>> !!\n> > I see.\r\nDone: \n\n\n\nend"),
    (2, 0, "user", None), (2, 1, "user", ""), (2, 5, "user", "> I see.\nother conversation"),
    (2, 9, "user", "plain"), (2, 700, "user", "> plain\nfar away"), (2, 1400, "user", "> plain\n> far away"),
]


def test_quotes_are_linked_as_in_sql(spark):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    rng = random.Random(6)
    rows = list(MESSAGES)
    for conv in range(10, 30):
        said = []
        for turn in range(rng.randint(1, 12)):
            own = " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randint(1, 3)))
            quoted = "".join("> " * rng.randint(1, 2) + rng.choice(said) + "\n" for _ in range(rng.randint(0, 2)) if said)
            said.append(own)
            rows.append((conv, turn * 300, rng.choice(["user", "assistant"]), quoted + own))
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = quotes.linked(spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int"))
    cur = con.execute(queries.SQL["op2_quote_linking"])
    names = [c[0] for c in cur.description]
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, cur.fetchall()))
    rows = {(r["conv_id"], r["turn"]): r for r in got.collect()}
    assert rows[1, 1]["text"] == "My answer." and rows[1, 1]["reply_to"] == 0
    assert rows[1, 2]["text"] == "I see." and rows[1, 2]["reply_to"] == 1 and rows[1, 2]["depth"] == 2 and rows[1, 2]["n_linked"] == 2
    assert rows[1, 3]["n_linked"] == 0 and rows[1, 3]["reply_to"] == 2
    assert rows[1, 4]["n_linked"] == 1 and rows[1, 4]["reply_to"] == 0
    assert rows[2, 700]["reply_to"] == 9
    # one line is from turn 9 and one from turn 700: as many lines name either, the later one is taken
    assert rows[2, 1400]["n_linked"] == 1 and rows[2, 1400]["reply_to"] == 700


def test_partial_quotes_name_the_message_of_most_lines(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [
        (1, 0, "a", "One is here.\nTwo is the longest line of all of them.\nThree stays."), (1, 1, "b", "Three stays."),
        (1, 2, "a", "> One is here.\n> Two was edited by the one who quotes it.\n> Three stays.\nok"),  # turn 0: one of two lines, turn 1: the other; latest
        (2, 0, "a", "Alpha beta gamma\ndelta epsilon.\n\nSecond paragraph of\nthis message."), (2, 1, "b", "other"),
        (2, 2, "a", "> alpha beta\n> gamma delta epsilon\n>\n> new words here\nyes"),  # a paragraph in other lines
        (2, 3, "a", "> Second paragraph\n> of this message\nyes"),
        (3, 0, "a", "x one\ny two\nz three"), (3, 1, "b", "z three"), (3, 2, "a", "> x one\n> y two\n> z three\n> w four\nsure"),  # two lines against one
        (4, 0, "a", "long " * 3000), (4, 1, "b", "> " + "long " * 3000 + "\nyes"), (4, 1, "b", "> " + "long " * 3000 + "\nyes")]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.linked(spark.createDataFrame(rows, schema)).collect()}
    assert [got[k]["reply_to"] for k in [(1, 2), (2, 2), (2, 3), (3, 2), (4, 1)]] == [1, 0, 0, 0, 0]
    assert all(got[k]["n_linked"] == 1 for k in [(1, 2), (2, 2), (2, 3), (3, 2), (4, 1)])


def test_quotes_without_keys_and_formatting(spark):
    schema = "conv_id long, turn long, role string, text string"
    odd = spark.createDataFrame([(None, 1, "user", "a"), (1, None, "user", "> b\nc"), (3, 0, None, "hi"), (3, 1, "user", "> hi\nyes")], schema)
    rows = {(r["conv_id"], r["turn"]): r for r in quotes.linked(odd).collect()}
    assert rows[None, 1]["position"] is None and rows[1, None]["text"] == "c" and rows[3, 1]["reply_to"] == 0
    assert {(r["conv_id"], r["piece"]): r["chat"] for r in quotes.formatted(odd).collect()} == {(3, 0): "<||>\nhi\n<|user|>\nyes\n"}
    assert quotes.linked(spark.createDataFrame([], schema)).count() == 0


def test_quotation_linking_runs_no_python(spark):
    plan = queries.op2_quote_linking(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_verdict(url, rules):
    host, path = urls.split_url(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


URLS = [
    None, "", "no scheme", "http://", "http://net/", "http://net", "HTTP://A.NET/x", "https://example.net/en/1?q=/de/", "http://example.net/fr/",
    "http://notexample.com/de/", "http://m.example.com/de/9#x", "http://example.com/de", "http://a.org/fr/", "http://a.org/en/", "ftp://x.net:80/",
    "http://É.NET/", "x://y://z.net/", "http://a.net/" + "p" * 50000, "http://" + "a." * 3000 + "net/", "http://net./", "http://.net/"]


def test_url_rules(spark):
    rows = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS + URLS)], "page_id int, url string, host string, rule string")
    got = rows.select("page_id", urls.url_verdict(spark, queries.URL_RULES, F.col("url")).alias("u")).collect()
    assert [tuple(r["u"]) for r in sorted(got)] == [plain_verdict(u, queries.URL_RULES) for u in URLS + URLS]
    again = rows.select("page_id", urls.url_verdict(spark, queries.URL_RULES, F.col("url")).alias("u")).collect()
    assert sorted(again) == sorted(got)
    free = rows.select(urls.url_verdict(spark, [], F.col("url")).alias("u")).collect()
    assert {r["u"]["verdict"] for r in free} == {"allow"}


def test_url_collisions_are_confirmed(tmp_path):
    weak = lambda text: len(text) % 3
    rng = random.Random(2)
    label = lambda: rng.choice(["a", "b", "cc"])
    rules = list({(f"{label()}.{label()}", rng.choice(["", "/", "/x", "/x/"])): "block" if rng.random() < 0.5 else "allow" for _ in range(40)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    names = urls.write_digests(str(tmp_path), rules, weak)
    digests = urls.Digests({k: str(tmp_path / n) for k, n in names.items()}, weak)
    pages = [f"http://{label()}.{label()}.{label()}{rng.choice(['', '/', '/x', '/x/y', '/z'])}" for _ in range(200)]
    found = digests.judge([urls.split_url(u) for u in pages])
    assert [digests.text(i) if i >= 0 else None for i in found] == [plain_verdict(u, rules)[2] for u in pages]


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2 ** 64 - 1)
        j = int((b + 1) * (2 ** 31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_moves_rows_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2 ** 63, 3000).astype(np.uint64)
    for n in (1, 2, 24, 1000):
        now, grown = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert now.tolist() == [plain_jump(int(k), n) for k in keys]
        assert set(grown[now != grown].tolist()) <= {n}
    assert np.bincount(sharding.jump(keys, 24), minlength=24).min() > 60


def test_sharding(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 5)
    monkeypatch.setattr(sharding, "RUN", 7)
    rows = [(i, f"text {i}") for i in range(400)] + [(7, "text 7")] * 200 + [(8, None), (None, "é"), (None, None), (9, ""), (9, "other"), (10, "long " * 100_000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, shard int, slot int")
    got = sharding.place(docs).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(
        ((i, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for i, t in rows), key=str)
    slots, shard_of = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        shard_of[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["law"] == "key" and 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shard_of.values())
    assert sharding.place(docs.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    kept = [{r["doc_id"] for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "token_ids":
            assert out.columns == table(spark, sf, "documents").columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert kept[-1] <= kept[-2]
    assert docs.where("round_trip").count() == docs.count() == len(kept[-1]) > 100
    final = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    assert final == kept[-1]
    marks = {r["doc_id"]: r for r in queries.op9_toxicity_severity(spark, sf).collect()}
    assert kept[1] == {k for k in kept[0] if not marks[k]["toxic"]}
    dirty = {r["doc_id"] for r in queries.op4_suffix_decontamination(spark, sf).collect() if r["contaminated"]}
    assert kept[4] == kept[3] - dirty


def test_pipeline_keeps_rows_with_nulls(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "a", 0), (3, "Some words.", "en", "a", 11)], schema)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 4


def test_pipeline_of_empty_repeated_and_long_documents(spark, tmp_path):
    """Empty tables, ids that repeat, a very long text and a clashing extra column, in every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    some = "Plain words about the river and the hills behind the town, written for a test."
    rows = [(1, long, "en", "a", len(long)), (2, some, "en", "a", 1), (2, "Quite another text about ships and harbours under the same number.", "en", "a", 2),
            (2, some, "en", "a", 1), (3, some.upper(), "en", "b", 3), (None, some, "en", "b", 3), (4, "", "en", "b", 0)]
    for name, table_ in (("empty", []), ("rows", rows)):
        docs = spark.createDataFrame(table_, schema)
        for stage_name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            out.write.parquet(str(tmp_path / f"{name}-{stage_name}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{stage_name}"))
        if not table_:
            assert docs.count() == 0
    alone = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema), None)
    assert sorted((str(r["doc_id"]), r["text"][:5]) for r in alone.collect()) == [("1", "word0"), ("2", "Plain"), ("2", "Quite"), ("4", "")]
