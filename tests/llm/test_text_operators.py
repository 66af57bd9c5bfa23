"""Word scan, decontamination, near duplicates, severity, quality, language and byte-pair encoding against plain Python."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from quillgate.llm import bpe, decontam, langid, probmin, quality, queries, severity, store, words
from quillgate.llm.store import held_out, labelled_sample, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, score string, band int, words string"


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def docs_of(spark, texts):
    """Documents with extra columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], DOCS)


def test_scan_finds_the_words_of_every_text():
    rng = random.Random(5)
    texts = ["", None, "a", "Ünï-cödé 12ab", "!!", "x" * 5000, " lead and trail "] + [
        "".join(rng.choice("aB9 é中.-\n") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    data, offsets = words.text_bytes(pa.array(texts, pa.string()))
    found = words.scan(data, offsets)
    assert [[bytes(found.data[s:e]).decode() for d, s, e in zip(found.doc, found.start, found.end) if d == i]
            for i in range(len(texts))] == [plain_words(t) for t in texts]
    by_hash = {}
    for s, e, h in zip(found.start, found.end, found.hash):
        assert by_hash.setdefault(int(h), bytes(found.data[s:e])) == bytes(found.data[s:e])
    assert len(by_hash) == len({w for t in texts for w in plain_words(t)})


def brute_contamination(docs, items, size=13):
    windows = {}
    for name, text in items:
        w = plain_words(text)
        for i in range(len(w) - size + 1) if len(w) >= size else range(1 if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(name)
    out = {}
    for key, text in docs:
        w = plain_words(text)
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= found
        out[key] = (len(w), len(hit), sorted(x for x in names if x is not None))
    return out


def test_decontamination_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_BYTES", 2000)
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(6)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(str(i), make(rng.choice([1, 3, 12, 13, 14, 40]) if i > 3 else 20)) for i in range(12)]
    items += [("7", make(30)), (None, make(15)), ("20", None), ("21", ""), ("22", "!!"), ("3", items[3][1])]
    docs = [(i, make(rng.randint(0, 120))) for i in range(60)]
    docs += [(100 + i, make(20) + " " + items[i][1].upper() + ". " + make(9)) for i in range(12)]
    docs += [(200, None), (201, ""), (202, "...")] + [(203 + i, docs[60][1]) for i in range(3)]
    docs += [(300, " ".join([items[1][1]] * 40)), (301, make(30000))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: r["m"] for r in docs_of(spark, docs).select(
        "doc_id", decontam.matches(decontam.load_items(bench), F.col("text")).alias("m")).collect()}
    want = brute_contamination(docs, items)
    assert {k: (m["n_words"], m["n_hit"], m["items"]) for k, m in got.items()} == want
    text_of, item_text = dict(docs), {}
    for name, text in items:
        item_text.setdefault(name, []).append(plain_words(text))
    for key, m in got.items():
        mine = plain_words(text_of[key])
        for s in m["spans"]:  # every reported match is verbatim
            assert any(mine[s["word"]:s["word"] + s["words"]] == w[s["item_word"]:s["item_word"] + s["words"]] for w in item_text[s["item_id"]])


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    match = decontam.matches(decontam.load_items(none), F.col("text"))
    row = docs_of(spark, [(1, "a b c")]).select(match.alias("m"), decontam.contaminated(match).alias("c")).head()
    assert (row["m"]["n_words"], row["m"]["n_hit"], row["m"]["items"], row["c"]) == (3, 0, [], False)
    assert docs_of(spark, []).select(match).count() == 0


def test_a_benchmark_in_parts_gives_the_same(spark, monkeypatch):
    """Parts of 4,000 bytes, repeated items, one item across parts by its id, one longer than a part."""
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choice([f"w{i}" for i in range(8)]) for _ in range(n))
    items = [(str(i % 14), make(rng.choice([1, 5, 13, 20, 200]))) for i in range(30)] + [(None, make(15)), ("x", None), ("y", "")]
    items += [items[4]] * 12
    docs = [(i, make(rng.randint(0, 60))) for i in range(40)] + [(50 + i, make(9) + " " + (t or "")) for i, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (3, docs[3][1]), (None, items[0][1])]
    bench, table = spark.createDataFrame(items, "item_id string, text string"), docs_of(spark, docs)
    assert len(list(decontam.item_parts(bench, part_bytes=4000))) > 1
    shape = lambda df: sorted((r["doc_id"] or -1, r["m"]["n_words"], r["m"]["n_hit"], tuple(r["m"]["items"])) for r in df.collect())
    assert shape(decontam.match_table(table, bench, part_bytes=4000)) == shape(decontam.match_table(table, bench))
    monkeypatch.setattr(decontam, "PART_BYTES", 1)
    with pytest.raises(ValueError):
        decontam.load_items(bench)


def test_equal_hashes_of_other_words_are_no_match(monkeypatch):
    """Words that only the first hash takes for equal are thrown out by the second one."""
    import quillgate.llm.decontam as module

    items = module.index_items(["1"], ["alpha beta"])
    data, offsets = words.text_bytes(pa.array(["gamma beta alpha beta"]))
    found = words.scan(data, offsets)
    forged = found._replace(hash=np.array([items.hashes[0], items.hashes[1], items.hashes[0], items.hashes[1]]))
    windows, places = module.search(module.build_shard(forged), items)
    assert sorted(places.tolist()) == [0, 2]
    assert module.confirmed(windows, places, forged, items)[1].tolist() == [2]


def plain_shingles(text):
    w = plain_words(text)
    out = {}
    for i in range(max(len(w) - 4, 1 if w else 0)):
        key = tuple(w[i:i + 5])
        out[key] = out.get(key, 0) + 1
    return out


def plain_similarity(a, b):
    return sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in a.keys() | b.keys()) for x in a.keys() & b.keys())


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(2)
    for _ in range(5):
        a = {int(k): int(rng.integers(1, 5)) for k in rng.choice(60, 40, replace=False)}
        b = {int(k): int(rng.integers(1, 5)) for k in rng.choice(60, 40, replace=False)}
        arrays = [np.array(sorted(d.items()), np.uint64) for d in (a, b)]
        exact = probmin.probability_jaccard(arrays[0][:, 0], arrays[0][:, 1], arrays[1][:, 0], arrays[1][:, 1])
        assert exact == pytest.approx(plain_similarity(a, b))
        doc = np.repeat([0, 1], 40)
        found = probmin.registers(doc, words.mix(np.concatenate([x[:, 0] for x in arrays])), np.concatenate([x[:, 1] for x in arrays]).astype(float), 2, 2000)
        assert (found[0] == found[1]).mean() == pytest.approx(exact, abs=0.05)


def test_weight_bound_holds(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        shared = {k: rng.randint(1, 3) for k in range(rng.randint(1, 9))}
        top = rng.choice([1, 3])
        a = {k: min(v, top) for k, v in shared.items()} | {f"a{i}": rng.randint(1, top) for i in range(rng.randint(0, 4))}
        b = {k: rng.randint(1, top) for k in shared} | {f"b{i}": rng.randint(1, top) for i in range(rng.randint(0, 4))}
        own = lambda d, e: sum(v for k, v in d.items() if k not in e)
        rows.append((sum(a.values()), own(a, b), max(a.values()) == 1, sum(b.values()), own(b, a), max(b.values()) == 1, plain_similarity(a, b)))
    table_ = spark.createDataFrame(rows, "n_a long, u_a long, plain_a boolean, n_b long, u_b long, plain_b boolean, exact double")
    assert table_.where(probmin._bound("a", "b") < F.col("exact") - 1e-9).count() == 0


def brute_classes(rows):
    sets = [plain_shingles(t) if t is not None else None for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] is None or sets[j] is None:
                continue
            same = plain_words(rows[i][1]) == plain_words(rows[j][1]) if sets[i] else rows[i][1] == rows[j][1]
            if same or (sets[i] and sets[j] and plain_similarity(sets[i], sets[j]) >= 0.8):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return sorted(((k, least.get(top(i))) for i, (k, _) in enumerate(rows)), key=str)


def near_copies(rng, n_groups=6, copies=7, size=60):
    rows, key = [], 0
    for _ in range(n_groups):
        base = [f"v{rng.randrange(400)}" for _ in range(size)]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 5, 9])):
                text[rng.randrange(size)] = f"new{rng.randrange(999)}"
            rows.append((key, " ".join(text)))
            key += 1
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    rows = near_copies(rng)
    rows += [(900, ""), (901, ""), (902, None), (903, None), (904, "!!"), (905, "??"), (906, "one two"), (907, "One, two!"), (908, "one two three")]
    rows += [(0, rows[0][1]), (None, rows[0][1]), (None, None), (None, "lonely words stand here alone today")]
    chain = [f"c{i}" for i in range(80)]
    for step in range(6):  # neighbours are similar, the ends are not
        rows.append((950 + step, " ".join(chain[step * 3:] + [f"t{i}" for i in range(step * 3)])))
    got = probmin.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=str) == brute_classes(rows)


def test_large_buckets_lose_no_links(spark, monkeypatch):
    monkeypatch.setattr(store, "MOST_SENT", 0)  # as if every side were large
    monkeypatch.setattr(probmin, "FEW", 1)
    monkeypatch.setattr(probmin, "RARE", 2)
    rng = random.Random(9)
    rows = near_copies(rng, n_groups=2, copies=25, size=70)
    got = probmin.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=str) == brute_classes(rows)


def test_keep_one_row_of_each_class(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (3, text), (3, text), (4, text + " more"), (7, None), (None, "only here"), (None, "only here"), (None, None), (8, "else")]
    kept = probmin.keep_one(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "score", "band", "words"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.select("doc_id", "text").collect() if r["text"]) == [
        ("3", text), ("8", "else"), ("None", "only here")]
    assert kept.where("text is null").count() == 2
    assert probmin.keep_one(docs_of(spark, [])).count() == 0


def accuracy(found, truth):
    return sum(found[k] == v for k, v in truth.items()) / max(len(truth), 1)


def test_severity_finds_held_out_toxic_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").where("toxic is not null")
    model = severity.fit(severity.grades_of(labelled_sample(docs, labels, "toxic", 4000)[0]))
    assert (np.diff(model.thresholds) > 0).all()
    rest = docs.join(labels.where(held_out("doc_id")), "doc_id").select("doc_id", "toxic", severity.severity(model, F.col("text")).alias("s"))
    rows = rest.collect()
    assert accuracy({r["doc_id"]: int(r["s"]["toxic"]) for r in rows}, {r["doc_id"]: r["toxic"] for r in rows}) > 0.9
    assert all(0 <= r["s"]["severity"] <= len(model.thresholds) for r in rows)
    odd = docs_of(spark, [(1, None), (2, ""), (3, "x " * 200000), (3, "x " * 200000)]).select(severity.severity(model, F.col("text")).alias("s")).collect()
    assert not any(r["s"]["toxic"] for r in odd) and odd[2] == odd[3]


def test_severity_without_anything_to_learn(spark):
    none = spark.createDataFrame([], "text string, grade int")
    clean = spark.createDataFrame([("a b", 0)], "text string, grade int")
    for graded in (none, clean):
        row = docs_of(spark, [(1, "some words")]).select(severity.severity(severity.fit(graded), F.col("text")).alias("s")).head()
        assert (row["s"]["severity"], row["s"]["grade"], row["s"]["toxic"]) == (0.0, 0, False)


def test_ordinal_training_orders_grades():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 400)
    rows, columns = np.arange(400), np.zeros(400, np.int64)
    weights, cuts = severity.train(rows, columns, grades + rng.normal(0, 0.2, 400), grades, 1)
    assert weights[0] > 0 and (np.diff(cuts) > 0).all()
    assert np.array_equal(np.searchsorted(cuts, weights[0] * np.arange(4)), np.arange(4))


def test_quality_votes(spark):
    found = {r["doc_id"]: r for r in queries.op5_quality_vote(spark, "/root/testdata/sf0.01").collect()}
    truth = {r["doc_id"]: r["quality"] for r in table(spark, "/root/testdata/sf0.01", "labels").where(held_out("doc_id")).collect()}
    assert accuracy({k: r["predicted"] for k, r in found.items()}, truth) > 0.95
    empty = docs_of(spark, []).select("doc_id", "text", F.lit(1).alias("label"))
    model = quality.fit(empty, (1, 3))
    rows = docs_of(spark, [(1, None), (2, ""), (3, "text")]).select(quality.quality(model, F.col("text")).alias("q")).collect()
    assert [r["q"] for r in rows] == [0.75, 0.75, 0.75]


def test_vote_equals_brute_force():
    rng = np.random.default_rng(3)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 8))).astype(np.float32)
    model = quality.Model(None, None, unit(90), rng.integers(0, 2, 90).astype(float), 0.5)
    asked = unit(40)
    want = []
    for v in asked:
        cosine = model.vectors @ v
        near = np.argsort(-cosine)[:7]
        weight = np.maximum(cosine[near], 0)
        want.append((weight * model.labels[near]).sum() / weight.sum())
    assert np.allclose(quality.vote(model, asked, 7, block=16), want, atol=1e-5)


def test_votes_keep_the_balance_of_all_labelled_rows(spark):
    """Of 1,000 labelled rows 80 % are good; the sample has 40 of each label."""
    rng = np.random.default_rng(11)
    words = [f"word{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choice(words, 30))) for i in range(80)]
    sample = docs_of(spark, texts).select("doc_id", "text", (F.col("doc_id") % 2).cast("int").alias("label"))
    model = quality.fit(sample, (200, 800), per_label=40)
    asked = docs_of(spark, [(i, " ".join(rng.choice(words, 30))) for i in range(100)])
    score = asked.select(F.avg(quality.quality(model, F.col("text")))).collect()[0][0]
    assert 0.7 < score < 0.9
    twins = quality.Model(None, None, np.array([[1, 0], [1, 0]], np.float32), np.array([0.0, 1.0]), 0.8, (5.0, 20.0))
    assert np.allclose(quality.vote(twins, np.array([[1, 0]], np.float32), 2), 0.8)


def test_language_windows_cover_whole_texts(spark):
    found = {r["doc_id"]: r for r in queries.op6_byte_cnn_language(spark, "/root/testdata/sf0.01").collect()}
    truth = {r["doc_id"]: r["lang"] for r in table(spark, "/root/testdata/sf0.01", "documents").where(held_out("doc_id")).collect()}
    assert accuracy({k: r["lang_pred"] for k, r in found.items()}, truth) > 0.97
    rng = np.random.default_rng(1)
    model = langid.Model(
        rng.normal(size=(256, langid.EMBEDDING)).astype(np.float32), rng.normal(size=(langid._REACH * langid.EMBEDDING, 6)).astype(np.float32),
        np.zeros(6, np.float32), rng.normal(size=(6, 2)).astype(np.float32), np.zeros(2, np.float32), ["a", "b"])
    tiles, count = langid.windows_of(*words.text_bytes(pa.array(["", "x" * 200, "y" * 201, None, "z"])))
    assert count.tolist() == [0, 1, 2, 0, 1]
    places = langid.WINDOW - langid._REACH + 1
    for tile, got in zip(tiles, langid.pooled(model, tiles)):
        seen = np.stack([model.embedding[tile[i:i + langid._REACH]].reshape(-1) for i in range(places)])
        assert np.allclose(np.maximum((seen @ model.filters).max(axis=0), 0), got, atol=1e-4)
    rows = docs_of(spark, [(1, None), (2, ""), (3, "12 !?"), (4, "abc")]).select(langid.language(model, F.col("text")).alias("l")).collect()
    assert [r["l"]["lang_pred"] for r in rows][:3] == ["und"] * 3 and rows[3]["l"]["lang_pred"] in ("a", "b")
    nothing = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert docs_of(spark, [(1, "abc")]).select(langid.language(nothing, F.col("text")).alias("l")).head()["l"]["lang_pred"] == "und"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_byte_pairs_equal_the_library(spark, ranks, monkeypatch):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, decoder = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks)
    rng = random.Random(3)
    letters = ["a", "b", "é", "ß", "中", "\x1c", "\x85", " ", "  ", "\n", "\t", "1", "½", "'s", "!!", "\U0001F600", "the", "ing", "̀", "\xa0", "aaaa", "ÃÂ", "\0", "﻿"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        ids = encoder.encode_many([text])[0]
        assert ids == library.encode_ordinary(text) and decoder.decode(ids) == text
    monkeypatch.setattr(bpe, "MOST_STATES", 50)
    monkeypatch.setattr(bpe, "MOST_PIECES", 20)
    small = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for text in ["a" * 3000, "xyzzy" * 900 + " end", "word " * 50]:
        assert small.encode_many([text, text[7:]]) == [library.encode_ordinary(text), library.encode_ordinary(text[7:])]
    docs = docs_of(spark, [(1, None), (2, ""), (3, "Hello  wörld\n\n" * 9), (3, "Hello  wörld\n\n" * 9), (4, "long " * 40000)])
    docs = docs.withColumn("ids", bpe.encoded(ranks, public_tokenizers.PATTERN, F.col("text"))).withColumn("back", bpe.decoded(ranks, F.col("ids")))
    rows = bpe.coded(docs.withColumnRenamed("ids", "first"), ranks, public_tokenizers.PATTERN).collect()
    assert len(rows) == 5
    for r in rows:
        assert r["ids"] == r["first"] == library.encode_ordinary(r["text"] or "")
        assert r["decoded"] == r["back"] == (r["text"] or "")
    assert bpe.coded(docs_of(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_pair_rule_equals_merging(ranks):
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(4000):
        a, b = rng.randrange(2000), rng.randrange(2000)
        assert encoder._follows(a, b) == (bpe.merged(ranks, encoder.bytes_of[a] + encoder.bytes_of[b]) == [a, b])


def test_broken_bytes_decode_to_replacements(ranks):
    decoder = bpe.Decoder(ranks)
    rng = random.Random(8)
    for _ in range(2000):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xED, 0xA0, 0xF0, 0x9F, 0x98, 0xFF]) for _ in range(rng.randint(0, 9)))
        assert decoder.decode([ranks[bytes((b,))] for b in data]) == data.decode("utf-8", "replace")
