"""Bounded samples, near-duplicate classes of odd rows, and scores of fitted models against plain Python."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgate.llm import langid, probmin, quality, severity, store, words
from quillgate.llm.store import held_out, labelled_sample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeated(spark):
    """Documents and labels in which one id is most of all rows, on both sides."""
    docs = [(i, f"text {i}", "en" if i % 3 else "de") for i in range(60)] + [(7, f"text 7 {j % 4}", "fr") for j in range(300)] + [(7, None, "en"), (None, "x", "en")]
    labels = [(i, i % 2) for i in range(60)] + [(7, 1)] * 200 + [(8, 1)] * 3 + [(9, 0)] * 3 + [(500, 1), (None, 1), (10, None)]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"))


def test_labelled_samples_count_ids_once(spark):
    docs, labels = repeated(spark)
    sample, sizes = labelled_sample(docs, labels, "quality", 10, withheld=False)
    rows = sample.collect()
    assert len(rows) == 20 and len({r["doc_id"] for r in rows}) == 20 and sum(r["label"] for r in rows) == 10
    assert sizes == (30, 30)  # 8 is labelled 1 more often than 0, and 9 is labelled 0 more often than 1
    whole, _ = labelled_sample(docs, labels, "quality", 1000, withheld=False)
    found = {r["doc_id"]: (r["text"], r["label"]) for r in whole.collect()}
    assert found[7] == ("text 7", 1) and found[8][1] == 1 and found[9][1] == 0 and 500 not in found and None not in found
    held = {r["doc_id"] for r in docs.where(held_out("doc_id")).select("doc_id").collect()}
    assert held and not held & {r["doc_id"] for r in labelled_sample(docs, labels, "quality", 1000)[0].collect()}


def test_languages_are_picked_by_id(spark, monkeypatch):
    docs, _ = repeated(spark)
    picked = {r["id"]: r["lang"] for r in langid._picked(docs, "doc_id", "lang").collect()}
    held = {r["doc_id"] for r in docs.where(held_out("doc_id")).select("doc_id").collect()}
    assert set(picked) == set(range(60)) - held and (7 in held or picked[7] == "en")
    monkeypatch.setattr(langid, "PER_LANGUAGE", 5)
    few = langid._picked(spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, "a").otherwise("b").alias("lang")), "doc_id", "lang")
    assert sorted((r["lang"], r["count"]) for r in few.groupBy("lang").count().collect()) == [("a", 5), ("b", 5)]
    again = langid._picked(spark.range(3000).repartition(7).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, "a").otherwise("b").alias("lang")), "doc_id", "lang")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, again.collect()))
    monkeypatch.setattr(langid, "MOST_DOCUMENTS", 6)
    assert langid._picked(spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), (F.col("id") % 4).cast("string")).alias("lang")), "doc_id", "lang").groupBy(
        "lang").count().where("count <> 1").count() == 0


# ---- near duplicates of odd rows


def base_text(seed, size=60):
    rng = random.Random(seed)
    return [f"w{rng.randrange(2000)}" for _ in range(size)]


def test_texts_without_an_id_are_linked(spark):
    a, b = base_text(1), base_text(2)
    near = [*a[:40], "changed", *a[41:]]
    rows = [(None, " ".join(a)), (None, " ".join(near)), (None, " ".join(b)), (5, " ".join([*b[:50], "other", *b[51:]])), (None, "alone " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["text"]: r for r in docs.join(probmin.near_duplicates(docs).withColumnRenamed("doc_id", "i").limit(0), F.lit(False), "left").collect()}
    assert len(got) == 5
    classes = sorted(((r["doc_id"], r["class_id"], r["class_node"]) for r in probmin.near_duplicates(docs).collect()), key=str)
    nodes = [n for _, _, n in classes]
    assert sorted(nodes.count(n) for n in set(nodes)) == [1, 2, 2]
    assert sum(c == 5 for _, c, _ in classes) == 2
    kept = [r["text"] for r in probmin.keep_one(docs).collect()]
    assert len(kept) == 3 and " ".join(rows[3][1].split()) in kept and "alone " * 30 in kept


def test_no_text_is_lost_with_its_id(spark):
    a, b, c = (" ".join(base_text(i)) for i in (3, 4, 5))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, c + "!"), (4, b), (None, c), (9, None), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, d int")
    for _ in range(2):
        kept = sorted(((r["doc_id"], r["text"]) for r in probmin.keep_one(docs.repartition(5)).collect()), key=str)
        assert kept == sorted([(1, a), (2, b), (3, c), (9, None), (None, None)], key=str)
    assert probmin.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("few, rare", [(1, 2), (2, 6), (4, 10)])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, few, rare):
    """Families that changed some, much or the same words: every pair of similarity 0.8 that shares a band is joined."""
    monkeypatch.setattr(probmin, "FEW", few)
    monkeypatch.setattr(probmin, "RARE", rare)
    rng = random.Random(few)
    rows = []
    for family in range(3):
        base = base_text(50 + family, 80)
        passages = [[f"p{family}_{k}_{i}" for i in range(8)] for k in range(3)]
        for member in range(24):
            text = list(base)
            for _ in range(rng.choice([1, 1, 2])):
                text[rng.randrange(80)] = f"n{rng.randrange(10 ** 6)}"
            if member % 2:
                at = rng.randrange(70)
                text[at:at + 8] = rng.choice(passages)
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in probmin.near_duplicates(docs).collect()}

    def shingles(text):
        w = text.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for _, t in rows]
    column = pa.array([t for _, t in rows])
    data, offsets = words.text_bytes(column)
    doc, key, weight = probmin.shingles(words.scan(data, offsets), len(rows))
    bands = probmin.band_keys(probmin.registers(doc, key, weight.astype(float), len(rows)))
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    linked = 0
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (bands[i] == bands[j]).any():
                top[find(max(find(i), find(j)))] = min(find(i), find(j))
                linked += 1
    least = {}
    for i in range(len(rows)):
        least.setdefault(find(i), i)
    assert linked > 3 and got == {i: min(j for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}


# ---- scores of fitted models


def plain_features(text):
    found = {}
    for word in WORD.findall((text or "").translate(LOWER)):
        raw = word.encode()
        for feature in [raw, *[(size, raw[:size]) for size in severity.STEMS if len(raw) > size]]:
            found[feature] = found.get(feature, 0) + 1
    return found


def hash_of(feature):
    if isinstance(feature, bytes):
        data, offsets = words.text_bytes(pa.array([feature.decode()]))
        return int(words.scan(data, offsets).hash[0])
    size, raw = feature
    number = np.array([int.from_bytes(raw, "little")], np.uint64)
    return int(words.mix(number + np.uint64(size))[0])


def test_severity_equals_plain_python(spark):
    texts = ["bad bad Terrible things", "terribly fine", "plain words", "", None, "BAD terrible " * 5000, "bad"]
    known = [b"bad", (4, b"terr"), (5, b"terri"), b"plain", b"things"]
    weights = dict(zip(known, [1.5, 0.7, 0.4, -2.0, 0.3]))
    order = sorted(known, key=hash_of)
    model = severity.Model(np.array([hash_of(f) for f in order], np.uint64), np.array([weights[f] for f in order]), np.array([0.5, 1.5, 3.0]))
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in docs.select("i", severity.severity(model, F.col("text")).alias("s")).collect():
        found = plain_features(texts[r["i"]])
        score = sum(weights[f] * math.log1p(found[f]) for f in known if f in found)
        above = [1 - 1 / (1 + math.exp(-(t - score))) for t in model.thresholds]
        each = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
        assert r["s"]["severity"] == pytest.approx(sum(above), abs=1e-9)
        assert r["s"]["grade"] == int(np.argmax(each)) and r["s"]["toxic"] == (above[0] >= 0.5)


def test_ordinal_gradients_equal_differences():
    """The fitted weights are a minimum of the ordinal loss: small moves make it no better."""
    rng = np.random.default_rng(3)
    x = rng.poisson(0.8, (200, 5)).astype(float)
    grades = np.clip((x @ [1.0, -1.0, 0.5, 0.0, 0.2] + rng.normal(0, 0.5, 200)).round().astype(int), 0, 3)
    rows, columns = np.nonzero(x)
    w, cuts = severity.train(rows, columns, x[rows, columns], grades, 5, steps=3000, rate=0.02)
    share = np.where(grades > 0, 0.5 / (grades > 0).sum(), 0.5 / (grades == 0).sum())

    def loss(w, cuts):
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        p = 1 / (1 + np.exp(-(edges[grades + 1] - x @ w))) - 1 / (1 + np.exp(-(edges[grades] - x @ w)))
        return -(share * np.log(np.maximum(p, 1e-12))).sum() + 0.5e-5 * (w ** 2).sum()

    assert (np.diff(cuts) > 0).all()
    for i in range(5):
        for move in (-0.05, 0.05):
            assert loss(w + move * np.eye(5)[i], cuts) > loss(w, cuts) - 1e-6
    for i in range(3):
        for move in (-0.03, 0.03):
            assert loss(w, cuts + move * np.eye(3)[i]) > loss(w, cuts) - 1e-6


def test_language_equals_plain_python(spark):
    rng = np.random.default_rng(5)
    n = langid.FILTERS * len(langid.WIDTHS)
    alive = np.zeros((langid._REACH, langid.EMBEDDING, n))
    for i, width in enumerate(langid.WIDTHS):
        alive[:width, :, i * langid.FILTERS:(i + 1) * langid.FILTERS] = 1
    model = langid.Model(
        rng.normal(0, 1, (256, langid.EMBEDDING)).astype(np.float32), (rng.normal(0, 0.3, alive.shape) * alive).reshape(-1, n).astype(np.float32),
        rng.normal(0, 0.1, n).astype(np.float32), rng.normal(0, 0.5, (n, 3)).astype(np.float32), rng.normal(0, 0.5, 3).astype(np.float32), ["a", "b", "c"])
    texts = ["short text", "é" * 150 + " mixed with more letters " * 9, "x" * 200, "12 " * 90 + "end", "a", "9" * 250 + "z", "long " * 4000, "long " * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in docs.select("i", langid.language(model, F.col("text")).alias("l")).collect():
        raw, total, mean = texts[r["i"]].encode(), 0.0, np.zeros(3)
        for at in range(0, len(raw), langid.WINDOW):
            tile = raw[at:at + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            rows = model.embedding[np.frombuffer(tile, np.uint8)].astype(float)
            scores = [np.concatenate(rows[i:i + langid._REACH]) @ model.filters.astype(float) for i in range(langid.WINDOW - langid._REACH + 1)]
            hidden = np.maximum(np.max(scores, axis=0) + model.bias, 0)
            logits = hidden @ model.out + model.out_bias
            each = np.exp(logits - logits.max())
            letters = sum(65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in tile) + 1e-3
            mean, total = mean + letters * each / each.sum(), total + letters
        assert r["l"]["lang_pred"] == model.names[int((mean / total).argmax())]
        assert r["l"]["score"] == pytest.approx((mean / total).max(), abs=1e-4)


def test_training_tells_simple_languages_apart():
    rng = random.Random(2)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(langid.WINDOW)).encode()
    windows = np.stack([np.frombuffer(make("abc " if i % 2 else "xyz "), np.uint8) for i in range(80)])
    model = langid.train(windows, np.arange(80) % 2, ["x", "a"], steps=60, batch=32)
    each = langid.softmax(langid.pooled(model, windows) @ model.out + model.out_bias)
    assert (each.argmax(axis=1) == np.arange(80) % 2).all()


def test_votes_of_ties_long_and_repeated_texts(spark):
    """Equal neighbours, a very long text, repeated rows and columns whose names clash."""
    texts = [("good clear words about rivers " * 3, 1), ("BAD!!! buy $$$ now 111 " * 3, 0)]
    sample = spark.createDataFrame([(i, t + str(i), y) for i in range(20) for t, y in texts], "doc_id int, text string, label int")
    model = quality.fit(sample, (20, 20))
    docs = spark.createDataFrame([(1, texts[0][0] * 3000, 0.5, 1), (2, texts[1][0], 0.5, 1), (2, texts[1][0], 0.5, 1), (3, None, 0.5, 1)], "doc_id int, text string, score double, label int")
    rows = docs.select("doc_id", quality.quality(model, F.col("text")).alias("q")).collect()
    by = {r["doc_id"]: r["q"] for r in rows}
    assert by[1] > 0.5 > by[2] and by[3] == 0.5 and rows[1] == rows[2]
