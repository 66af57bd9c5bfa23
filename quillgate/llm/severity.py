"""Toxicity: cumulative-link ordinal regression on sparse text features.

``fit`` picks the features whose presence differs most between graded and clean rows (whole words and
word beginnings, counted on Spark), then learns one weight per feature, shared by all ordered
thresholds.  ``severity`` gives the expected grade of every whole text as a column.

Defined results: null and empty texts have no features and get the severity of an empty text; with no
rows to learn from, or none above grade 0, every severity is 0 and nothing is toxic; repeated rows get
equal results; other columns are never read.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillgate.llm.store import saved
from quillgate.llm.words import column_passes, eight_bytes, keep_bytes, mix, scan

#: Bytes of word beginnings used as features beside whole words.
STEMS = (4, 5)
#: Most labelled rows of each label that a model learns from.
PER_LABEL = 4000
#: Most features of a model.
MOST_FEATURES = 4096
#: Bytes of text of one numpy pass: there are three features for each word, of some 150 bytes together.
PASS_BYTES = 1 << 19
#: Least G statistic (chi-square with one degree) of a feature.
LEAST_G = 30.0


class Model(NamedTuple):
    """Sorted feature hashes, their weights and the ordered thresholds (none: nothing learnt)."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def feature_hashes(words):
    """(text number, feature hash) of every word and word beginning."""
    length = words.end - words.start
    first = eight_bytes(words.data)[words.start]
    docs, hashes = [words.doc], [words.hash]
    for size in STEMS:
        longer = length > size
        docs.append(words.doc[longer])
        hashes.append(mix(keep_bytes(first[longer], np.full(int(longer.sum()), size)) + np.uint64(size)))
    return np.concatenate(docs), np.concatenate(hashes)


def counted(features, column):
    """(text number, feature number, count) over an Arrow text column, for the given sorted features."""
    flags = np.zeros(1 << 16, dtype=bool)
    flags[(features & np.uint64(0xFFFF)).astype(np.int64)] = True
    found = [np.zeros((3, 0), np.int64)]
    for lo, _, data, offsets in column_passes(column, PASS_BYTES):
        docs, hashes = feature_hashes(scan(data, offsets))
        maybe = flags[(hashes & np.uint64(0xFFFF)).astype(np.int64)]
        docs, hashes = docs[maybe], hashes[maybe]
        at = np.minimum(np.searchsorted(features, hashes), max(len(features) - 1, 0))
        hit = features[at] == hashes if len(features) else np.zeros(0, bool)
        pairs, counts = np.unique(docs[hit] * len(features) + at[hit], return_counts=True)
        if len(pairs):
            found.append(np.stack([pairs // len(features) + lo, pairs % len(features), counts]))
    return np.concatenate(found, axis=1)


def _presence(batches):
    """Partial counts: in how many clean and graded texts each feature is present."""
    for batch in batches:
        graded = np.asarray(batch.column("grade").to_numpy(zero_copy_only=False)) > 0
        for lo, _, data, offsets in column_passes(batch.column("text"), PASS_BYTES):
            docs, hashes = feature_hashes(scan(data, offsets))
            order = np.lexsort((docs, hashes))
            docs, hashes = docs[order], hashes[order]
            fresh = np.ones(len(docs), bool)
            fresh[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
            docs, hashes = docs[fresh], hashes[fresh]
            distinct, where = np.unique(hashes, return_inverse=True)
            toxic = np.bincount(where, weights=graded[docs + lo], minlength=len(distinct)).astype(np.int64)
            total = np.bincount(where, minlength=len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct.view(np.int64)), pa.array(toxic), pa.array(total - toxic)], ["feature", "toxic", "clean"])


def _strongest(sample, n_toxic, n_clean):
    """The features with the largest G statistic, bounded by MOST_FEATURES, sorted by hash."""
    counts = sample.mapInArrow(_presence, "feature long, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = F.col("toxic") + F.col("clean")
    expected = total * (n_toxic / (n_toxic + n_clean))

    def part(seen, wanted):
        return F.when(seen > 0, seen * F.log(seen / wanted)).otherwise(0.0)

    g = 2 * (part(F.col("toxic"), expected) + part(F.col("clean"), total - expected))
    rows = counts.where(total >= 3).withColumn("g", g).where(F.col("g") >= LEAST_G)
    top = rows.orderBy(F.desc("g"), "feature").limit(MOST_FEATURES).select("feature").toPandas()["feature"]
    return np.sort(top.to_numpy(np.int64).view(np.uint64))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def train(rows, columns, values, grades, n_features, steps=600, rate=0.05, decay=1e-5):
    """Weights and increasing thresholds of P(grade <= k) = sigmoid(threshold_k - weights . x), by Adam.

    ``rows``, ``columns`` and ``values`` are the sparse features; every grade weighs as much in total as
    clean rows do together with the others of its side, so a rare grade is not drowned.
    """
    k = int(grades.max())
    share = np.where(grades > 0, 0.5 / max((grades > 0).sum(), 1), 0.5 / max((grades == 0).sum(), 1))
    w, gaps = np.zeros(n_features), np.zeros(k)
    gaps[0] = 1.0
    first, second = np.zeros(n_features + k), np.zeros(n_features + k)
    for step in range(1, steps + 1):
        cuts = gaps[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps[1:]))])
        score = np.bincount(rows, weights=w[columns] * values, minlength=len(grades))
        upper = np.where(grades < k, _sigmoid(cuts[np.minimum(grades, k - 1)] - score), 1.0)
        lower = np.where(grades > 0, _sigmoid(cuts[np.maximum(grades - 1, 0)] - score), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        d_up, d_low = upper * (1 - upper) / p * share, lower * (1 - lower) / p * share
        d_score = d_up - d_low
        grad_w = np.bincount(columns, weights=d_score[rows] * values, minlength=n_features) + decay * w
        d_cut = np.bincount(np.maximum(grades - 1, 0), weights=d_low, minlength=k)[:k] - np.bincount(
            np.minimum(grades, k - 1), weights=np.where(grades < k, d_up, 0.0), minlength=k)[:k]
        tail = np.cumsum(d_cut[::-1])[::-1]
        grad = np.concatenate([grad_w, tail[:1], tail[1:] * np.exp(gaps[1:])])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        move = rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-9)
        w, gaps = w - move[:n_features], gaps - move[n_features:]
    return w, gaps[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps[1:]))])


def fit(graded):
    """Learn from a bounded table (text string, grade int >= 0).

    The caller bounds the rows; only counts of the strongest features come to the driver.
    """
    sizes = {r["up"]: r["n"] for r in graded.groupBy((F.col("grade") > 0).alias("up")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    if not n_toxic or not n_clean:
        return nothing
    features = _strongest(graded, n_toxic, n_clean)
    if not len(features):
        return nothing

    def sparse(batches):
        for batch in batches:
            doc, feature, count = counted(features, batch.column("text"))
            grade = np.asarray(batch.column("grade").to_numpy(zero_copy_only=False)).astype(np.int32)
            order = np.argsort(doc, kind="stable")
            cuts = np.searchsorted(doc[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(grade),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature[order].astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(count[order].astype(np.int32)))], ["grade", "feature", "count"])

    got = graded.mapInArrow(sparse, "grade int, feature array<int>, count array<int>").toPandas()
    size = got["feature"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(got)), size)
    columns = np.concatenate([*got["feature"], np.zeros(0, np.int64)]).astype(np.int64)
    values = np.log1p(np.concatenate([*got["count"], np.zeros(0)]).astype(float))
    grades = np.unique(got["grade"].to_numpy(), return_inverse=True)[1]
    weights, thresholds = train(rows, columns, values, grades, len(features))
    return Model(features, weights, thresholds)


def grades_of(sample):
    """Ordered grades from yes/no labels: a bounded (text, label) sample to (text, grade).

    Rows of label 0 are grade 0.  Rows of label 1 are ranked by how often the features that tell the two
    labels apart occur in them, and split into three grades of equal size.
    """
    picked = sample.select("text", F.col("label").alias("grade"))
    sizes = {r["grade"]: r["count"] for r in picked.groupBy("grade").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return picked
    features = _strongest(picked, sizes[1], sizes[0])

    @F.arrow_udf("long")
    def evidence(text: pa.Array) -> pa.Array:
        doc, _, count = counted(features, text)
        return pa.array(np.bincount(doc, weights=count, minlength=len(text)).astype(np.int64))

    scored = picked.withColumn("evidence", evidence("text"))
    low, high = scored.where("grade = 1").approxQuantile("evidence", [1 / 3, 2 / 3], 0.001)
    step = 1 + (F.col("evidence") > low).cast("int") + (F.col("evidence") > high).cast("int")
    return saved(scored.select("text", F.when(F.col("grade") == 1, step).otherwise(0).cast("int").alias("grade")), "graded")


def severity(model, text_column):
    """struct<severity double, grade int, toxic boolean>: expected grade, likeliest grade, and P(grade >= 1) >= 0.5."""

    @F.arrow_udf("severity double, grade int, toxic boolean")
    def of(text: pa.Array) -> pa.Array:
        n = len(text)
        score = np.zeros(n)
        if len(model.thresholds):
            doc, feature, count = counted(model.features, text)
            score = np.bincount(doc, weights=model.weights[feature] * np.log1p(count), minlength=n)
        above = 1 - _sigmoid(model.thresholds[None, :] - score[:, None]) if len(model.thresholds) else np.zeros((n, 1))
        each = np.concatenate([np.ones((n, 1)), above], axis=1) - np.concatenate([above, np.zeros((n, 1))], axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= 0.5)],
            names=["severity", "grade", "toxic"])

    return of(text_column)
