"""Importance resampling towards a target: hashed word n-grams of both corpora, Gumbel scores, largest first.

Texts are split in bytes: one table of 256 entries lower-cases A-Z and blanks every separator (bytes of
non-ASCII characters stay), ``bytes.split`` gives the words, and the crc32 of an n-gram continues that of
the n-gram without its last word.  Counters reduce the buckets of a batch, Spark sums the batches.

Every bucket has a gain, 1000 times the logarithm of its smoothed share in the target over that in the
corpus; a text's weight is the mean gain of its n-grams, rounded down, and its score adds noise seeded by
its id, so the largest scores are a draw without replacement by weight.

Ranks are made without a global sort: the counts by score (whole numbers in a narrow range, so few rows at
any size) give the place of each score, and rows of one score are numbered by id among themselves; equal
rows are counted first and numbered together.

Defined results: a null or empty text has no words, no features and weight 0; a text of fewer than
``least_words`` words is never drawn; a null id has the noise of the empty text and comes last among ties;
rows that repeat an id tie further by weight and number of features; repeated rows take ranks next to each
other; an empty target or corpus has no counts, so gains come from the smoothing alone; an empty table
gives no rows.  Only the named columns are read, so other columns cannot clash.
"""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgate.llm.store import saved

BUCKETS = 10_000
MOST_WORDS = 2
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
#: Words that are hashed and counted at once.
BLOCK = 1 << 16
#: Ranks that one row is expanded to at once.
RUN = 10_000

#: Lower-cases A-Z, keeps digits, a-z and the bytes of non-ASCII characters, blanks all others.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw):
    return raw.translate(TABLE).split()


def features(words, most_words=MOST_WORDS):
    """The crc32 of every run of one to ``most_words`` words, block by block; each is extended by one word at a time."""
    for lo in range(0, len(words), BLOCK):
        part = words[lo:lo + BLOCK + most_words - 1]
        here = min(BLOCK, len(words) - lo)
        seeds = [zlib.crc32(w) for w in part[:here]]
        yield seeds
        follow = [b" " + w for w in part]
        for k in range(1, most_words):
            seeds = [zlib.crc32(w, s) for w, s in zip(follow[k:], seeds)]
            yield seeds


def _texts(column):
    for value in column:
        yield value.as_py() or b""


def bucket_counts(texts, text_column="text", buckets=BUCKETS, most_words=MOST_WORDS):
    """(bucket, n) over all features of all whole texts."""
    def count(batches):
        for batch in batches:
            total = Counter()
            for raw in _texts(batch.column(0)):
                for seeds in features(words_of(raw), most_words):
                    total.update([s % buckets for s in seeds])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total.keys()), pa.int32()), pa.array(list(total.values()), pa.int64())], ["bucket", "n"])

    found = texts.select(F.col(text_column).cast("binary")).mapInArrow(count, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus, target, buckets=BUCKETS):
    """Gain of every bucket, from two tables of at most ``buckets`` counts."""
    def dense(counts):
        out = np.zeros(buckets, np.int64)
        for r in counts.collect():
            out[r["bucket"]] = r["n"]
        return out.astype(float), float(out.sum())

    (s, corpus_total), (t, target_total) = dense(corpus), dense(target)
    return np.floor(1000 * np.log((t + 1) * (corpus_total + buckets) / ((s + 1) * (target_total + buckets)))).astype(np.int64)


def weighed(gain, text_column, most_words=MOST_WORDS):
    """struct<n_words long, n_features long, weight long> of every whole text."""
    @F.arrow_udf("n_words long, n_features long, weight long")
    def of(column: pa.Array) -> pa.Array:
        rows = []
        for raw in _texts(column):
            words, n, total = words_of(raw), 0, 0
            for seeds in features(words, most_words):
                n += len(seeds)
                total += int(gain[np.array(seeds, np.int64) % len(gain)].sum())
            rows.append((len(words), n, total // n if n else 0))
        return pa.StructArray.from_arrays(
            [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["n_words", "n_features", "weight"])

    return of(text_column.cast("binary"))


def noise(id_column, seed=SEED):
    """Gumbel noise of an id in thousandths, rounded down, from the first 32 bits of a sha256."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(scored, id_column, drawn):
    """Rows of the ``drawn`` highest scores with their rank; others with a null rank."""
    key = [id_column, "n_features", "weight", "score"]
    counted = saved(scored.groupBy(*key, "enough").agg(F.count("*").alias("n")), "scored-rows")
    sizes = counted.where("enough").groupBy("score").agg(F.sum("n").alias("rows"))
    # whole scores of a narrow range: a bounded number of rows, whatever the input
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(sizes.select("score", F.coalesce(F.sum("rows").over(above), F.lit(0)).alias("offset")), "score-offsets")
    able = counted.where("enough").join(offsets.where(F.col("offset") < drawn), "score", "left")
    inside = Window.partitionBy("score").orderBy(F.col(id_column).asc_nulls_last(), F.desc("weight"), "n_features").rowsBetween(
        Window.unboundedPreceding, -1)
    reached = able.where("offset is not null")
    first = reached.withColumn("first", F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    rest = counted.where(~F.col("enough")).unionByName(able.where("offset is null").drop("offset")).withColumn("first", F.lit(None).cast("long"))
    placed = first.drop("offset").unionByName(rest)
    # equal rows come back one by one, a run of ranks at a time
    runs = placed.select(*key, "first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("run"))
    each = runs.select(*key, "first", F.explode(F.sequence(
        F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("n")) - 1)).alias("k"))
    rank = F.col("first") + F.col("k") + 1
    return each.select(id_column, "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def resample(docs, target, id_column="doc_id", text_column="text", percent=PERCENT, least_words=LEAST_WORDS,
             seed=SEED, buckets=BUCKETS, most_words=MOST_WORDS):
    """(id, n_features, weight, score, rank) of every row of ``docs``; rank is null where the row is not drawn."""
    gain = gains(bucket_counts(docs, text_column, buckets, most_words), bucket_counts(target, text_column, buckets, most_words), buckets)
    found = docs.select(F.col(id_column), weighed(gain, F.col(text_column), most_words).alias("w"))
    scored = saved(found.select(
        id_column, "w.n_features", "w.weight", (F.col("w.weight") + noise(F.col(id_column), seed)).alias("score"),
        (F.col("w.n_words") >= least_words).alias("enough")), "scores")
    able = scored.where("enough").count()
    return _ranked(scored, id_column, percent * able // 100)
