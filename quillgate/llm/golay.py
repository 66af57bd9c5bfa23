"""Near duplicates by SimHash: fingerprints found again through nearby Golay codewords.

A fingerprint has 64 bits: bit i is 1 if more than half of a text's three-word shingles have it in their
XXH64.  Two fingerprints are linked if they differ in at most ``RADIUS`` = 2 bits.

The binary Golay code of 23 bits is perfect: every word is within three bits of exactly one codeword, whose
12 information bits are its index.  A fingerprint is cut into three segments of at most 23 bits (zeros in
front).  Of two errors, one segment has none and another one at most one.  So a key is a whole segment with
a codeword index of another: a fingerprint's own keys take the index of the other segment itself, its
probing keys take those of all words within one bit of it, mostly six.  A linked fingerprint has an own key
among the probing keys; they are joined on them and verified.

Buckets of more than ``FEW`` probing keys are not joined.  Their fingerprints are written once for each
word within one bit (65); fingerprints that meet at such a word differ in two bits at most and are linked
without comparing pairs, and every two that differ in two bits or fewer meet there.  So no link is lost and
a crowded family costs 65 rows a member.

Defined results: a null or empty text, or one of white space alone, has the fingerprint 0, linked like any
other; a text of one or two words is one shingle; repeated rows are equal rows; the component of rows whose
component has null ids alone is null; an empty table gives no rows.  Only the two named columns are read,
so other columns cannot clash.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from quillgate.llm.components import components
from quillgate.llm.store import saved, sent

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: (lowest bit, width) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Probing keys up to which a bucket is joined as it is.
FEW = 32
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the code.
GENERATOR = 0b110001110101


def _syndromes():
    """Remainder of every single bit by the generator."""
    out, value = [], 1
    for _ in range(23):
        out.append(value)
        value <<= 1
        if value >> 11:
            value ^= GENERATOR
    return out


def _code():
    """(syndromes of every byte at each of three places, error pattern of every syndrome)."""
    single = np.array(_syndromes(), np.uint32)
    byte = np.zeros((3, 256), np.uint32)
    for place in range(23):
        values = np.arange(256)
        byte[place // 8] ^= np.where(values >> (place % 8) & 1, single[place], 0).astype(np.uint32)
    errors = np.zeros(2048, np.uint32)
    for a in range(23):
        errors[single[a]] = 1 << a
        for b in range(a):
            errors[single[a] ^ single[b]] = 1 << a | 1 << b
            for c in range(b):
                errors[single[a] ^ single[b] ^ single[c]] = 1 << a | 1 << b | 1 << c
    return byte, errors


BYTE_SYNDROMES, ERRORS = _code()


def codeword_index(words):
    """The 12 information bits of the codeword nearest to each 23-bit word."""
    words = words.astype(np.uint32)
    syndrome = BYTE_SYNDROMES[0][words & 255] ^ BYTE_SYNDROMES[1][words >> 8 & 255] ^ BYTE_SYNDROMES[2][words >> 16]
    return (words ^ ERRORS[syndrome]) >> 11


def nearby_indices(words, width):
    """(row, index) of the distinct codeword indices of all words within one bit among the lower ``width``."""
    each = [codeword_index(words)] + [codeword_index(words ^ np.uint32(1 << place)) for place in range(width)]
    table = np.sort(np.stack(each, axis=1), axis=1)
    fresh = np.ones(table.shape, bool)
    fresh[:, 1:] = table[:, 1:] != table[:, :-1]
    rows = np.repeat(np.arange(len(words)), fresh.sum(axis=1))
    return rows, table[fresh]


def keys_of(prints, probing):
    """(row, key) of 64-bit fingerprints: a whole segment and a codeword index of another one."""
    parts = [(prints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.uint32) for low, width in SEGMENTS]
    rows, keys, number = [], [], 0
    for j, (_, width) in enumerate(SEGMENTS):
        at, index = nearby_indices(parts[j], width) if probing else (np.arange(len(prints)), codeword_index(parts[j]))
        for i in range(len(SEGMENTS)):
            if i != j:
                rows.append(at)
                keys.append(np.int64(number) << 34 | parts[i][at].astype(np.int64) << 12 | index.astype(np.int64))
                number += 1
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(raw):
    """64-bit fingerprint of a text's UTF-8 bytes."""
    words = raw.lower().split()  # bytes: A-Z alone are lowered, and the six ASCII white-space characters separate
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    del words
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(len(size) - SHINGLE_WORDS + 1, 1)
    starts, ends = starts[:n], ends[-n:]
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, BLOCK):
        some = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[lo:lo + BLOCK].tolist(), ends[lo:lo + BLOCK].tolist())]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhash(text_column):
    """Fingerprint of every whole text, as a long of the same bits."""
    @F.arrow_udf("long")
    def of(raw: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x.as_py() or b"") for x in raw], np.uint64).view(np.int64))

    return of(text_column.cast("binary"))


def _keys(prints, probing):
    """(fp, key) rows; a batch of fingerprints at a time, cut so that its keys stay small."""
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for lo in range(0, len(fp), 20_000):
                part = fp[lo:lo + 20_000]
                rows, keys = keys_of(part.view(np.uint64), probing)
                yield pa.RecordBatch.from_arrays([pa.array(part[rows]), pa.array(keys)], ["fp", "key"])

    return prints.select("fp").mapInArrow(run, "fp long, key long")


def _ball_links(crowded):
    """Links of crowded fingerprints: those that meet at a word within one bit hang on the smallest of them."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    near = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    met = near.groupBy("word").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)  # at most 65
    return met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()


def print_links(prints):
    """(a, b) links of distinct fingerprints (a column fp) that make up all components."""
    # a row of a print becomes some forty keys: deal the prints out before
    own = _keys(prints, False)
    probing = saved(_keys(prints, True), "probing-keys")
    sizes = saved(probing.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-sizes")
    few, many = sizes.where(F.col("n") <= FEW).select("key"), sizes.where(F.col("n") > FEW).select("key")
    mine, theirs = own.join(few, "key").select("key", F.col("fp").alias("a")), probing.select("key", F.col("fp").alias("b"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    joined = mine.alias("m").join(
        theirs.alias("t"), (F.col("m.key") == F.col("t.key")) & (F.col("a") != F.col("b")) & (apart <= RADIUS)).select("a", "b")
    crowded = saved(probing.join(many, "key").select("fp").distinct(), "crowded-prints")
    return joined.unionByName(_ball_links(crowded))


def near_duplicates(docs, id_column="doc_id", text_column="text"):
    """(id, fingerprint in 16 hex digits, component_id) of every row; the component is its smallest id.

    Rows of one fingerprint are counted as one before anything is joined, so copies are never paired.
    """
    rows = saved(docs.select(F.col(id_column).alias("id"), simhash(F.col(text_column)).alias("fp")), "fingerprints")
    prints = saved(rows.groupBy("fp").agg(F.min("id").alias("first")), "prints")
    placed = saved(prints.join(components(print_links(prints)), prints["fp"] == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = saved(placed.join(least, "component").select("fp", "component_id"), "print-components")
    return rows.join(sent(named), "fp").select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
