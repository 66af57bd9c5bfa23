"""Benchmark decontamination: suffix arrays over the training texts, searched for every benchmark suffix.

Each task cuts its documents into shards, sorts all word suffixes of a shard by prefix doubling, and
narrows the interval of every benchmark suffix word by word with vectorised binary searches.  The
interval at window length holds all places of a window; windows that follow each other on one
alignment make up the verbatim matches with their locations.  Words are compared by 64-bit hashes, and
every match is confirmed by second, independent hashes of its words.

The benchmark is searched in parts of bounded size, so a task never holds more than one of them.  With
one part, matches are a column (``matches``); with more, every part is searched for itself and the matches
of a document are put together (``match_table``).

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
Defined results: null and empty texts have no words and no hits; null and empty items have no windows;
a null item_id hits words but is not listed; items that share an id are listed once; repeated rows get
equal results; with no items nothing is hit; very long texts are a shard of their own.  Only the named
columns are read, so other columns cannot clash.
"""

from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from quillgate.llm.store import saved
from quillgate.llm.words import column_passes, hash_spans, mix, scan

#: Bytes of benchmark text that a task holds at once; a longer item is a part of its own.
PART_BYTES = 4 << 20
#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20
_CONFIRM = 0x5851F42D4C957F2D
MATCH = ("n_words long, n_hit long, items array<string>, "
         "spans array<struct<word: int, words: int, item_id: string, item_word: int>>")


class Items(NamedTuple):
    """Benchmark words with, for each word, the end of its item; distinct windows and the ids that own each."""

    hashes: np.ndarray
    confirm: np.ndarray
    ends: np.ndarray
    window_at: np.ndarray
    window_words: np.ndarray
    owner_starts: np.ndarray
    owners: np.ndarray
    ids: list
    item_of: np.ndarray
    first_word: np.ndarray
    names: list


def item_parts(benchmark, window=13, part_bytes=None):
    """Index of each part of the benchmark (item_id, text), part by part; the parts are cut by running sizes.

    Items come to the driver one part at a time.
    """
    part_bytes = PART_BYTES if part_bytes is None else part_bytes
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    if size <= part_bytes:
        yield _indexed(rows, window)
        return
    # parts by hash: each holds about half of the bound, and is cut again where it holds more
    n = -(-2 * size // part_bytes)
    dealt = saved(rows.distinct().withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "items")
    held = dealt.groupBy("part").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("items"))
    for part in held.orderBy("part").collect():  # one row for each part that holds items
        mine = dealt.where(F.col("part") == part["part"])
        if part["bytes"] > part_bytes and part["items"] > 1:
            order = Window.partitionBy("part").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, 0)
            mine = saved(mine.withColumn("cut", F.floor(F.sum(F.octet_length("text")).over(order) / part_bytes)), "items-cut")
            for row in mine.select("cut").distinct().orderBy("cut").collect():
                yield _indexed(mine.where(F.col("cut") == row["cut"]), window)
        else:
            yield _indexed(mine, window)


def _indexed(rows, window):
    found = rows.select("item_id", "text").collect()
    found.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or "", r["text"]))
    return index_items([r["item_id"] for r in found], [r["text"] for r in found], window)


def load_items(benchmark, window=13):
    """Index of a benchmark of one part; larger ones are searched by ``match_table``, and refused at their second part."""
    first, rest = _in_parts(benchmark, window, None)
    if rest is not None:
        raise ValueError(f"benchmark text is longer than {PART_BYTES} bytes; search it with match_table")
    return first


def index_items(names, texts, window=13):
    column = pa.array(texts, pa.string())
    parts = [(lo, scan(data, offsets)) for lo, _, data, offsets in column_passes(column)]
    item = np.concatenate([lo + w.doc for lo, w in parts] or [np.zeros(0, np.int64)])
    hashes = np.concatenate([w.hash for _, w in parts] or [np.zeros(0, np.uint64)])
    confirm = np.concatenate([hash_spans(w.data, w.start, w.end, _CONFIRM) for _, w in parts] or [np.zeros(0, np.uint64)])
    n = len(hashes)
    count = np.bincount(item, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    last = np.cumsum(count)
    ends = last[item]
    first_word = last - count
    at = np.arange(n)
    short = count[item] < window
    starts = np.flatnonzero(np.where(short, at == first_word[item], at + window <= ends))
    words = np.where(short, count[item], window)[starts]
    key = np.zeros(len(starts), np.uint64)
    for k in range(window):
        more = words > k
        key[more] = mix(key[more] * np.uint64(31) + hashes[starts[more] + k] + np.uint64(k))
    _, first, distinct = np.unique(key, return_index=True, return_inverse=True)
    ids = sorted({x for x in names if x is not None})
    number = {x: i for i, x in enumerate(ids)}
    owner = np.array([number.get(x, -1) for x in names], np.int64)[item[starts]] if n else np.zeros(0, np.int64)
    pairs = np.unique(np.stack([distinct, owner], axis=1)[owner >= 0], axis=0) if len(starts) else np.zeros((0, 2), np.int64)
    owner_starts = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
    return Items(hashes, confirm, ends, starts[first], words[first], owner_starts, pairs[:, 1], ids, item, first_word, list(names))


class Shard(NamedTuple):
    """Suffixes of all texts in order, sorted to ``depth`` words; word ranks from 1, and each word's text end."""

    order: np.ndarray
    ranks: np.ndarray
    distinct: np.ndarray
    ends: np.ndarray
    depth: int


def build_shard(words, window=13):
    """Suffix array by prefix doubling; a suffix ends with its text."""
    n = len(words.hash)
    distinct, first = np.unique(words.hash, return_inverse=True)
    ranks = first.astype(np.int32)
    ranks += 1
    del first
    ends = np.cumsum(np.bincount(words.doc)).astype(np.int32)[words.doc] if n else np.zeros(0, np.int32)
    rank, depth = ranks, 1
    order = np.argsort(rank, kind="stable").astype(np.int32)
    while depth < window:
        key = rank.astype(np.int64)
        key *= n + 1
        key[:-depth] += np.where(words.doc[depth:] == words.doc[:-depth], rank[depth:], 0)
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        fresh = np.ones(n, np.int32)
        fresh[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(fresh, dtype=np.int32)
        depth *= 2
    return Shard(order, ranks, distinct, ends, depth)


def search(shard, items):
    """(window number, place) of every window occurrence in the shard, from a search of every item suffix."""
    n, wanted = len(shard.order), len(items.hashes)
    if not n or not wanted:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(shard.distinct, items.hashes), len(shard.distinct) - 1)
    rank = np.where(shard.distinct[at] == items.hashes, at + 1, -1)
    window_of = np.full(wanted, -1, np.int64)
    window_of[items.window_at] = np.arange(len(items.window_at))
    suffix = np.arange(wanted)
    low, high = np.zeros(wanted, np.int64), np.full(wanted, n, np.int64)
    windows, places = [], []
    for d in range(shard.depth):
        on = (suffix + d < items.ends[suffix]) & (high > low)
        suffix, low, high = suffix[on], low[on], high[on]
        if not len(suffix):
            break
        value = rank[suffix + d]

        def bound(after):
            lo, hi = low.copy(), high.copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                place = shard.order[np.minimum(mid, n - 1)]
                word = np.where(place + d < shard.ends[place], shard.ranks[np.minimum(place + d, n - 1)], 0)
                right = (word <= value if after else word < value) & open_
                lo = np.where(right, mid + 1, lo)
                hi = np.where(right | ~open_, hi, mid)
            return lo

        low, high = bound(False), bound(True)
        number = window_of[suffix]
        done = (number >= 0) & (high > low)
        done[done] = items.window_words[number[done]] == d + 1
        for w, lo, hi in zip(number[done], low[done], high[done]):
            places.append(shard.order[lo:hi])
            windows.append(np.full(hi - lo, w))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(windows), np.concatenate(places).astype(np.int64)


def confirmed(windows, places, words, items):
    """The occurrences whose words are the same by the second hash, too."""
    good = np.ones(len(places), bool)
    for k in range(int(items.window_words[windows].max()) if len(windows) else 0):
        on = np.flatnonzero(good & (items.window_words[windows] > k))
        at, distinct = np.unique(places[on] + k, return_inverse=True)
        good[on] &= hash_spans(words.data, words.start[at], words.end[at], _CONFIRM)[distinct] == items.confirm[items.window_at[windows[on]] + k]
    return windows[good], places[good]


def _spans(windows, places, words, items):
    """Verbatim matches: windows that follow each other on one alignment, as (text, word, words, item, item word)."""
    start = items.window_at[windows]
    order = np.lexsort((places, places - start))
    start, place, length = start[order], places[order], items.window_words[windows][order]
    doc = words.doc[place]
    same = np.zeros(len(place), bool)
    same[1:] = (place[1:] == place[:-1] + 1) & (start[1:] == start[:-1] + 1) & (doc[1:] == doc[:-1]) & (
        items.item_of[start[1:]] == items.item_of[start[:-1]])
    heads = np.flatnonzero(~same)
    tails = np.append(heads[1:], len(place))[:len(heads)] - 1
    total = place[tails] + length[tails] - place[heads]
    found = np.stack([doc[heads], place[heads], total, items.item_of[start[heads]], start[heads]], axis=1)
    return found[np.lexsort((found[:, 4], found[:, 1], found[:, 0]))]


def _lists(doc, n, values):
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), values)


def match_pass(data, offsets, items, window):
    """The MATCH struct of the texts of one shard."""
    n = len(offsets) - 1
    words = scan(data, offsets)
    total = np.bincount(words.doc, minlength=n)
    windows, places = confirmed(*search(build_shard(words, window), items), words, items)
    edge = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + items.window_words[windows], -1)
    hit = np.cumsum(edge)[:-1] > 0
    n_hit = np.bincount(words.doc[hit], minlength=n)
    pairs = np.unique(np.stack([words.doc[places], windows], axis=1), axis=0)
    size = items.owner_starts[pairs[:, 1] + 1] - items.owner_starts[pairs[:, 1]]
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    owned = np.stack([np.repeat(pairs[:, 0], size), items.owners[np.repeat(items.owner_starts[pairs[:, 1]], size) + inner]], axis=1)
    owned = np.unique(owned, axis=0)
    found = _spans(windows, places, words, items)
    first = np.searchsorted(words.doc, found[:, 0])
    spans = pa.StructArray.from_arrays([
        pa.array((found[:, 1] - first).astype(np.int32)), pa.array(found[:, 2].astype(np.int32)),
        pa.array([items.names[i] for i in found[:, 3]], pa.string()),
        pa.array((found[:, 4] - items.first_word[found[:, 3]]).astype(np.int32) if len(found) else np.zeros(0, np.int32))],
        names=["word", "words", "item_id", "item_word"])
    return pa.StructArray.from_arrays([
        pa.array(total.astype(np.int64)), pa.array(n_hit.astype(np.int64)),
        _lists(owned[:, 0], n, pa.array([items.ids[i] for i in owned[:, 1]], pa.string())),
        _lists(found[:, 0], n, spans)], names=["n_words", "n_hit", "items", "spans"])


def matches(items, text_column, window=13):
    """The MATCH struct of every whole text: words, words inside window occurrences, items found, verbatim matches."""
    sent = SparkSession.getActiveSession().sparkContext.broadcast(items)

    @F.arrow_udf(MATCH)
    def of(text: pa.Array) -> pa.Array:
        items = sent.value
        parts = [match_pass(data, offsets, items, window) for _, _, data, offsets in column_passes(text, SHARD_BYTES)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([
            ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
            ("spans", pa.list_(pa.struct([("word", pa.int32()), ("words", pa.int32()), ("item_id", pa.string()), ("item_word", pa.int32())])))]))

    return of(text_column)


def _covered(spans):
    """Words inside any of the spans (sorted by their first word), in a text of one document."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))
    return F.aggregate(spans, start, lambda done, s: F.struct(
        F.greatest(done["end"], s["word"] + s["words"]).alias("end"),
        (done["words"] + F.greatest(s["word"] + s["words"] - F.greatest(s["word"], done["end"]), F.lit(0))).alias("words")))["words"]


def _numbered_matches(rows, first, rest, text_column, window):
    """(row, m) of a stored table with row numbers, for several parts of a benchmark."""
    found, n_words = None, None
    for items in chain((first,), rest):
        one = saved(rows.select("row", matches(items, F.col(text_column), window).alias("m")), "part")
        n_words = one.select("row", "m.n_words") if n_words is None else n_words
        hits = one.where("m.n_hit > 0").select("row", "m.items", "m.spans")
        found = hits if found is None else found.unionByName(hits)
    whole = found.groupBy("row").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans")).withColumn("n_hit", _covered(F.col("spans")))
    kinds = {f.name: f.dataType for f in one.schema["m"].dataType.fields}
    put = n_words.join(whole, "row", "left")
    value = lambda c: F.coalesce(F.col(c), F.array().cast(kinds[c]) if c in ("items", "spans") else F.lit(0).cast(kinds[c])).alias(c)
    return put.select("row", F.struct(*[value(c) for c in ("n_words", "n_hit", "items", "spans")]).alias("m"))


def _in_parts(benchmark, window, part_bytes):
    parts = item_parts(benchmark, window, part_bytes)
    first, second = next(parts), next(parts, None)
    return first, None if second is None else chain((second,), parts)


def match_table(docs, benchmark, id_column="doc_id", text_column="text", window=13, part_bytes=None):
    """(id, m) with the MATCH struct of every row of ``docs``, for a benchmark of any size.

    A benchmark of one part is one column over the documents.  A larger one is searched part by part, each
    held alone; rows are numbered in a stored table, and the spans and items of a row, which its own text
    bounds, are put together.  A task never holds more than a part, and documents are read once for each.
    """
    first, rest = _in_parts(benchmark, window, part_bytes)
    if rest is None:
        return docs.select(id_column, matches(first, F.col(text_column), window).alias("m"))
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text_column).alias("text")), "numbered")
    found = _numbered_matches(rows, first, rest, "text", window)
    return rows.select("row", "id").join(found, "row").select(F.col("id").alias(id_column), "m")


def keep_clean(docs, benchmark, text_column="text", window=13, part_bytes=None):
    """The rows of ``docs`` that are not contaminated, with all columns."""
    first, rest = _in_parts(benchmark, window, part_bytes)
    if rest is None:
        return docs.where(~contaminated(matches(first, F.col(text_column), window)))
    packed = docs.select(F.struct(*docs.columns).alias("d"), F.col(text_column).alias("text"))
    rows = saved(packed.withColumn("row", F.monotonically_increasing_id()), "numbered")
    bad = _numbered_matches(rows, first, rest, "text", window).where(contaminated(F.col("m"))).select("row")
    return rows.join(bad, "row", "left_anti").select("d.*")


def contaminated(match):
    """A twentieth of a text's words, and at least one, is inside window occurrences."""
    return (match["n_hit"] > 0) & (20 * match["n_hit"] >= match["n_words"])
