"""Spelling variants: words one edit apart, found through grams of variable length, and the form they stand for.

A dictionary of grams is made from the words: every gram of ``SHORTEST`` characters, and a longer one of up to
``LONGEST`` only where the gram without its last character is in more than ``frequent`` places.  A word is
decomposed into the longest dictionary gram at each place, without those that lie inside the one before.

One edit changes only some of a word's grams: those around its place, and those that a new gram across that
place could swallow.  The most of them over all places bounds the affected grams of the word.  Near words
share all others, at the same places before the edit and at places moved by it behind.  If one of two near
words keeps at least two grams, the two rarest that both share are among the first (affected + 2) grams of
either by rarity.  So the lists of two such grams with their places are merged and what meets is verified.

Lists of more than ``FEW`` words are not merged, and two words that may keep fewer than two grams need not
meet.  These words are joined by what remains after one character is left out, which every two near words
share; both ways are exact, so no pair is lost.

Every word points at its near word of largest count where that is ``ratio`` times its own; counts grow along
the way, so following it ends, in a number of rounds that is the logarithm of the longest way.

Defined results: null and empty texts have no words; a null id counts as the empty text in the hash that
thins the words out; repeated rows count each time; an empty table gives no rows.  Only the named columns
are read, so other columns cannot clash.
"""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from quillgate.llm.store import saved

LEAST_LENGTH, LEAST_COUNT, RATIO, DROPS = 6, 5, 5, 199
SHORTEST, LONGEST = 2, 3
#: Places from which a gram is frequent, and the most grams of a dictionary, which every task holds: twice the
#: places are asked for until the counted grams are no more.
FREQUENT, MOST_GRAMS = 2000, 300_000
#: Words up to which the list of two grams is merged.
FEW = 64
#: Distinct words that a task counts before it hands them on.
MOST_COUNTED = 500_000

#: Maximal runs, once A-Z is lower-cased; a shorter run cannot become a word.
RUNS = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)


def thinned(run, seed, drops=DROPS):
    """The run without one character, if the crc32 of id and run is a multiple of ``drops``."""
    h = zlib.crc32(run.encode(), seed)
    if h % drops:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counts(batches):
    total = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for key, raw in zip(batch.column(0), batch.column(1)):
            text = (raw.as_py() or b"").lower().decode()  # bytes: A-Z alone are lowered
            seed = zlib.crc32(f"{key.as_py() or ''}:".encode())
            for run, n in Counter(RUNS.findall(text)).items():
                word = thinned(run, seed)
                if len(word) >= LEAST_LENGTH:
                    total[word] += n
        if len(total) > MOST_COUNTED:
            yield out()
            total.clear()
    yield out()


def word_counts(docs, id_column="doc_id", text_column="text"):
    """(word, n, length) of all words of at least LEAST_LENGTH characters and LEAST_COUNT occurrences."""
    rows = docs.select(F.col(id_column).cast("string"), F.col(text_column).cast("binary"))
    found = rows.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= LEAST_COUNT).select("word", "n", F.length("word").alias("length"))


def gram_dictionary(words, frequent=FREQUENT):
    """{gram: number of its places}, a bounded number of them, for the tasks to hold."""
    sizes = F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.col("length")))
    grams = F.flatten(F.transform(sizes, lambda q: F.transform(
        F.sequence(F.lit(1), F.col("length") - q + 1), lambda i: F.substring("word", i, q))))
    counts = saved(words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("places")), "grams")
    while True:
        parents = counts.where(F.col("places") > frequent).select(F.col("gram").alias("parent"))
        longer = counts.where(F.length("gram") > SHORTEST).withColumn("parent", F.expr("left(gram, length(gram) - 1)"))
        chosen = saved(longer.join(parents, "parent").select("gram", "places").unionByName(
            counts.where(F.length("gram") == SHORTEST)), "dictionary")
        if chosen.count() <= MOST_GRAMS or chosen.where(F.length("gram") > SHORTEST).isEmpty():
            return {r["gram"]: r["places"] for r in chosen.collect()}
        frequent *= 2


class Grams:
    """Decomposition of words by a dictionary of grams (all beginnings of a gram from SHORTEST on are in it, too)."""

    def __init__(self, places):
        self.places = places
        self.beginnings = {g[:k] for g in places for k in range(1, len(g))}
        self.ends = {g[k:] for g in places for k in range(1, len(g))}

    def cut(self, word):
        """[(start, end)] of the longest gram at each place, without those inside the one before."""
        out, reached = [], 0
        for start in range(len(word) - SHORTEST + 1):
            end = start + SHORTEST
            while end < len(word) and word[start:end + 1] in self.places:
                end += 1
            if end > reached:
                out.append((start, end))
                reached = end
        return out

    def affected(self, word, cuts):
        """Most grams that one edit may change; an insertion changes no more than a replacement at its place does."""
        most = 0
        for at in range(len(word) + 1):
            left = right = at
            for start in range(max(0, at - LONGEST + 1), at):
                if word[start:at] in self.beginnings:  # a gram that begins here may now reach across
                    left = start
                    break
            after = right = at + 1
            for end in range(min(len(word), after + LONGEST - 1), after, -1):
                if word[after:end] in self.ends:  # a new gram across may end here
                    right = end
                    break
            most = max(most, sum(1 for start, end in cuts if (
                start >= left if end <= at else end <= right if start >= after else True)))
        return most

    def rarest(self, word):
        """([(start, gram)] of the first affected + 2 grams by rarity, in order of place; whether fewer than two are surely kept)."""
        cuts = self.cut(word)
        most = self.affected(word, cuts)
        order = sorted((self.places.get(word[a:b], 0), word[a:b], a) for a, b in cuts)
        return sorted((start, gram) for _, gram, start in order[:most + 2]), len(cuts) - most < 2


def _key(length, first, second, moved_first=0, moved_second=0):
    name = f"{length} {first[0] + moved_first} {first[1]} {second[0] + moved_second} {second[1]}"
    return xxhash.xxh64_intdigest(name)


def gram_lists(words, places):
    """(word, key, own, loose): own keys of each word, and the keys that a near word of one more character has."""
    sent = words.sparkSession.sparkContext.broadcast(places)

    def run(batches):
        grams = Grams(sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 5000):
                names, keys, own, open_ = [], [], [], []
                for word in batch.column(0).slice(lo, 5000).to_pylist():
                    found, loose = grams.rarest(word)
                    size = len(word)
                    mine = [_key(size, *two) for two in combinations(found, 2)]
                    # an added character moves neither, the second or both
                    longer = [_key(size + 1, *two, *moved) for two in combinations(found, 2) for moved in ((0, 0), (0, 1), (1, 1))]
                    keys += [0, *mine, *longer]
                    names += [word] * (1 + len(mine) + len(longer))
                    own += [None] + [True] * len(mine) + [False] * len(longer)
                    open_ += [loose] * (1 + len(mine) + len(longer))
                yield pa.RecordBatch.from_arrays([
                    pa.array(names, pa.string()), pa.array(np.array(keys, np.uint64).view(np.int64)),
                    pa.array(own, pa.bool_()), pa.array(open_, pa.bool_())], ["word", "key", "own", "loose"])

    # a word is much work from few bytes: deal the words out
    return words.select("word").repartition("word").mapInArrow(run, "word string, key long, own boolean, loose boolean")


def _without_one(words):
    """Pairs of words that are near, by what remains after one character is left out (a word of n has n + 1 such rows)."""
    rest = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(
        F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    rows = saved(words.select("word", F.explode(F.array_distinct(F.concat(F.array("word"), rest))).alias("rest")), "rests")
    a, b = rows.select("rest", F.col("word").alias("a")), rows.select("rest", F.col("word").alias("b"))
    return a.join(b, "rest").where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b") == 1)).select("a", "b")


def near_pairs(words, frequent=FREQUENT, few=FEW):
    """(a, b), a < b: all pairs of words (columns word, length) that differ by one inserted, deleted or replaced character."""
    lists = saved(gram_lists(words, gram_dictionary(words, frequent)), "gram-lists")
    own, longer = lists.where("own").select("key", F.col("word").alias("a")), lists.where("not own").select("key", "word")
    sizes = saved(own.groupBy("key").agg(F.count("*").alias("n")), "list-sizes")
    some = saved(own.join(sizes.where(F.col("n") <= few).select("key"), "key"), "few")
    near = F.levenshtein("a", "b") == 1
    same = some.join(some.select("key", F.col("a").alias("b")), "key").where((F.col("a") < F.col("b")) & near)
    added = some.join(longer.select("key", F.col("word").alias("b")), "key").where(near)
    met = same.unionByName(added).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    many = lists.where("own is not null").join(sizes.where(F.col("n") > few).select("key"), "key").select("word")
    rest = saved(many.unionByName(lists.where("own is null and loose").select("word")).distinct(), "crowded-words")
    return met.select("a", "b").unionByName(_without_one(rest)).distinct()


def _roots(words):
    """(word, root): forms followed to the last; the way halves in every round."""
    now = saved(words.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("top"))
        after = saved(now.join(up, "root").select("word", F.col("root").alias("before"), F.col("top").alias("root")), "roots")
        if after.where("before <> root").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def spelling_variants(docs, id_column="doc_id", text_column="text", ratio=RATIO):
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    words = saved(word_counts(docs, id_column, text_column), "words")
    pairs = saved(near_pairs(words), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = words.select(F.col("word").alias("b"), F.col("n").alias("near_n"))
    near = both.join(known, "b").groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best.form", (-F.col("best.less")).alias("form_n"))
    stands = F.col("form_n") >= ratio * F.col("n")
    forms = saved(forms.select("word", "n", "n_near", F.when(stands, F.col("form")).alias("form"), F.when(stands, F.col("form_n")).alias("form_n")), "forms")
    return forms.join(_roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
