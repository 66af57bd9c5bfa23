"""Near duplicates by ProbMinHash: weighted five-word shingles, banding, exact verification, components.

The weight of a shingle is how often a text holds it.  Each shingle is a Poisson process with its weight
as rate: its arrivals are exponential steps seeded by the shingle, every arrival lands in one register,
and the earliest arrival of each register is kept.  Arrivals later than the time at which all registers
of a text are taken end the process early.  Two texts agree in a register with their probability
Jaccard similarity; five registers make a band.

Texts of equal words are one node.  Nodes that share a band are compared in their exact probability
Jaccard: first with the bucket's most connected node, then, only in buckets that do not hang together yet,
with each other.  In crowded buckets a pair must share one of the rarest shingles that make up a fifth of
either text, so nodes are listed by those and only listed pairs are compared.  No link that a band shows
is lost.

Defined results: a text of one to four words is one shingle; texts without words are equal only if their
characters are; a null text is a class of its own; a class is named by its smallest id (null, where all of
its ids are) and by the node of its representative, so texts without an id are compared like others;
repeated rows share a class; very long texts are a pass of their own; an empty table gives no rows.  Only
the two named columns are read, so other columns cannot clash.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgate.llm.components import components
from quillgate.llm.store import saved, sent, small_batches
from quillgate.llm.words import column_passes, hash_spans, make_room, mix, scan
from quillgate.operators.rows import settle

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 26, 5
REGISTERS = BANDS * BAND_ROWS

#: Members up to which an unfinished bucket is compared as it is, and nodes up to which a shingle is rare.
FEW, RARE = 32, 10

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1


def node_keys(words, data, offsets):
    """16 bytes for each text: two hashes of its word sequence, or of its characters if it has no words."""
    n = len(offsets) - 1
    first = np.searchsorted(words.doc, np.arange(n))
    place = (np.arange(len(words.doc)) - first[words.doc]).astype(np.uint64)
    count = np.bincount(words.doc, minlength=n)
    out = np.zeros((n, 2), np.uint64)
    for side, seed in enumerate((np.uint64(0x1B873593), np.uint64(0xCC9E2D51))):
        each = mix(words.hash + mix(place * _GOLD + seed))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        out[:, side] = mix(total[first + count] - total[first] + count.astype(np.uint64))
        bare = np.flatnonzero(count == 0)
        if len(bare):
            out[bare, side] = hash_spans(np.concatenate([data, np.zeros(8, np.uint8)]), offsets[:-1][bare], offsets[1:][bare], int(seed))
    return pa.array([r.tobytes() for r in out], pa.binary())


def shingles(words, n, size=SHINGLE_WORDS):
    """(text number, shingle hash, count), sorted by text and hash; a shorter text is one shingle."""
    count = np.bincount(words.doc, minlength=n)
    length = len(words.hash)
    key = np.zeros(length, np.uint64)
    position = np.arange(length)
    ends = np.cumsum(count)[words.doc] if length else np.zeros(0, np.int64)
    starts = ends - count[words.doc]
    for k in range(size):
        inside = np.flatnonzero(position + k < ends)
        key[inside] = mix(key[inside] * np.uint64(0x100000001B3) + words.hash[inside + k])
    whole = (position + size <= ends) | ((position == starts) & (ends - starts < size))
    doc, key = words.doc[whole], key[whole]
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(fresh)
    return doc[at], key[at], np.diff(np.append(at, len(doc)))


def registers(doc, key, weight, n, m=REGISTERS):
    """(n, m) hashes of the elements that arrive first in each register; zero rows for texts without elements."""
    out = np.zeros((n, m), np.uint64)
    rate = np.bincount(doc, weights=weight, minlength=n)
    limit = np.zeros(n)
    limit[rate > 0] = m * (np.log(m) + 3.0) / rate[rate > 0]
    todo = np.flatnonzero(rate > 0)
    while len(todo):
        mine = np.zeros(n, bool)
        mine[todo] = True
        active = np.flatnonzero(mine[doc])
        clock, step = np.zeros(len(active)), 0
        cells, times, who = [], [], []
        while len(active):
            step += 1
            u = mix(key[active] + np.uint64(step * int(_GOLD) & _ALL))
            clock = clock - np.log(((u >> np.uint64(11)).astype(float) + 1.0) * 2.0 ** -53) / weight[active]
            alive = clock <= limit[doc[active]]
            active, clock, u = active[alive], clock[alive], u[alive]
            register = ((mix(u ^ _GOLD) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            cells.append(doc[active] * m + register.astype(np.int64))
            times.append(clock)
            who.append(active)
        cells, times, who = np.concatenate(cells), np.concatenate(times), np.concatenate(who)
        best = np.full(n * m, np.inf)
        np.minimum.at(best, cells, times)
        first = times == best[cells]
        flat = out.reshape(-1)
        flat[cells[first]] = key[who[first]]
        open_ = np.isinf(best.reshape(n, m)[todo]).any(axis=1)
        todo = todo[open_]
        limit[todo] *= 2
    return out


def band_keys(signature):
    """One 64-bit key per band."""
    n = len(signature)
    parts = signature.reshape(n, BANDS, BAND_ROWS)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64) * _GOLD), (n, BANDS)).copy()
    for k in range(BAND_ROWS):
        key = mix(key * np.uint64(0x100000001B3) + parts[:, :, k])
    return key.view(np.int64)


def probability_jaccard(keys_a, counts_a, keys_b, counts_b):
    """Exact similarity of two weighted shingle sets (keys sorted)."""
    if not len(keys_a) or not len(keys_b):
        return 0.0
    union = np.union1d(keys_a, keys_b)
    a, b = np.zeros(len(union)), np.zeros(len(union))
    a[np.searchsorted(union, keys_a)] = counts_a
    b[np.searchsorted(union, keys_b)] = counts_b
    common = (a > 0) & (b > 0)
    if not common.any():
        return 0.0
    if a.max() == 1 and b.max() == 1:
        return float(common.sum()) / len(union)
    ratio = np.divide(a, b, out=np.full(len(union), np.inf), where=b > 0)
    order = np.argsort(-ratio, kind="stable")
    a, b, common = a[order], b[order], common[order]
    upper, lower = np.cumsum(a), b.sum() - np.cumsum(b)
    return float((1.0 / (upper[common] / a[common] + lower[common] / b[common])).sum())


def sketch(text_column):
    """struct<node binary, bands array<long>> of every whole text; null texts and texts without words have no bands."""
    @F.arrow_udf("node binary, bands array<long>")
    def of(text: pa.Array) -> pa.Array:
        nodes, values, sizes = [], [], []
        for lo, hi, data, offsets in column_passes(text):
            words = scan(data, offsets)
            doc, key, weight = shingles(words, hi - lo)
            has = np.bincount(doc, minlength=hi - lo) > 0
            nodes.append(node_keys(words, data, offsets))
            values.append(band_keys(registers(doc, key, weight.astype(float), hi - lo)[has]).reshape(-1))
            sizes.append(has * BANDS)
        cuts = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([*values, np.zeros(0, np.int64)])))
        return pa.StructArray.from_arrays([pa.concat_arrays(nodes) if nodes else pa.array([], pa.binary()), bands], names=["node", "bands"])

    return of(text_column)


def shingle_lists(text_column):
    """struct<node binary, keys array<long>, counts array<int>> of every whole text, keys ascending as unsigned numbers."""
    @F.arrow_udf("node binary, keys array<long>, counts array<int>")
    def of(text: pa.Array) -> pa.Array:
        parts = []
        for lo, hi, data, offsets in column_passes(text):
            words = scan(data, offsets)
            doc, key, count = shingles(words, hi - lo)
            cuts = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32))
            parts.append(pa.StructArray.from_arrays([
                node_keys(words, data, offsets), pa.ListArray.from_arrays(cuts, pa.array(key.view(np.int64))),
                pa.ListArray.from_arrays(cuts, pa.array(count.astype(np.int32)))], names=["node", "keys", "counts"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([
            ("node", pa.binary()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))]))

    return of(text_column)


def _similarities(keys_a: pa.Array, counts_a: pa.Array, keys_b: pa.Array, counts_b: pa.Array) -> pa.Array:
    make_room()

    def parts(keys, counts):
        offsets = keys.offsets.to_numpy()
        return offsets, keys.values.to_numpy().view(np.uint64), counts.values.to_numpy()

    oa, ka, ca = parts(keys_a, counts_a)
    ob, kb, cb = parts(keys_b, counts_b)
    return pa.array([
        probability_jaccard(ka[oa[i]:oa[i + 1]], ca[oa[i]:oa[i + 1]], kb[ob[i]:ob[i + 1]], cb[ob[i]:ob[i + 1]])
        for i in range(len(keys_a))], pa.float64())


def verified(pairs, lists, similarity, *more):
    """The (a, b) pairs whose exact similarity reaches the threshold; ``more`` columns go along."""
    def side(name):
        return lists.select(F.col("node").alias(name), F.col("keys").alias(f"keys_{name}"), F.col("counts").alias(f"counts_{name}"))

    met = pairs.join(side("a"), "a").join(side("b"), "b")
    similarity_of = F.arrow_udf(_similarities, "double")
    return met.where(similarity_of("keys_a", "counts_a", "keys_b", "counts_b") >= similarity).select("a", "b", *more)


def _bound(a, b):
    """Most that the similarity of two nodes can be, from their weights n and the weights u that the other does not have.

    Sets: what both share is at most the rest of either, and either's own shingles add to the union.
    Weights: 1 / (A / a + U_b / b) is concave and grows with the shared weights a and b, so their sums bound the sum.
    """
    def c(side, name):
        return F.col(f"{name}_{side}").cast("double")

    rest_a, rest_b = c(a, "n") - c(a, "u"), c(b, "n") - c(b, "u")
    sets = F.least(rest_a, rest_b) / F.greatest(c(a, "n") + c(b, "u"), c(b, "n") + c(a, "u"))
    weights = 1 / F.greatest(c(a, "n") / rest_a + c(b, "u") / rest_b, c(b, "n") / rest_b + c(a, "u") / rest_a)
    return F.when(F.col(f"plain_{a}") & F.col(f"plain_{b}"), sets).when((rest_a <= 0) | (rest_b <= 0), 0.0).otherwise(weights)


def _both(rows, key, columns):
    """Pairs of rows of one key that hang on different nodes: columns with the endings _a and _b."""
    def side(name):
        return rows.select(key, *[F.col(c).alias(f"{c}_{name}") for c in columns])

    return side("a").join(side("b"), key).where(F.col("top_a") < F.col("top_b"))


def _ends(pairs):
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def _listed_pairs(listed):
    """Pairs of different tops from (keys, node, top) rows of rare shingles, at most RARE nodes to a shingle.

    Shingles with the same nodes are one list, so two texts that share a changed passage make one pair and not
    one for each of its shingles.
    """
    lists = listed.groupBy("keys").agg(F.sort_array(F.collect_list(F.struct("node", "top"))).alias("all")).select("all").distinct()
    pairs = F.flatten(F.transform("all", lambda x, i: F.transform(
        F.filter(F.slice("all", i + 2, RARE), lambda y: y["top"] != x["top"]), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    return lists.select(F.explode(pairs).alias("p")).select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).distinct()


def _crowded_pairs(rest, lists, similarity):
    """Pairs of crowded buckets that may be similar.

    Similar texts share all but a share of (1 - similarity) of either's weight, so the rarest shingle that both
    have comes, in the order of rarity, before more than that share of either text is passed.  Where a node's
    shingles up to there are all rare, its partners are in their lists.  Only a pair of nodes that both reach
    into frequent shingles is left to its buckets, and there its weights must not rule a link out.
    """
    nodes = saved(rest.select("node", "top").distinct(), "crowded")
    mine = saved(lists.join(sent(nodes), "node"), "crowded-lists")
    # a list is much work from few bytes: deal the nodes out before their shingles become rows
    each = mine.repartition("node").select("node", "top", F.explode(F.arrays_zip("keys", "counts")).alias("s")).select("node", "top", "s.keys", "s.counts")
    found = saved(each.groupBy("keys").agg(F.count("*").alias("df"), F.min(F.struct("node", "counts")).alias("only")).where(F.col("df") <= RARE), "rare-keys")
    # a shingle of one node comes first and lists no pair: only its weight counts; those of a few nodes are looked up
    alone = found.where("df = 1").groupBy("only.node").agg(F.sum("only.counts").alias("alone"))
    rare = saved(each.join(found.where("df > 1").select("keys", "df"), "keys").select("keys", "node", "top", "counts", "df"), "rare")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)
    weights = mine.select("node", total.alias("n"), (total == F.size("keys")).alias("plain")).join(alone, "node", "left").join(
        rare.groupBy("node").agg(F.sum("counts").alias("u")), "node", "left").fillna(0, ["alone", "u"])
    weights = saved(weights.withColumn("u", F.col("alone") + F.col("u")).withColumn("most", (1 - similarity) * F.col("n") + 1e-9), "weights")
    passed = Window.partitionBy("node").orderBy("df", "keys").rowsBetween(Window.unboundedPreceding, -1)  # one text's shingles
    first = rare.join(sent(weights.select("node", "alone", "most")), "node").withColumn(
        "passed", F.col("alone") + F.coalesce(F.sum("counts").over(passed), F.lit(0)))
    listed = first.where(F.col("passed") <= F.col("most")).select("keys", "node", "top")
    reaching = weights.where(F.col("u") <= F.col("most")).drop("most", "alone")
    weighed = saved(rest.join(sent(saved(reaching, "reaching")), "node"), "weighed")
    apart = _both(weighed, "band", ["node", "top", "n", "u", "plain"]).where(_bound("a", "b") >= similarity - 1e-9)
    return _listed_pairs(listed).unionByName(_ends(apart))


def node_links(members, lists, similarity):
    """(a, b) links, each verified exactly, that join all similar nodes of every bucket.

    First every member meets the bucket's most connected one.  Buckets whose members then all hang on one
    node are done.  In the others, members that hang on different nodes meet: all of them in small buckets,
    in crowded ones those that may be similar (a family of copies that each changed other words leaves few).
    """
    by_node = Window.partitionBy("node")  # at most BANDS rows
    members = saved(members.withColumn("degree", F.sum("size").over(by_node)).select("band", "node", "degree"), "ranked")
    pivot = members.groupBy("band").agg(F.max_by(F.struct("node", "degree"), F.struct("degree", "node")).alias("p"))
    pivot = saved(pivot.select("band", F.col("p.node").alias("pivot"), F.col("p.degree").alias("pivot_degree")), "pivots")
    met = members.join(sent(pivot), "band").where("node <> pivot").groupBy(
        F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.max("pivot_degree").alias("degree"))
    first = saved(verified(met, lists, similarity, "degree"), "pivot-links")
    # a node hangs on its most connected verified pivot, and on that one's own
    hangs = saved(first.groupBy("a").agg(F.max_by("b", F.struct("degree", "b")).alias("b")), "hangs")
    up = hangs.select(F.col("a").alias("b"), F.col("b").alias("top"))
    hangs = saved(hangs.join(sent(up), "b", "left").select(F.col("a").alias("node"), F.coalesce("top", "b").alias("top")), "tops")
    now = saved(members.select("band", "node").join(sent(hangs), "node", "left").select(
        "band", "node", F.coalesce("top", "node").alias("top")), "placed")
    open_ = saved(now.groupBy("band").agg(F.min("top").alias("low"), F.max("top").alias("high")).where("low <> high").select("band"), "open")
    rest = saved(now.join(sent(open_), "band"), "rest")
    size = saved(rest.groupBy("band").agg(F.count("*").alias("members")), "rest-sizes")
    rest = saved(rest.join(sent(size), "band"), "sized")
    few = _ends(_both(rest.where(F.col("members") <= FEW), "band", ["node", "top"]))
    pairs = few.unionByName(_crowded_pairs(rest.where(F.col("members") > FEW), lists, similarity)).distinct()
    return first.select("a", "b").unionByName(verified(pairs, lists, similarity))


def node_of(text_column):
    """16 bytes of every text: equal for texts of equal words (or characters, without words); null for null."""
    @F.arrow_udf("binary")
    def of(text: pa.Array) -> pa.Array:
        parts = [node_keys(scan(data, offsets), data, offsets) for _, _, data, offsets in column_passes(text)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return F.when(text_column.isNotNull(), of(text_column))


def _classes(sketched, rows, similarity):
    """(node, first, class_id, class_node): the smallest id of a node's class and the node that has it.

    Where no text of a class has an id, the class has the smallest of its nodes.
    """
    whole = sketched.where("node is not null")
    nodes = saved(whole.groupBy("node").agg(F.min("id").alias("first"), F.any_value("bands").alias("bands")), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = saved(banded.groupBy("band").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).where("low <> high").select("band", "size"), "shared")
    members = saved(banded.join(sent(shared), "band").select("band", "node", "size"), "members")
    wanted = saved(nodes.join(members.select("node").distinct(), "node").select("node", "first"), "wanted")
    # a text of each wanted node: by its smallest id, or among the rows without an id
    named = rows.join(sent(wanted.where("first is not null").select(F.col("first").alias("id"), F.col("node").alias("wanted"))), "id").where("body is not null")
    # settled, or the comparison would go below the join and read every text there, in a Python worker more for each task
    lists = settle(named.select("wanted", shingle_lists(F.col("body")).alias("l")), ["l"]).where("wanted = l.node").select("l.*")
    bare = wanted.where("first is null").select("node")
    if not bare.isEmpty():
        unnamed = rows.where("id is null and body is not null").select(node_of(F.col("body")).alias("node"), "body")
        unnamed = settle(unnamed, ["node"]).join(sent(bare), "node")
        one = unnamed.groupBy("node").agg(F.min("body").alias("body"))
        lists = lists.unionByName(one.select(shingle_lists(F.col("body")).alias("l")).select("l.*"))
    lists = saved(lists.dropDuplicates(["node"]), "shingles")
    parts = components(node_links(members, lists, similarity))
    placed = saved(nodes.select("node", "first").join(sent(parts), "node", "left").select(
        "node", "first", F.coalesce("component", "node").alias("component")), "placed-nodes")
    least = placed.groupBy("component").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("least"))
    return saved(placed.join(least, "component").select(
        "node", "first", F.col("least.first").alias("class_id"), F.col("least.node").alias("class_node")), "classes")


def _sketched(rows):
    return saved(rows.select("id", F.when(F.col("body").isNotNull(), sketch(F.col("body"))).alias("s")).select(
        "id", "s.node", "s.bands"), "sketches")


def near_duplicates(docs, id_column="doc_id", text_column="text", similarity=SIMILARITY):
    """(id, class_id, class_node) of every row: the smallest id among all documents that a chain of links joins,
    and in hexadecimal the node that has it, which tells classes without any id apart."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("body"))
    sketched = _sketched(rows)
    classes = _classes(sketched, rows, similarity).select("node", "class_id", F.lower(F.hex("class_node")).alias("class_node"))
    return sketched.select("id", "node").join(sent(classes), "node", "left").select(
        F.col("id").alias(id_column), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), "class_node")


def keep_one(docs, id_column="doc_id", text_column="text", similarity=SIMILARITY):
    """One document of each class, with all columns: the representative's text under its smallest id.

    Rows are told apart by id and text: of rows that repeat an id with different texts each is kept or dropped
    for its own text.  Rows equal in both keep the one whose columns come first in order.  Null texts are never
    copies; rows that repeat an id (or have none) with a null text keep one row an id.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("body"))
    sketched = _sketched(rows)
    kept = _classes(sketched, rows, similarity).where("node = class_node").select(F.col("node").alias("kept_node"), F.col("first").alias("kept_id"))
    has = F.col(text_column).isNotNull()
    parts = [F.struct(*docs.columns).alias("d"), F.col(id_column).alias("id")]
    texts = docs.where(has).select(*parts, node_of(F.col(text_column)).alias("node"))
    copies = F.col("node").eqNullSafe(F.col("kept_node")) & F.col("id").eqNullSafe(F.col("kept_id"))
    found = texts.join(sent(saved(kept, "kept")), copies, "left_semi").unionByName(docs.where(~has).select(*parts, F.lit(None).cast("binary").alias("node")))
    again = saved(sketched.groupBy("id", "node").count().where("count > 1").select(F.col("id").alias("again_id"), F.col("node").alias("again_node")), "repeated")
    if again.isEmpty():
        return found.select("d.*")
    same = F.col("id").eqNullSafe(F.col("again_id")) & F.col("node").eqNullSafe(F.col("again_node"))
    single = found.join(sent(again), same, "left_anti").select("d")
    one = found.join(sent(again), same, "left_semi").groupBy("id", "node").agg(F.min("d").alias("d")).select("d")
    return single.unionByName(one).select("d.*")
