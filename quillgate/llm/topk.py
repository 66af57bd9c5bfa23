"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

Vectors become integers floor(scale * x).  Shards of bounded size hold a ball tree each; blocks of
queries meet every shard.  A first pass goes down each shard to its most promising leaf; the k-th best
score over all shards goes along with the second pass, which goes down to the nodes whose upper bound
q . centre + |q| * radius reaches that score, visits their leaves in order of the bound and stops where
it falls below the current k-th score.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do null
ids; a row that repeats an id and its vector counts once; candidates with the query's own id are left
out; only vectors of the query's length are candidates; ties go to the smaller id; components and scores
beyond 64 bits are the largest or smallest long; empty tables give no rows.  Only the two named columns
are read, so other columns cannot clash.
"""

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgate.llm.store import saved

SHARD_ROWS = 16_384
BLOCK_ROWS = 1_024
LEAF_ROWS = 128
#: Blocks that meet a shard in one task.
TASK_BLOCKS = 64
#: Products and sums below these are exact in doubles, and in 64-bit integers.
EXACT, WHOLE = 2.0 ** 53, 2.0 ** 62


def clean(vectors, id_column, vector_column, scale):
    """(id, v array<long>) of the vectors that take part, each once."""
    x = F.transform(F.col(vector_column), lambda c: c.cast("double"))
    whole = F.col(vector_column).isNotNull() & F.col(id_column).isNotNull() & F.forall(
        F.col(vector_column), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(whole).select(
        F.col(id_column).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")).distinct()


def ball_tree(ids, vectors, k):
    """Nodes in preorder; equal vectors keep only the ids that can be among the k best."""
    order = np.lexsort((ids, *vectors.T)) if vectors.shape[1] else np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
    again = np.zeros(len(ids), bool)
    again[1:] = ~fresh[1:] & (ids[1:] == ids[:-1])
    ids, vectors, fresh = ids[~again], vectors[~again], fresh[~again]
    group = np.cumsum(fresh) - 1
    nth = np.arange(len(ids)) - np.flatnonzero(fresh)[group]
    ids, vectors = ids[nth <= k], vectors[nth <= k]
    points = vectors.astype(float)
    perm, nodes = np.arange(len(ids)), []

    def split(lo, hi, parent):
        part = points[perm[lo:hi]]
        centre = part.mean(axis=0)
        away = ((part - centre) ** 2).sum(axis=1)
        me = len(nodes)
        nodes.append([centre, np.sqrt(away.max()), lo, hi, parent, True, -1])
        if hi - lo > LEAF_ROWS and away.max() > 0:
            one = part[away.argmax()]
            other = part[((part - one) ** 2).sum(axis=1).argmax()]
            side = part @ (other - one)
            perm[lo:hi] = perm[lo:hi][np.argsort(side, kind="stable")]
            nodes[me][5] = False
            middle = (lo + hi) // 2
            split(lo, middle, me)
            nodes[me][6] = len(nodes)
            split(middle, hi, me)

    split(0, len(ids), -1)
    centre, radius, lo, hi, parent, leaf, right = zip(*nodes)
    return {"ids": ids[perm], "vectors": vectors[perm], "centre": np.array(centre), "radius": np.array(radius),
            "lo": np.array(lo), "hi": np.array(hi), "parent": np.array(parent), "leaf": np.array(leaf), "right": np.array(right)}


def products(queries, vectors):
    """Exact integer inner products; those beyond 64 bits are the largest or smallest long."""
    largest = lambda x: float(np.abs(x.astype(float)).max(initial=0))
    most = largest(queries) * largest(vectors) * max(queries.shape[1], 1)
    if most < EXACT:
        return (queries.astype(float) @ vectors.T.astype(float)).astype(np.int64)
    if most < WHOLE:
        return queries @ vectors.T
    ends = np.iinfo(np.int64)
    exact = queries.astype(object) @ vectors.T.astype(object)
    return np.clip(exact, int(ends.min), int(ends.max)).astype(np.int64)


def best_of(rows, ids, scores, n, k):
    """(row, id, score) of the k best of each row: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    again = np.zeros(len(rows), bool)
    again[1:] = (rows[1:] == rows[:-1]) & (ids[1:] == ids[:-1]) & (scores[1:] == scores[:-1])
    rows, ids, scores = rows[~again], ids[~again], scores[~again]
    nth = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n))[rows]
    return rows[nth < k], ids[nth < k], scores[nth < k]


def search(tree, query_ids, queries, floor, k, probe=False):
    """Best candidates of one shard for a block of queries; ``floor`` is each query's k-th score so far.

    With ``probe`` only the leaf that the better bounds lead to is looked into.
    """
    n = len(queries)
    as_float = queries.astype(float)
    norm = np.linalg.norm(as_float, axis=1)
    size = np.linalg.norm(tree["centre"], axis=1) + tree["radius"]

    def bound(mine, node):
        """Upper bound of some queries' scores inside a node; rounding never hides a node."""
        return as_float[mine] @ tree["centre"][node] + norm[mine] * tree["radius"][node] + 1e-11 * norm[mine] * size[node] + 1e-3

    kth = floor.copy()
    if probe:
        leaf, top = np.zeros(n, np.int64), np.full(n, np.inf)
        while not tree["leaf"][leaf].all():
            for node in np.unique(leaf[~tree["leaf"][leaf]]):
                mine = np.flatnonzero(leaf == node)
                left, right = bound(mine, node + 1), bound(mine, tree["right"][node])
                leaf[mine] = np.where(left >= right, node + 1, tree["right"][node])
                top[mine] = np.maximum(left, right)
        visits = [(np.arange(n), leaf, top)]
    else:
        reached, visits = {-1: np.arange(n)}, []
        for node in range(len(tree["parent"])):  # parents come first
            mine = reached.get(tree["parent"][node], np.zeros(0, np.int64))
            if not len(mine):
                continue
            top = bound(mine, node)
            open_ = top >= kth[mine]
            if tree["leaf"][node]:
                visits.append((mine[open_], np.full(int(open_.sum()), node), top[open_]))
            else:
                reached[node] = mine[open_]
    who, leaf, top = (np.concatenate(x) for x in zip(*visits)) if visits else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((-top, who))
    who, leaf, top = who[order], leaf[order], top[order]
    turn = np.arange(len(who)) - np.searchsorted(who, who)
    rows, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for step in range(int(turn.max()) + 1 if len(turn) else 0):
        now = np.flatnonzero(turn == step)
        now = now[top[now] >= kth[who[now]]]
        if not len(now):
            break  # bounds only fall from here
        new = [(rows, ids, scores)]
        for node in np.unique(leaf[now]):
            mine = who[now[leaf[now] == node]]
            inside = slice(tree["lo"][node], tree["hi"][node])
            score = products(queries[mine], tree["vectors"][inside])
            good = (score >= kth[mine][:, None]) & (tree["ids"][inside][None, :] != query_ids[mine][:, None])
            r, c = np.nonzero(good)
            new.append((mine[r], tree["ids"][inside][c], score[r, c]))
        rows, ids, scores = best_of(*(np.concatenate(x) for x in zip(*new)), n, k)
        full = np.bincount(rows, minlength=n) >= k
        last = np.searchsorted(rows, np.arange(n), side="right") - 1
        kth[full] = np.maximum(kth[full], scores[last[full]].astype(float))
    return rows, ids, scores


def _blobs(table, key, make):
    """One row per (length, key) group of bounded size: its pickled arrays."""
    def pack(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        flat = group.column("v").combine_chunks().flatten().to_numpy()
        width = group.column("width")[0].as_py()
        blob = pickle.dumps(make(ids, flat.reshape(len(ids), width)), protocol=5)
        return pa.table({"width": pa.array([width], pa.int32()), key: pa.array([group.column(key)[0].as_py()], pa.int32()),
                         "blob": pa.array([blob], pa.binary())})

    return table.groupBy("width", key).applyInArrow(pack, f"width int, {key} int, blob binary")


def _searched(met, k, probe):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tree, (ids, queries) = pickle.loads(row["tree"]), pickle.loads(row["queries"])
                floor = np.full(len(ids), -np.inf)
                for known in row.get("floors") or []:
                    floor[known["place"]] = known["score"]
                rows, found, scores = search(tree, ids, queries, floor, k, probe)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), row["width"], np.int32)), pa.array(np.full(len(rows), row["block"], np.int32)),
                    pa.array(rows.astype(np.int32)), pa.array(ids[rows]), pa.array(found), pa.array(scores)],
                    ["width", "block", "place", "query_id", "vec_id", "score"])

    return met.mapInArrow(run, "width int, block int, place int, query_id long, vec_id long, score long")


def _parts(n, size):
    return max(1, -(-n // size))


def top_k(vectors, queries, k=5, id_column="vec_id", vector_column="embedding", scale=256):
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query row."""
    def keyed(rows, key, size):
        rows = saved(clean(rows, id_column, vector_column, scale), key)
        count = rows.count()
        return rows.select(
            "id", "v", F.size("v").alias("width"), F.pmod(F.xxhash64("id"), F.lit(_parts(count, size))).cast("int").alias(key)), count

    rows, count = keyed(vectors, "shard", SHARD_ROWS)
    asked, asks = keyed(queries, "block", BLOCK_ROWS)
    trees = saved(_blobs(rows, "shard", lambda ids, v: ball_tree(ids, v, k)).withColumnRenamed("blob", "tree"), "trees")
    blocks = saved(_blobs(asked, "block", lambda ids, v: (ids, v)).withColumnRenamed("blob", "queries"), "query-blocks")
    shards = F.explode(F.sequence(F.lit(0), F.lit(_parts(count, SHARD_ROWS) - 1))).alias("shard")
    # a shard meets its blocks in tasks of TASK_BLOCKS each, after one shuffle
    groups = F.explode(F.sequence(F.lit(0), F.lit((_parts(asks, BLOCK_ROWS) - 1) // TASK_BLOCKS))).alias("group")

    def meet(side):
        spread = side.select("*", F.floor(F.col("block") / TASK_BLOCKS).cast("int").alias("group"), shards)
        return spread.join(trees.select("*", groups), ["width", "shard", "group"])

    first = _searched(meet(blocks), k, True)
    best = F.row_number().over(Window.partitionBy("width", "block", "place").orderBy(F.desc("score"), "vec_id"))
    floors = first.withColumn("nth", best).where(F.col("nth") == k).groupBy("width", "block").agg(
        F.collect_list(F.struct("place", "score")).alias("floors"))  # one entry per query of a block
    floors = saved(floors, "floors")
    second = _searched(meet(blocks.join(floors, ["width", "block"], "left")), k, False)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return second.select("query_id", "vec_id", "score").distinct().withColumn("rank", F.row_number().over(by_query)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
