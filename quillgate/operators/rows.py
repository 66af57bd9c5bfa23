"""Row-level plumbing shared by the operators: columns, order, skew and upserts."""

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgate.functions.text import blank_to_null, col
from quillgate.operators.order import numbered, running


def ensure_columns(df, columns, default=""):
    """Add the columns that are missing; ``columns`` is a list or a name -> default dict."""
    wanted = columns if isinstance(columns, dict) else {c: default for c in columns}
    missing = {c: F.lit(d) for c, d in wanted.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def settle(df, columns):
    """Fix the values of derived columns at this point of the plan.

    Filters and projections further up would otherwise be rewritten into the expressions
    behind these columns, repeating them at every reference.  A one-row generator is a
    boundary for that rewriting and stays inside generated code.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    packed = F.struct(*[F.col(f"`{c}`").alias(c) for c in columns])
    return df.select(*rest, F.inline(F.array(packed)))


def with_row_index(df, name="row_idx"):
    """Number the rows of a file scan in file order, starting at 0.

    Positions inside a file split come from the scan itself; only one row per split is
    aggregated to turn them into global positions, so nothing else is sorted and nothing collected.
    """
    keyed = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__mid"),
    )
    splits = keyed.groupBy("__file", "__block").agg(
        F.min("__mid").alias("__first"), F.count(F.lit(1)).alias("__n")
    ).withColumnRenamed("__block", "__start")
    placed = running(numbered(splits, "__file", "__start"), "__number", sums={"__end": "__n"})
    offsets = placed.select("__file", F.col("__start").alias("__block"), "__first", (F.col("__end") - F.col("__n")).alias("__offset"))
    return (
        keyed.join(offsets, ["__file", "__block"])
        .withColumn(name, F.col("__offset") + F.col("__mid") - F.col("__first"))
        .drop("__file", "__block", "__mid", "__first", "__offset")
    )


def fill_down(df, columns, order="row_idx"):
    """Carry the last non-blank value of each column down over blanks, in the order of a unique number."""
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    filled = running(df, order, lasts={f"__filled_{i}": F.nullif(F.col(c), F.lit("")) for i, c in enumerate(columns)})
    return filled.withColumns({c: F.coalesce(f"__filled_{i}", F.lit("")) for i, c in enumerate(columns)}).drop(
        *[f"__filled_{i}" for i in range(len(columns))])


def first_per_key(df, keys, order, columns=None):
    """One row per key, the one with the smallest order value (partial aggregation first)."""
    columns = columns or [c for c in df.columns if c not in keys]
    order = [col(o) for o in (order if isinstance(order, (list, tuple)) else [order])]
    best = F.min_by(F.struct(*columns), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.`{c}`").alias(c) for c in columns])


def last_per_key(df, keys, order, columns=None):
    """One row per key, the one with the largest order value (keep-last dedupe)."""
    columns = columns or [c for c in df.columns if c not in keys]
    order = [col(o) for o in (order if isinstance(order, (list, tuple)) else [order])]
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.`{c}`").alias(c) for c in columns])


def top_k(df, keys, order, k, rank="rank"):
    """First k rows per key, or all rows with their rank where k is None.  Spark limits each group before the
    shuffle, so a huge group sends at most k rows per input task."""
    window = W.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def rank_in_order(df, key, order, rank="rank"):
    """Rank of every row in its key by a unique number, nulls first; no row is left out, and a hot key never meets in one task."""
    return running(df, order, sums={rank: F.lit(1)}, keys=[key])


def lookup_join(facts, dim, keys, how="left"):
    """Join a large table to a lookup with one row per key.

    Nothing is copied beforehand: adaptive execution (on in ``session``) sends small lookups to every task
    and splits the partition of a hot key, repeating the lookup rows of that partition alone.
    """
    return facts.join(dim, keys, how)


def upsert(old, new, keys, created="created_at", order=None):
    """Insert or update by key: the newest row wins and keeps the first creation time.

    Repeats inside ``new`` are settled by ``order`` (columns of ``new``); one aggregation
    covers old and new rows, there is no join.
    """
    order = order or []
    old_rows = old.withColumn("__age", F.lit(0))
    new_rows = new.withColumn("__age", F.lit(1))
    both = old_rows.unionByName(new_rows, allowMissingColumns=True)
    values = [c for c in both.columns if c not in keys and c not in ("__age", created)]
    rank = F.struct("__age", *order)
    aggs = [F.max_by(F.struct(*values), rank).alias("__row")]
    if created in both.columns:
        aggs.append(
            F.expr(f"min_by(`{created}`, __age) filter (where `{created}` is not null)").alias(created)
        )
    merged = both.groupBy(*keys).agg(*aggs)
    picked = {c: F.col(f"__row.`{c}`") for c in values}
    merged = merged.withColumns(picked).drop("__row")
    return merged.select(*[c for c in both.columns if c != "__age"])


def field_update(field, order):
    """A non-null field as a struct with its order value; the larger struct is the later update.

    Updates without an order value come before all others; at equal order the larger value wins.
    """
    return F.when(F.col(field).isNotNull(), F.struct(
        F.col(order).isNotNull().alias("timed"), F.col(order).alias("at"), F.col(field).alias("value")))


def merge_updates(base, updates, keys, fields):
    """Partial update: per field the latest of the ``field_update`` structs in ``updates`` replaces the base.

    Rows of ``updates`` without a partner in ``base`` are ignored.
    """
    latest = updates.groupBy(*keys).agg(*[F.max(f).alias(f"__{f}") for f in fields], F.count(F.lit(1)).alias("__updates"))
    joined = base.join(latest, keys, "left").withColumns(
        {f: F.coalesce(F.col(f"__{f}.value"), F.col(f)) for f in fields})
    return joined.withColumn("was_updated", F.col("__updates").isNotNull()).drop("__updates", *[f"__{f}" for f in fields])


def merge_fields(base, updates, keys, fields, order):
    """Partial update: per field the latest non-null value in ``updates`` replaces the base."""
    return merge_updates(base, updates.withColumns({f: field_update(f, order) for f in fields}), keys, fields)


def resume_split(todo, done, key="row_idx"):
    """(rows already finished, rows still to process)."""
    return done, todo.join(done.select(key), key, "left_anti")


def attach_scalar(df, scalars):
    """Put the columns of a one-row aggregate beside every row.

    The aggregate becomes a scalar subquery: it runs once and enters the projection as a
    constant, so there is no join.
    """
    packed = scalars.select(F.struct(*scalars.columns).alias("s")).scalar()
    out = df.withColumn("__scalar", packed)
    return out.withColumns({c: F.col(f"__scalar.`{c}`") for c in scalars.columns}).drop("__scalar")


def append_rows(*dfs):
    """Union by column name; columns missing on one side become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def with_generated_ids(df, name="row_id", order="row_idx"):
    """Fill blank row ids with the one-based position."""
    current = blank_to_null(name) if name in df.columns else F.lit(None).cast("string")
    return df.withColumn(name, F.coalesce(current, (F.col(order) + 1).cast("string")))


def append_with_ids(main, extra, order, name="row_id"):
    """Follow-up rows go after the main rows and continue their numbering without gaps, in ``order`` (a unique number)."""
    count = main.agg(F.count(F.lit(1)).alias("__base"))
    placed = running(extra, order, sums={"__place": F.lit(1)})
    numbered = attach_scalar(placed, count).withColumn(
        name, (F.col("__base") + F.col("__place")).cast("string")
    ).drop("__base", "__place")
    return append_rows(main, numbered)
