"""Running values over a total order as a tree of carries: no window ever spans the whole order.

The order is a whole number.  Its low ``BLOCK_BITS`` bits are a place inside a block of rows; the bits above
name the block, its parent, and so on, ``FAN_BITS`` bits a level up to one root.  Totals are summed level by
level on the way up; on the way down every level adds what the siblings before it hold.  A window sees the
rows of one block or the children of one parent, so a task never has more than 2 ** BLOCK_BITS rows or
2 ** FAN_BITS totals of a group together, whether the numbers are dense or far apart.
"""

import tempfile

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgate.functions.text import col

BLOCK_BITS, FAN_BITS = 16, 12
#: Levels of blocks: 16 + 4 * 12 bits are those of a long.
LEVELS = 4


def _matched(left, right, keys, on, how="inner"):
    """Join on null-safe keys and a number; key columns of the right side are named with the ending ``__r``."""
    cond = F.col(on).eqNullSafe(F.col(f"{on}__r"))
    for k in keys:
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(f"`{k}__r`"))
    renamed = right.withColumnsRenamed({c: f"{c}__r" for c in [*keys, on]})
    return left.join(renamed, cond, how).drop(*[f"{c}__r" for c in [*keys, on]])


def running(df, order="row_idx", sums=None, lasts=None, keys=()):
    """Running sums and last non-null values (name -> column), up to and with each row, per ``keys``.

    ``order`` is a column of unique whole numbers, dense or not, also negative.  Rows that share a number are
    summed in any order among themselves; rows without a number come first, in one block.  Null values add
    nothing.  A column that has the name of a result is replaced.
    """
    sums, lasts, keys = sums or {}, lasts or {}, list(keys)
    names = [*sums, *lasts]
    number = {n: i for i, n in enumerate(names)}

    def total(n):
        return F.col(f"__total_{number[n]}")

    def carry(n):
        return F.col(f"__carry_{number[n]}")

    def added(n, before, own):
        return F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0)) if n in sums else F.coalesce(own, before)

    def whole(n, value, place):
        one = F.sum(value) if n in sums else F.max_by(value, F.when(value.isNotNull(), F.coalesce(place, F.lit(-(1 << 63)))))
        return one.alias(f"__total_{number[n]}")

    def scanned(n, value, window):
        return F.sum(value).over(window) if n in sums else F.last(value, ignorenulls=True).over(window)

    block = F.coalesce(F.shiftright(F.col(order).cast("long"), BLOCK_BITS) + F.lit(1 << 63 - BLOCK_BITS), F.lit(0).cast("long"))
    tagged = df.withColumns({"__block": block, **{
        f"__value_{number[n]}": col(c) for n, c in {**sums, **lasts}.items()}})
    levels = [tagged.groupBy(*keys, "__block").agg(*[whole(n, F.col(f"__value_{number[n]}"), F.col(order)) for n in names])]
    parent = F.shiftright("__block", FAN_BITS)
    for _ in range(LEVELS - 1):
        up = levels[-1].withColumn("__parent", parent).groupBy(*keys, "__parent").agg(*[whole(n, total(n), F.col("__block")) for n in names])
        levels.append(up.withColumnRenamed("__parent", "__block"))
    carries = None
    for level in reversed(levels):
        before = W.partitionBy(*keys, "__parent").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
        placed = level.withColumn("__parent", parent).select(
            *keys, "__block", "__parent", *[scanned(n, total(n), before).alias(f"__own_{number[n]}") for n in names])
        if carries is not None:
            above = carries.withColumnsRenamed({"__block": "__parent"})
            placed = _matched(placed, above, keys, "__parent")
        carries = placed.select(*keys, "__block", *[
            (F.col(f"__own_{number[n]}") if carries is None else added(n, carry(n), F.col(f"__own_{number[n]}"))).alias(f"__carry_{number[n]}")
            for n in names])
    inside = W.partitionBy(*keys, "__block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    met = _matched(tagged, carries, keys, "__block")
    out = met.withColumns({n: added(n, carry(n), scanned(n, F.col(f"__value_{number[n]}"), inside)) for n in names})
    return out.drop("__block", *[f"__{part}_{i}" for part in ("value", "carry") for i in number.values()])


def stored(df):
    """The table cut off from its lineage: written to the folder in spark.checkpoint.dir.

    A folder of its own is made only in one-machine sessions that name none, as in tests.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillgate-"))
    return df.checkpoint()


def numbered(df, *order, name="__number"):
    """A unique whole number of every row in any order, with gaps, for ``running``.

    Rows are sorted in ranges, each numbers its own rows from a start of its own; the table is stored, so that
    every later reader sees the same ranges.
    """
    return stored(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))
