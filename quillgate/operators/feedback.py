"""Send feedback: pending rows, partial results, funnels and patterns."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgate.functions import text as X
from quillgate.functions.stats import rate_pct
from quillgate.operators.rows import ensure_columns, field_update, merge_updates, top_k, upsert

KEYS = ["run_id", "row_id"]
RESULT_FIELDS = [
    "was_opened", "got_reply", "reply_text", "converted", "conversion_type", "conversion_notes",
    "time_to_reply_minutes",
]


def pending_rows(rows, sent_at):
    """Rows with a real line become pending feedback rows."""
    line = X.first_present("final_delivery_line", "opening_line") if "final_delivery_line" in rows.columns else X.clean("opening_line")
    text_cols = [
        "run_id", "row_id", "example_id", "company_name", "recipient_name", "website_url",
        "tailored_insight", "chosen_angle", "friction_type", "conversion_outcome", "surface_checked",
    ]
    df = ensure_columns(rows, [*text_cols, "role"]).withColumn("opening_line", line)
    df = df.filter((F.col("opening_line") != "") & ~F.col("opening_line").startswith("["))
    return df.select(
        *[X.text(c).alias(c) for c in text_cols], X.text("role").alias("recipient_role"), "opening_line",
        *[F.lit(False).alias(c) for c in ("was_opened", "got_reply", "converted")],
        F.lit(sent_at).alias("sent_at"), F.lit(sent_at).alias("created_at"), F.lit(sent_at).alias("updated_at"),
    )


def save(old, new):
    """Insert or update feedback by (run_id, row_id); the creation time is kept."""
    return upsert(old, new, KEYS, "created_at", order=["updated_at"])


def pack_results(results, order="reviewed_at"):
    """(run_id, ident, one struct per field): fields that a result brings, each with its time; the larger struct wins."""
    ident = X.first_present(*[c for c in ("example_id", "row_id") if c in results.columns])
    fields = [c for c in RESULT_FIELDS if c in results.columns]
    return results.withColumn("ident", ident).filter(F.col("ident") != "").select(
        "run_id", "ident", *[field_update(f, order).alias(f) for f in fields])


def fold_results(packed):
    """Packed results of one ident as one row; folding again with later results gives the same as folding all at once."""
    return packed.groupBy("run_id", "ident").agg(*[F.max(c).alias(c) for c in packed.columns if c not in ("run_id", "ident")])


def apply_results(sends, packed):
    """Packed results update only the fields they bring; see ``ingest_results``."""
    rows = sends.select("run_id", F.col("row_id").alias("ident"))
    found = packed.join(rows, ["run_id", "ident"], "left_semi").withColumnRenamed("ident", "row_id")
    if "example_id" in sends.columns:
        ids = sends.filter(X.clean("example_id") != "").select("run_id", F.col("example_id").alias("ident"), "row_id")
        found = found.unionByName(packed.join(ids, ["run_id", "ident"]).drop("ident"))
    fields = [c for c in RESULT_FIELDS if c in found.columns]
    kinds = {f: found.schema[f].dataType["value"].dataType for f in fields}
    base = sends.withColumns({f: F.lit(None).cast(kinds[f]) for f in fields if f not in sends.columns})
    return merge_updates(base, found, KEYS, fields)


def ingest_results(sends, results, order="reviewed_at"):
    """Results update only the fields they bring; a result may name row_id or example_id.

    Results that match nothing are ignored.  Returns the sends with a was_updated flag.
    """
    return apply_results(sends, pack_results(results, order))


def known_results(results, sends, key="row_id"):
    """Results whose id exists."""
    return results.join(sends.select(key), key, "left_semi")


def newest_first(sends, run_id=None):
    """Sends (of one run) with ``newest``, the number to sort by downwards; the sink sorts."""
    rows = sends.filter(F.col("run_id") == run_id) if run_id else sends
    return rows.withColumn("newest", F.struct("updated_at", "run_id", "row_id"))


def latest_run(rows):
    return rows.agg(F.max_by("run_id", F.struct("updated_at", "run_id")).alias("run_id"))


def awaiting(rows):
    """Sends nobody has reported on yet."""
    return rows.filter(~(F.col("was_opened") | F.col("got_reply") | F.col("converted")))


def _counts():
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if("was_opened").alias("opened"),
        F.count_if("got_reply").alias("replied"),
        F.count_if("converted").alias("converted"),
    ]


def funnel_totals(sends):
    """Totals, percentages and mean reply time of all sends."""
    minutes = F.avg(F.when(F.col("time_to_reply_minutes") > 0, F.col("time_to_reply_minutes")))
    df = sends.agg(*_counts(), F.coalesce(F.bround(minutes, 0).cast("bigint"), F.lit(0).cast("bigint")).alias("avg_reply_time_minutes"))
    return df.select(
        F.col("total").alias("total_sends"), "opened", "replied", "converted",
        rate_pct(F.col("opened"), F.col("total")).alias("open_rate"),
        rate_pct(F.col("replied"), F.col("total")).alias("reply_rate"),
        rate_pct(F.col("converted"), F.col("total")).alias("conversion_rate"),
        "avg_reply_time_minutes",
    )


def _by(sends, key):
    df = sends.groupBy(key).agg(*_counts())
    return df.withColumn("conversion_rate", rate_pct(F.col("converted"), F.col("total"))).orderBy(
        F.desc("converted"), key)


def funnel_by_friction(sends):
    return _by(sends.filter(X.text("friction_type") != ""), "friction_type")


def angle_category(c="chosen_angle"):
    """Text before the first colon; blank without a colon."""
    return F.when(F.instr(c, ":") > 0, F.substring_index(c, ":", 1)).otherwise("")


def funnel_by_angle(sends):
    rows = sends.filter(X.text("chosen_angle") != "").withColumn("angle_category", angle_category())
    return _by(rows, "angle_category")


PATTERN = ["chosen_angle", "friction_type", "surface_checked"]


def _patterns(sends):
    rows = sends.filter(X.text("chosen_angle") != "")
    return rows.groupBy(*PATTERN).agg(
        F.min("conversion_outcome").alias("conversion_outcome"),
        F.count(F.lit(1)).alias("times_used"),
        F.count_if("converted").alias("conversions"),
        F.count_if("got_reply").alias("replies"),
        F.count_if("was_opened").alias("opens"),
    ).withColumn("conv_rate", rate_pct(F.col("conversions"), F.col("times_used"), half_even=False))


def pattern_lines(sends):
    """Every distinct opening line of every pattern, as rows."""
    rows = sends.filter(X.text("chosen_angle") != "")
    return rows.groupBy(*PATTERN, "opening_line").agg(F.count(F.lit(1)).alias("times_used"))


def success_patterns(sends, limit=20, examples=2, sep="|"):
    """Best converting patterns with their first example lines, joined by ``sep`` or as an array without one.

    The complete line list of a pattern stays in ``pattern_lines``; the report carries the
    number of distinct lines and the first few.
    """
    top = _patterns(sends).orderBy(F.desc("conversions"), F.desc("conv_rate"), *PATTERN).limit(limit)
    lines = pattern_lines(sends.join(F.broadcast(top.select(*PATTERN)), PATTERN, "left_semi"))  # at most ``limit`` patterns
    n = lines.groupBy(*PATTERN).agg(F.count(F.lit(1)).alias("example_lines"))
    first = top_k(lines, PATTERN, [F.col("opening_line")], examples)
    shown = F.sort_array(F.collect_list("opening_line"))
    shown = first.groupBy(*PATTERN).agg((F.array_join(shown, sep) if sep else shown).alias("examples"))
    return top.join(n, PATTERN, "left").join(shown, PATTERN, "left")


def failing_patterns(sends, limit=20):
    """Patterns used at least twice that never converted."""
    rows = _patterns(sends).filter((F.col("times_used") >= 2) & (F.col("conversions") == 0))
    return rows.select(*PATTERN, "times_used", "conversions", "conv_rate").orderBy(
        F.desc("times_used"), *PATTERN).limit(limit)


def feedback_context(sends, limit=20):
    """One text block for prompt rendering, built from the small aggregates only."""
    total = funnel_totals(sends)
    best, worst = success_patterns(sends, limit, sep=None), failing_patterns(sends, limit)
    num = lambda c: F.col(c).cast("string")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))

    def ranked(df, *order):
        # the inputs hold at most ``limit`` rows or one row per category
        return top_k(df.withColumn("__all", F.lit(1)), ["__all"], list(order), 5, "pos").drop("__all")

    def lines(df, section, text):
        return df.select(F.lit(section).alias("section"), F.col("pos").cast("int").alias("pos"), text.alias("line"))

    overview = total.filter("total_sends > 0").select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.concat(F.lit(f"  {label}: "), num(c), F.lit(unit)).alias("line"))
        for i, (label, c, unit) in enumerate([
            ("Total sends", "total_sends", ""), ("Open rate", "open_rate", "%"),
            ("Reply rate", "reply_rate", "%"), ("Conversion rate", "conversion_rate", "%"),
            ("Average reply time", "avg_reply_time_minutes", " min")])
    ])).alias("x")).select(F.lit(1).alias("section"), "x.pos", "x.line")
    top5 = ranked(best, F.desc("conversions"), F.desc("conv_rate"), *PATTERN)
    example = F.transform(
        F.filter("examples", lambda e: X.strip(e) != ""),
        lambda e: F.concat(F.lit('      Ex: "'), F.left(X.strip(e), F.lit(100)), F.lit('"')))
    works = lines(top5, 2, F.concat_ws("\n", F.concat(
        F.lit("  - Angle "), quote(F.col("chosen_angle")), F.lit(": "), num("conv_rate"),
        F.lit("% conv rate ("), num("times_used"), F.lit(" sends)")), F.array_join(example, "\n")))
    bad5 = ranked(worst, F.desc("times_used"), *PATTERN)
    fails = lines(bad5, 3, F.concat(
        F.lit("  - Angle "), quote(F.col("chosen_angle")), F.lit(" ("), num("times_used"),
        F.lit(" sends, 0 conversions — avoid this angle)")))

    def by_category(df, section, c):
        return lines(ranked(df, F.desc("converted"), F.col(c)), section, F.concat(
            F.lit("  - "), c, F.lit(": "), num("conversion_rate"), F.lit("% conv rate ("), num("total"), F.lit(" sends)")))

    top1 = top5.filter("pos = 1").select(F.explode(X.array_of(*[
        F.when(F.col(c) != "", F.concat(F.lit(f"  - Best performing {name}: "), quote(F.col(c))))
        for name, c in [("angle historically", "chosen_angle"), ("friction type", "friction_type"), ("surface", "surface_checked")]
    ])).alias("line")).select(F.lit(6).alias("section"), F.when(F.col("line").contains("angle"), 1).when(
        F.col("line").contains("friction type"), 2).otherwise(3).alias("pos"), "line")
    avoid = bad5.filter("pos <= 3").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "chosen_angle"))), lambda x: x["chosen_angle"]), ", ").alias("a"))
    avoid = avoid.filter(F.col("a") != "").select(F.lit(6).alias("section"), F.lit(9).alias("pos"), F.concat(
        F.lit("  - Avoid these angles (0% conversion): "), "a").alias("line"))
    body = overview.unionByName(works).unionByName(fails).unionByName(
        by_category(funnel_by_friction(sends), 4, "friction_type")).unionByName(
        by_category(funnel_by_angle(sends), 5, "angle_category")).unionByName(top1).unionByName(avoid)
    heads = [
        "OVERVIEW:", "WHAT WORKS (high-converting patterns):",
        "WHAT DOES NOT WORK (patterns with 0 conversions):", "CONVERSION BY FRICTION TYPE:",
        "CONVERSION BY ANGLE CATEGORY:", "GUIDANCE:",
    ]
    blocks = body.groupBy("section").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    title = F.element_at(X.lits(heads), F.col("section"))
    blocks = blocks.withColumn("text", F.concat(title, F.lit("\n"), "text", F.lit("\n")))
    whole = blocks.agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), "\n").alias("t"))
    text = F.concat(F.lit("\n--- FEEDBACK FROM PREVIOUS SENDS ---\n\n"), "t")
    return whole.select(F.when(F.coalesce("t", F.lit("")) == "", "").otherwise(text).alias("feedback_context"))
