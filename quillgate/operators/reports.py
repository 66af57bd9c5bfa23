"""Batch reports: summary metrics, top labels, dashboard numbers, cost, usage."""

from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import text as X
from quillgate.functions.stats import rate_pct
from quillgate.operators.rows import ensure_columns, top_k


def _generated():
    line = X.clean("personalized_line")
    return (line != "") & ~line.startswith("[")


def batch_summary(review, source=None):
    """Twenty summary metrics as (position, metric, value) rows.

    Names (tone profile, model) are made distinct by an aggregation of their own first, so
    only the distinct names are joined to text; they come from ``source``, the rows before the gate, if given.
    """
    df = ensure_columns(review, [
        "status", "sendability_decision", "surface_correctness", "source_urls", "visual_confidence",
        "app_check_status", "tone_profile", "model_name", "needs_manual_review", "company"])
    visual = F.lower(X.text("visual_confidence"))
    company = F.lower(X.clean("company"))
    counts = [
        ("Total contact rows", F.count(F.lit(1))),
        ("Unique companies", F.count_distinct(F.when(X.text("company") != "", company))),
        ("Rows with personalized line", F.count_if(_generated())),
        ("Rows ready to send", F.count_if(F.col("status") == "Ready")),
        *[(f"Sendability: {d}", F.count_if(F.col("sendability_decision") == d)) for d in ("Send", "Edit", "Reject")],
        *[(f"Surface correctness: {d}", F.count_if(F.col("surface_correctness") == d)) for d in ("Correct", "Review", "Wrong")],
        ("Rows needing review", F.count_if(X.loose_bool("needs_manual_review"))),
        ("Research-only rows", F.count_if(F.col("status") == "Research only")),
        ("Rows with source URLs", F.count_if(X.clean("source_urls") != "")),
        *[(f"{d.title()} visual-confidence rows", F.count_if(visual == d)) for d in ("high", "medium", "low")],
        ("Rows where app walkthrough is recommended", F.count_if(F.lower(X.text("app_check_status")).contains("recommended"))),
    ]
    row = df.agg(*[c.alias(f"m{i}") for i, (_, c) in enumerate(counts)])

    def names(column):
        distinct = (df if source is None else ensure_columns(source, [column])).select(X.clean(column).alias("n")).filter(F.col("n") != "").distinct()
        joined = F.array_join(F.sort_array(F.collect_list("n")), ", ")
        return distinct.agg(F.when(joined == "", "not set").otherwise(joined).alias("v")).scalar()

    items = [(name, F.col(f"m{i}").cast("string")) for i, (name, _) in enumerate(counts)]
    items += [("Tone profile", F.col("tone")), ("Model", F.col("model")), ("How to use", F.lit(
        "Start in the Review tab. Edit personalized_line if needed, then check Research Details for longer evidence."))]
    row = row.withColumns({"tone": names("tone_profile"), "model": names("model_name")})
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("metric"), v.alias("value")) for i, (n, v) in enumerate(items)
    ])).alias("x")).select("x.*")


def top_counts(df, column, limit=8, split=False, order="row_idx"):
    """Most frequent labels; ties go to the label seen first."""
    if split:
        items = F.posexplode(X.split_list(column, "\n;|"))
        rows = df.select(order, items.alias("pos", "label"))
    else:
        rows = df.select(order, F.lit(0).alias("pos"), X.clean(column).alias("label")).filter(F.col("label") != "")
    counts = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.struct(order, "pos")).alias("first"))
    return counts.orderBy(F.desc("rows"), "first").limit(limit).select("label", "rows")


def mean_positive(columns_of):
    """Mean of the positive parseable numbers of a column, rounded, zero without any."""
    value = columns_of.try_cast("double")
    return F.coalesce(F.bround(F.avg(F.when(value > 0, value)), 1), F.lit(0.0))


def dashboard(review):
    """Key numbers of a batch in one row."""
    df = ensure_columns(review, ["personalization_quality_score", "company", "source_urls"])
    total = F.count(F.lit(1))
    visual = F.when(X.text("visual_confidence") == "", "none").otherwise(F.lower("visual_confidence"))
    classes = ["high", "medium", "low", "none"]
    row = df.agg(
        total.alias("rows"),
        F.count_distinct(F.when(X.text("company") != "", F.lower(X.clean("company")))).alias("unique_companies"),
        *[F.count_if(F.col("status") == s).alias(n) for s, n in [("Ready", "ready"), ("Review", "review"), ("Research only", "research_only")]],
        *[F.count_if(F.col("sendability_decision") == d).alias(d.lower()) for d in ("Send", "Edit", "Reject")],
        F.count_if(_generated()).alias("generated"),
        F.count_if(X.clean("source_urls") != "").alias("with_sources"),
        mean_positive(F.col("evidence_score")).alias("avg_evidence"),
        mean_positive(F.col("surface_correctness_score")).alias("avg_surface"),
        mean_positive(F.col("personalization_quality_score")).alias("avg_quality"),
        rate_pct(F.count_if(F.col("status") == "Ready"), total, 0).alias("ready_rate"),
        *[F.count_if(visual == c).alias(f"__{c}") for c in classes],
    )
    # most common class; ties go to the stronger one
    best = F.greatest(*[F.struct(F.col(f"__{c}").alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, c in enumerate(classes)])
    return row.withColumn("strongest_visual", best["c"]).drop(*[f"__{c}" for c in classes])


def ordered_status_counts(review):
    """Rows per status in the fixed status order."""
    rank = X.lookup("status", {"Ready": 0, "Review": 1, "Research only": 2}, 9)
    counts = review.filter(X.text("status") != "").groupBy("status").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("position", rank).orderBy("position", "status")


def strongest_class(df, column, classes):
    """Most common of the listed classes, fixed order on ties."""
    value = F.when(X.text(column) == "", F.lit("none")).otherwise(F.lower(column))
    counts = df.agg(*[F.count_if(value == c).alias(c) for c in classes])
    best = F.greatest(*[F.struct(F.col(c).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, c in enumerate(classes)])
    return counts.select(best["c"].alias("class"), best["n"].alias("rows"))


def price_columns(model="model_name"):
    """Input and output price per million tokens of a model, default for unknown ones."""
    name = F.lower(X.clean(model))
    return (
        X.lookup(name, {k: v[0] for k, v in T.MODEL_PRICES.items()}, T.DEFAULT_PRICE[0]),
        X.lookup(name, {k: v[1] for k, v in T.MODEL_PRICES.items()}, T.DEFAULT_PRICE[1]),
    )


def batch_cost(rows, input_price, output_price):
    """Cost from the highest usage counters of a batch."""
    def top(c):
        value = F.col(c).try_cast("double").cast("bigint")
        return F.coalesce(F.max(value), F.lit(0).cast("bigint"))

    df = rows.agg(
        F.count(F.lit(1)).alias("rows"), top("llm_calls").alias("llm_calls"),
        top("estimated_input_tokens").alias("input_tokens"), top("estimated_output_tokens").alias("output_tokens"))
    cost = F.col("input_tokens") / F.lit(1e6) * F.lit(float(input_price)) + F.col("output_tokens") / F.lit(1e6) * F.lit(float(output_price))
    return df.withColumn("estimated_cost_usd", cost).withColumn(
        "cost_per_row_usd", F.col("estimated_cost_usd") / F.greatest(F.col("rows"), F.lit(1)))


def run_counts(rows):
    """Rows generated, under review, timed, in a test and in a sequence."""
    df = ensure_columns(rows, ["suggested_send_time_utc", "ab_variant_id", "sequence_step", "opening_line", "needs_manual_review"])
    filled = lambda c: F.count_if(X.clean(c) != "")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), filled("opening_line").alias("generated"),
        F.count_if(X.loose_bool("needs_manual_review", extra=())).alias("needs_review"),
        filled("suggested_send_time_utc").alias("timed"), filled("ab_variant_id").alias("in_test"),
        filled("sequence_step").alias("in_sequence"))
