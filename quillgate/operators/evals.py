"""Labels, goldsets, agreement metrics and the release gate."""

from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import text as X
from quillgate.functions.stats import rate_pct
from quillgate.operators.gates import GATE_COLUMNS, apply_sendability
from quillgate.operators.order import running
from quillgate.operators.rows import ensure_columns, last_per_key

TRAINING_COLUMNS = [
    "company", "person", "role", "website", "current_line", "opening_line", "client_decision",
    "client_rewrite", "main_reason", "surface_to_focus_on", "evidence_or_context",
    "what_good_should_sound_like", "final_notes",
]
CAMPAIGN_SIGNALS = ["sent", "opened", "replied", "positive_reply", "booked", "bad_fit_or_bounce"]
CAMPAIGN_COLUMNS = [
    "campaign_name", "company", "person", "role", "website", "delivered_line", *CAMPAIGN_SIGNALS,
    "notes", "imported_at",
]
GOLDSET_ALIASES = [
    ("personalized_line", "original_line"), ("surface_checked", "surface_used"),
    ("product_surface_type", "product_type"), ("source_urls", "evidence_refs"),
    ("model_name", "writer_model"),
]


def normalize_goldset(df):
    """Old goldset column names and defaults for the gate."""
    df = df.withColumns({
        new: F.col(old) for new, old in GOLDSET_ALIASES if new not in df.columns and old in df.columns})
    df = ensure_columns(df, ["status", "quality_flags", "needs_manual_review", "visual_confidence"])
    return df.withColumns({
        "status": F.when(X.text("status") == "", "Ready").otherwise(F.col("status")),
        "needs_manual_review": F.when(X.text("needs_manual_review") == "", "no").otherwise(F.col("needs_manual_review")),
    })


def expected_decision(c="human_decision"):
    return X.lookup(F.lower(X.clean(c)), {"send": "Send", "edit": "Edit", "reject": "Reject"}, "Unknown")


def with_agreement(scored):
    human = F.lower(X.text("human_decision"))
    gate = X.text("sendability_decision")
    return scored.withColumns({
        "gate_decision": gate,
        "agrees": expected_decision() == gate,
        "is_false_send": (gate == "Send") & (human != "send"),
    })


def needs_attention(agreed):
    return agreed.filter(~F.col("agrees") | F.col("is_false_send"))


#: What a metric is made of: counts and sums that can be added and taken back.
TALLIES = [
    "rows", "agree", "send", "send_right", "human_reject", "reject_right", "false_send", "correct", "app", "app_correct",
    "evidence_rows", "evidence_sum", "fit_rows", "fit_sum",
]


#: Columns that tallies look at.
TALLIED = [
    "human_decision", "sendability_decision", "product_surface_type", "surface_correctness", "evidence_score", "template_fit_score"]


def tallies(scored, keys=()):
    """Counts and sums of a scored table, per ``keys``; one aggregation."""
    human = F.lower(X.text("human_decision"))
    df = with_agreement(scored)
    gate = F.col("gate_decision")
    app = F.lower(X.text("product_surface_type")) == "app_first_product"
    correct = F.col("surface_correctness") == "Correct"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    values = [
        F.count(F.lit(1)), F.count_if("agrees"), F.count_if(gate == "Send"), F.count_if((gate == "Send") & (human == "send")),
        F.count_if(human == "reject"), F.count_if((gate == "Reject") & (human == "reject")), F.count_if("is_false_send"),
        F.count_if(correct), F.count_if(app), F.count_if(app & correct),
        F.count("evidence_score"), total("evidence_score"), F.count("template_fit_score"), total("template_fit_score")]
    return df.groupBy(*keys).agg(*[v.alias(n) for n, v in zip(TALLIES, values)])


def corrected(before, old, new, keys=()):
    """Tallies after rows changed: the earlier tallies without the old versions of these rows, with the new ones."""
    signed = lambda df, sign: df.select(*keys, *[(F.col(c) * sign).alias(c) for c in TALLIES])
    both = signed(before, 1).unionByName(signed(old, -1)).unionByName(signed(new, 1))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in TALLIES])


def metrics_of(counted, keys=()):
    """Evaluation metrics as (keys, metric, value) rows from tallies."""
    c = F.col

    def mean(total, n):
        return F.coalesce(F.bround(F.when(c(n) > 0, c(total) / c(n)), 1), F.lit(0.0))

    values = {
        "exact_gate_human_agreement_pct": rate_pct(c("agree"), c("rows")),
        "send_precision_pct": rate_pct(c("send_right"), c("send")),
        "reject_recall_pct": rate_pct(c("reject_right"), c("human_reject")),
        "false_send_rows": c("false_send").cast("double"),
        "surface_correct_rate_pct": rate_pct(c("correct"), c("rows")),
        "app_first_surface_correct_rate_pct": rate_pct(c("app_correct"), c("app")),
        "avg_evidence_score": mean("evidence_sum", "evidence_rows"),
        "avg_template_fit_score": mean("fit_sum", "fit_rows"),
        "frozen_eval_rows": c("rows").cast("double"),
    }
    return counted.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in values.items()])).alias("m")).select(*keys, "m.*")


def metrics(scored, keys=()):
    """Evaluation metrics as (keys, metric, value) rows; one aggregation over the table."""
    return metrics_of(tallies(scored, keys), keys)


def decision_counts(scored):
    """Rows per gate decision and per human decision."""
    df = with_agreement(scored)
    pairs = F.array(
        F.concat(F.lit("gate_"), F.lower("gate_decision"), F.lit("_rows")),
        F.when(F.lower(X.text("human_decision")) != "", F.concat(
            F.lit("human_"), F.lower("human_decision"), F.lit("_rows"))))
    rows = df.select(F.explode(pairs).alias("metric")).filter(F.col("metric").isNotNull())
    return rows.groupBy("metric").agg(F.count(F.lit(1)).cast("double").alias("value"))


EVAL_DETAIL = [
    "company", "person", "human_decision", "gate_decision", "agreement", "false_send",
    "sendability_score", "hard_fail_reasons", "soft_edit_reasons", "surface_correctness",
    "surface_correctness_score", "product_type", "evidence_score", "copy_quality_score",
    "outcome_alignment_score", "template_fit_score", "visual_reliability_score",
    "viewport_scope", "edit_reason_category", "original_line", "preferred_line",
]


def eval_details(scored):
    df = with_agreement(scored).withColumns({
        "agreement": F.when(F.col("agrees"), "yes").otherwise("no"),
        "false_send": F.when(F.col("is_false_send"), "yes").otherwise("no"),
    })
    return ensure_columns(df, EVAL_DETAIL).select(*EVAL_DETAIL)


_MINIMUMS = [
    ("send_precision_pct", "min_send_precision"),
    ("exact_gate_human_agreement_pct", "min_exact_agreement"),
    ("surface_correct_rate_pct", "min_surface_correct_rate"),
    ("app_first_surface_correct_rate_pct", "min_app_first_surface_correct_rate"),
]


def release_gate(metric_rows, thresholds=None, baseline=None, keys=()):
    """Violated rules as rows, per ``keys``; no row means the release passes.

    ``baseline`` holds (keys, metric, value); a metric without a baseline has no regression rule.  The metrics of
    one release are about ten rows, so they are turned into one map per rule set.
    """
    limits = {**T.RELEASE_THRESHOLDS, **(thresholds or {})}

    def as_map(rows, name):
        return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias(name))

    df = as_map(metric_rows, "m")
    if baseline is not None:
        known = as_map(baseline.filter(F.col("value").isNotNull()), "b")
        df = df.join(known, list(keys), "left") if keys else df.withColumn("b", known.scalar())
    m = lambda k, side="m": F.coalesce(F.col(side)[k], F.lit(0.0))
    empty = m("frozen_eval_rows") == 0
    rule = lambda cond, metric, name, bound: F.when(cond, F.struct(
        F.lit(metric).alias("metric"), F.lit(name).alias("rule"), m(metric).alias("value"),
        (F.lit(float(bound)) if isinstance(bound, (int, float)) else bound).alias("threshold")))
    rules = [rule(empty, "frozen_eval_rows", "rows_available", 1.0)]
    for metric, name in _MINIMUMS:
        low = m(metric) < limits[name]
        if metric.startswith("app_first"):
            low = low & (m(metric) > 0)
        rules.append(rule(~empty & low, metric, name, limits[name]))
    rules.append(rule(~empty & (m("false_send_rows") > limits["max_false_sends"]), "false_send_rows",
                      "max_false_sends", limits["max_false_sends"]))
    if baseline is not None:
        for metric in T.REGRESSION_METRICS:
            rules.append(rule(~empty & (m(metric, "b") > 0) & (m(metric) < m(metric, "b")), metric,
                              "no_regression", m(metric, "b")))
        rules.append(rule(~empty & F.col("b").isNotNull() & (m("false_send_rows") > m("false_send_rows", "b")), "false_send_rows",
                          "no_regression", m("false_send_rows", "b")))
    return df.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("r")).select(*keys, "r.*")


def baseline_changes(current, baseline, keys=()):
    """Metric by metric comparison with a stored baseline."""
    base = baseline.select(*keys, "metric", F.col("value").alias("baseline_value"))
    return current.join(base, [*keys, "metric"]).withColumn("change", F.bround(F.col("value") - F.col("baseline_value"), 4))


def baseline_before(current, history, at="evaluated_at", version="created_at"):
    """The rows of ``current`` with the value and the time of the latest baseline of their metric before them.

    An as-of join: both tables are put into one order of time, and the last baseline seen is carried along it per
    metric (``order.running``), so neither many runs nor many baselines of one metric meet in one task.  A
    baseline of the very time of a run is not before it.  Times are timestamps or their text.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 2
    seen = history.groupBy("metric", (micros(version) + 1).alias("__when")).agg(
        F.max(F.struct(F.col(version).cast("string").alias("version"), "value")).alias("__seen"))
    both = current.withColumn("__when", micros(at)).unionByName(seen.withColumn("__past", F.lit(True)), allowMissingColumns=True)
    carried = running(both, "__when", lasts={"__seen": "__seen"}, keys=["metric"])
    return carried.filter(F.col("__past").isNull()).select(
        *current.columns, F.col("__seen.value").alias("baseline_value"), F.col("__seen.version").alias("baseline_version"))


# --- goldsets ---------------------------------------------------------------------------
GOLDSET_COLUMNS = [
    "created_at", "imported_at", "goldset_split", "example_id", "row_id", "run_id", "source_kind",
    "origin_run_id", "origin_row_id", "label_source", "is_frozen_eval_example",
    "is_training_candidate", "company", "person", "role", "website", "model_opening_line",
    "current_opening_line", "final_delivery_line", "template_preview", "original_line",
    "edited_line", "preferred_line", "non_preferred_line", "human_decision",
    "edit_reason_category", "edit_notes", *GATE_COLUMNS[:19], "evidence_found", "evidence_refs",
    "quality_flags", "visual_confidence", "friction_type", "surface_used", "conversion_outcome",
    "product_type", "tone_profile", "writer_model", "judge_model",
]


def check_split(split):
    if split not in T.GOLDSET_SPLITS:
        raise ValueError(f"Unknown goldset split: {split}")


def preference_pairs(df):
    """Preferred and non-preferred line of a reviewed row."""
    human = F.lower(X.clean("human_decision"))
    edited = X.clean("edited_line")
    current = X.first_present(*[c for c in ["current_opening_line", "personalized_line", "opening_line"] if c in df.columns])
    final = X.clean("final_delivery_line") if "final_delivery_line" in df.columns else F.lit("")
    original = X.first_present(*[c for c in [
        "model_opening_line", "original_line", "personalized_line", "opening_line"] if c in df.columns])
    return df.withColumns({
        "preferred_line": F.when(human.isin("send", "edit"), X.first_present(edited, final, current)).otherwise(""),
        "non_preferred_line": F.when(human == "reject", original).when(
            (edited != "") & (edited != original), original).otherwise(""),
    })


def goldset_rows(df, split, created_at, scored=False):
    """Reviewed rows as goldset rows of one split."""
    check_split(split)
    rows = df if scored else apply_sendability(df)
    rows = rows.filter(F.lower(X.text("human_decision")) != "unreviewed")
    rows = preference_pairs(rows)
    rows = ensure_columns(rows, {
        "source_kind": "operator_review", "label_source": "internal_reviewer", "model_name": ""})
    rows = rows.withColumns({
        "created_at": F.lit(created_at), "goldset_split": F.lit(split),
        "is_frozen_eval_example": F.lit("yes" if split == "frozen_eval_set" else "no"),
        "is_training_candidate": F.lit("yes" if split == "candidate_training_set" else "no"),
        "original_line": F.col("model_opening_line"),
        "surface_used": F.col("surface_checked"), "product_type": F.col("product_surface_type"),
        "evidence_refs": F.concat(X.text("source_urls"), F.lit(" | "), X.text("shareable_screenshots")),
        "writer_model": F.col("model_name"),
        "judge_model": F.lit("deterministic_sendability_gate_v2"),
    })
    return ensure_columns(rows, GOLDSET_COLUMNS).select(*GOLDSET_COLUMNS)


def append_goldset(existing, new, order="created_at"):
    """Keep the newest row per (split, example)."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return last_per_key(both, ["goldset_split", "example_id"], ["__new", order]).drop("__new")


def split_guard(rows):
    """(accepted, rejected): client labels never enter the frozen split, unknown splits are refused."""
    ok = F.col("goldset_split").isin(T.GOLDSET_SPLITS) & ~(
        (F.col("goldset_split") == "frozen_eval_set") & (X.text("source_kind") == "client_feedback"))
    return rows.filter(ok), rows.filter(~ok)


def goldset_summary(rows, order="row_idx"):
    """Rows, decisions and the leading edit reason per split; empty splits stay visible."""
    human = F.lower(X.text("human_decision"))
    counts = rows.groupBy("goldset_split").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(human == d).alias(d) for d in ("send", "edit", "reject")])
    reason = X.text("edit_reason_category")
    reasons = rows.filter((reason != "") & (reason != "not_reviewed")).groupBy("goldset_split", "edit_reason_category").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    top = reasons.groupBy("goldset_split").agg(
        F.max_by("edit_reason_category", F.struct("n", (-F.col("first")).alias("f"))).alias("top_reason"))
    spark = rows.sparkSession
    names = spark.createDataFrame([(s,) for s in T.GOLDSET_SPLITS], "goldset_split string")
    out = names.join(counts, "goldset_split", "left").join(top, "goldset_split", "left")
    return out.select(
        F.col("goldset_split").alias("split"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("rows", "send", "edit", "reject")],
        X.text("top_reason").alias("top_reason"))


# --- client labels and campaign results ---------------------------------------------------
def training_template(df):
    """Blank label sheet for a review table."""
    pick = lambda *names: X.text(F.col(next((n for n in names if n in df.columns), None))) if any(
        n in df.columns for n in names) else F.lit("")
    values = {
        "company": pick("company"), "person": pick("person"), "role": pick("role"), "website": pick("website"),
        "current_line": pick("template_preview", "personalized_line"),
        "opening_line": pick("personalized_line", "opening_line"),
        "surface_to_focus_on": pick("surface_checked"), "evidence_or_context": pick("evidence_found"),
    }
    return df.select(*[values.get(c, F.lit("")).alias(c) for c in TRAINING_COLUMNS])


def campaign_template(df):
    line = X.first_present("edited_line", "personalized_line") if "edited_line" in df.columns else X.text("personalized_line")
    values = {c: X.text(c) for c in ("company", "person", "role", "website") if c in df.columns}
    values["delivered_line"] = line
    return df.select(*[values.get(c, F.lit("")).alias(c) for c in CAMPAIGN_COLUMNS])


def normalize_labels(df, imported_at):
    """Client label rows with a decision, in review-row form."""
    df = ensure_columns(df, TRAINING_COLUMNS)
    df = df.filter(X.clean("client_decision") != "")
    source = F.when(X.clean("opening_line") != "", X.text("opening_line")).otherwise(X.text("current_line"))
    context = X.text("evidence_or_context")
    prefixed = lambda label, c: F.when(X.text(c) != "", F.concat(F.lit(label), X.text(c)))
    carried = [c for c in df.columns if c not in TRAINING_COLUMNS]
    return df.select(
        *carried, "company", "person", "role", "website",
        *[source.alias(c) for c in ("personalized_line", "model_opening_line", "current_opening_line")],
        X.text("current_line").alias("template_preview"),
        X.lookup(F.lower(X.text("client_decision")), T.CLIENT_DECISIONS, "unreviewed").alias("human_decision"),
        X.text("client_rewrite").alias("edited_line"),
        X.lookup(F.lower(X.text("main_reason")), T.CLIENT_REASONS, "other").alias("edit_reason_category"),
        F.concat_ws(" | ", prefixed("Surface: ", "surface_to_focus_on"),
                    prefixed("Good should sound like: ", "what_good_should_sound_like"),
                    F.when(X.clean("final_notes") != "", X.text("final_notes"))).alias("edit_notes"),
        context.alias("evidence_found"), X.text("surface_to_focus_on").alias("surface_checked"),
        F.when(context.startswith("http"), context).otherwise("").alias("source_urls"),
        F.lit("Ready").alias("status"), F.lit("").alias("quality_flags"),
        F.lit("no").alias("needs_manual_review"), F.lit("").alias("visual_confidence"),
        F.lit("client_feedback").alias("source_kind"), F.lit("client").alias("label_source"),
        F.lit("").alias("origin_run_id"), F.lit("").alias("origin_row_id"),
        F.lit(imported_at).alias("imported_at"))


def normalize_campaign(df, imported_at):
    """Campaign result rows that carry any signal."""
    df = ensure_columns(df, CAMPAIGN_COLUMNS).withColumn("imported_at", F.lit(imported_at))
    keep = X.first_present(*CAMPAIGN_SIGNALS) != ""
    return df.filter(keep)


def append_campaign(existing, new, order=("imported_at",)):
    """Newest row per campaign, company, person and line."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    keys = ["campaign_name", "company", "person", "delivered_line"]
    return last_per_key(both, keys, ["__new", *order]).drop("__new")


# --- judges -------------------------------------------------------------------------------
def normalize_decision(c):
    d = F.lower(X.clean(c))
    return F.when(d.isin("send", "edit", "reject"), d).otherwise("unknown")


def candidate_line(columns):
    return X.first_present(*[c for c in [
        "original_line", "model_opening_line", "personalized_line", "opening_line",
        "current_opening_line"] if c in columns])


def judge_agreement(goldset, judged, key="example_id"):
    """Agreement of each judge model with the human decision.

    ``judged`` holds (example_id, model, judge_decision); one goldset row per example.
    """
    human = goldset.select(key, normalize_decision("human_decision").alias("human"))
    rows = judged.join(human, key).withColumn("agrees", F.col("judge_decision") == F.col("human"))
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("agrees").alias("agreements"),
        rate_pct(F.count_if("agrees"), F.count(F.lit(1))).alias("agreement_pct"))
