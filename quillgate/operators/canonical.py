"""Canonical review rows: alias columns, line provenance, ids, nested evidence."""

from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import text as X
from quillgate.operators.rows import attach_scalar, ensure_columns, with_generated_ids

# canonical column -> columns looked up in this order
CORE = {
    "company": ["company", "company_name"],
    "person": ["person", "recipient_name"],
    "role": ["role", "recipient_role"],
    "website": ["website", "website_url"],
    "personalized_line": ["personalized_line", "opening_line", "current_opening_line"],
    "evidence_found": ["evidence_found", "evidence_used_for_copy", "evidence_points"],
    "screenshots": ["screenshots", "screenshot_paths"],
    "shareable_screenshots": ["shareable_screenshots", "shareable_screenshot_files"],
    "visual_flags": ["visual_flags", "visual_quality_flags"],
}
PLAIN = [
    "product_surface_type", "surface_checked", "research_priority", "conversion_outcome",
    "source_urls", "visual_confidence", "visual_confidence_reasons", "trace_files",
    "ux_validator_findings", "advanced_detector_flags", "dead_link_checks", "quality_flags",
    "edited_line", "edit_notes",
]
DEFAULTS = {
    "status": "Ready", "needs_manual_review": "no", "source_kind": "run_output",
    "edit_reason_category": "not_reviewed",
}
EVIDENCE_FIELDS = [
    "evidence_found", "evidence_points", "evidence_used_for_copy", "source_urls", "screenshots",
    "shareable_screenshots", "trace_files", "ux_validator_findings", "advanced_detector_flags",
    "visual_confidence", "visual_confidence_score", "visual_confidence_reasons",
]


def _first(df, names):
    present = [F.col(n) for n in names if n in df.columns]
    return X.first_present(*present) if present else F.lit("")


def decision():
    d = F.lower(X.clean("human_decision"))
    return F.when(d.isin(T.HUMAN_DECISIONS), d).otherwise(F.lit("unreviewed"))


def use_edit():
    """A reviewed row with its own edited line."""
    return F.lower(X.clean("human_decision")).isin("send", "edit") & (X.clean("edited_line") != "")


def canonicalize(df, run_id="", order="row_idx"):
    """One select: aliases resolved, defaults filled, line provenance and ids added.

    All other input columns are carried along untouched.
    """
    df = ensure_columns(df, ["human_decision", "run_id", "row_id", "example_id", *PLAIN])
    line = _first(df, CORE["personalized_line"])
    model_line = X.first_present(
        _first(df, ["model_opening_line", "original_line", "non_preferred_line"]), line
    )
    core = {c: _first(df, names) for c, names in CORE.items() if c != "personalized_line"}
    plain = {c: X.clean(c) for c in PLAIN}
    defaults = {
        c: X.first_present(*([F.col(c)] if c in df.columns else []), F.lit(d))
        for c, d in DEFAULTS.items()
    }
    row_id = X.first_present("row_id", (F.col(order) + 1).cast("string")) if order in df.columns else X.clean("row_id")
    out = df.withColumns({
        "personalized_line": line, "model_opening_line": model_line, "current_opening_line": line,
        **core, **plain, **defaults,
        "human_decision": decision(),
        "row_id": row_id,
        "run_id": X.first_present("run_id", F.lit(run_id)),
    })
    out = out.withColumns({
        "final_delivery_line": F.when(use_edit(), F.col("edited_line")).otherwise(F.col("personalized_line")),
        "example_id": X.first_present("example_id", X.stable_id(
            "run_id", "row_id", "company", "person", "website", "model_opening_line")),
        "origin_run_id": X.first_present(*([F.col("origin_run_id")] if "origin_run_id" in df.columns else []), F.col("run_id")),
        "origin_row_id": X.first_present(*([F.col("origin_row_id")] if "origin_row_id" in df.columns else []), F.col("row_id")),
    })
    return out


def nest_evidence(df):
    """Pack the evidence columns into one struct column."""
    df = ensure_columns(df, EVIDENCE_FIELDS)
    return df.withColumn("evidence", F.struct(*[F.col(c) for c in EVIDENCE_FIELDS]))


def flatten_evidence(df):
    """Fill blank flat columns from the evidence struct and drop the struct."""
    return df.withColumns({
        c: X.first_present(*([F.col(c)] if c in df.columns else []), F.col(f"evidence.{c}"))
        for c in EVIDENCE_FIELDS
    }).drop("evidence")


def line_provenance(df, order="row_idx"):
    """Model, current and final line plus row and example ids, without touching the edits.

    When the whole ``personalized_line`` column is blank the opening line stands in for it;
    that one-row fact about the table is broadcast to every row.
    """
    df = ensure_columns(df, [
        "personalized_line", "human_decision", "edited_line", "current_opening_line", "run_id",
        "example_id", "company", "person", "website",
    ])
    any_line = df.agg(
        F.coalesce(F.bool_or(X.clean("personalized_line") != ""), F.lit(False)).alias("__any")
    )
    df = attach_scalar(df, any_line)
    opening = F.col("opening_line") if "opening_line" in df.columns else F.col("personalized_line")
    current = F.when(F.col("__any"), X.text("personalized_line")).otherwise(X.text(opening))

    def keep(*cols):  # first non-blank, text kept as it is
        return F.coalesce(*[F.when(X.clean(c) != "", X.text(c)) for c in cols], F.lit(""))

    candidates = [c for c in [
        "model_opening_line", "original_line", "non_preferred_line", "personalized_line",
        "opening_line",
    ] if c in df.columns]
    out = df.withColumns({
        "model_opening_line": keep(*candidates),
        "current_opening_line": keep(current, "current_opening_line"),
    })
    out = out.withColumn(
        "final_delivery_line",
        F.when(use_edit(), X.text("edited_line")).otherwise(F.col("current_opening_line")),
    ).drop("__any")
    out = with_generated_ids(out, "row_id", order)
    generated = X.stable_id("run_id", "row_id", "company", "person", "website", "model_opening_line")
    return out.withColumn("example_id", keep("example_id", generated))


def stamp_run(df, run_id, prompt_hashes=None, tone_hash="", usage=None, order="row_idx"):
    """Run id, row id, example id and run metadata on finished rows."""
    df = ensure_columns(df, ["run_id", "row_id", "example_id", "company_name", "recipient_name", "opening_line"])
    df = df.withColumn("run_id", X.first_present("run_id", F.lit(run_id)))
    df = with_generated_ids(df, "row_id", order)
    df = df.withColumn("example_id", X.first_present("example_id", X.stable_id(
        "run_id", "row_id", "company_name", "recipient_name", "opening_line")))
    extra = {k: F.lit(v) for k, v in {**(usage or {}), **(prompt_hashes or {})}.items()}
    return df.withColumns({**extra, "tone_profile_hash": F.lit(tone_hash)})
