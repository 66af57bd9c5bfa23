"""Delivery: edit overlay, client-safe table, leak scan, sending-tool and review layouts."""

from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import redact
from quillgate.functions import text as X
from quillgate.operators.canonical import use_edit
from quillgate.operators.gates import GATE_COLUMNS, apply_sendability
from quillgate.operators.outreach import row_status
from quillgate.operators.rows import attach_scalar, ensure_columns

CLIENT_SAFE_COLUMNS = [
    "status", "sendability_decision", "human_decision", "company", "person", "role", "website",
    "personalized_line", "evidence_found", "source_urls", "surface_correctness", "evidence_score",
    "visual_reliability_score", "viewport_scope", "safe_screenshots", "privacy_scan_flags",
    "screenshot_privacy_notes", "client_safe_notes",
]


def overlay_edits(df):
    """Approved edits replace the generated line."""
    line = F.when(use_edit(), F.col("edited_line")).otherwise(F.col("personalized_line"))
    return df.withColumn("personalized_line", line)


def delivery_filter(df, source=None):
    """Human-approved rows when the batch has any, otherwise the gate's Send rows.

    ``source`` are the same rows before the gate; with them the gate does not run for the question whether any is approved.
    """
    approved = F.lower(X.text("human_decision")).isin("send", "edit")
    any_approved = (df if source is None else source).agg(F.coalesce(F.bool_or(approved), F.lit(False)).alias("__any"))
    flagged = attach_scalar(df, any_approved)
    keep = F.when(F.col("__any"), approved).otherwise(F.col("sendability_decision") == "Send")
    return flagged.filter(keep).drop("__any")


def delivery_rows(df, policy="all"):
    """Delivery table by policy: all rows, gate Send only, or human-approved only."""
    rows = overlay_edits(df)
    if policy == "send":
        return rows.filter(F.col("sendability_decision") == "Send")
    if policy == "approved":
        return rows.filter(F.lower(X.text("human_decision")).isin("send", "edit"))
    return rows


def policy_counts(df):
    """Delivery rows of every policy, counted in one pass."""
    row = df.agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("sendability_decision") == "Send").alias("send"),
        F.count_if(F.lower(X.text("human_decision")).isin("send", "edit")).alias("approved"))
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("policy"), F.col(p).alias("rows")) for p in ("all", "send", "approved")])).alias("x")).select("x.*")


def facet_filter(df, **choices):
    """Keep rows whose columns are in the chosen values; an empty choice filters nothing."""
    for column, values in choices.items():
        if values and column in df.columns:
            df = df.filter(F.col(column).isin(list(values)))
    return df


def review_queue(df):
    if "sendability_decision" in df.columns:
        return df.filter(F.col("sendability_decision").isin("Edit", "Reject"))
    return df.filter(F.col("status").isin("Review", "Research only"))


def by_priority(df):
    """Rows with ``priority``: Edit rows first, then Reject, Send and the rest; the sink sorts."""
    return df.withColumn("priority", X.lookup("sendability_decision", {"Edit": 0, "Reject": 1, "Send": 2}, 3))


def redact_columns(df, columns, flag_column="privacy_scan_flags"):
    """Redact every cell and join the distinct flags of a row in sorted order.

    A row is first searched as one text for every class; only rows with a find are rewritten, cell by cell,
    one class after the other, and a class is flagged where its replacement changed a cell.
    """
    df = df.withColumns({c: X.text(c) for c in columns}).withColumn("__flags", F.lit(""))
    df = df.withColumn("__whole", F.concat_ws("\n", *columns))
    df = df.withColumn("__risky", X.any_of([redact.found(F.col("__whole"), name) for name, _, _ in redact.STEPS])).drop("__whole")
    for name, pattern, replacement in redact.STEPS:
        df = df.withColumns({
            f"__new_{c}": redact.replaced(F.col(c), name, pattern, replacement, F.col("__risky")) for c in columns})
        hit = X.any_of([F.col(f"__new_{c}") != F.col(c) for c in columns])
        kept = [F.col(c) for c in df.columns if c not in columns and c != "__flags" and not c.startswith("__new_")]
        df = df.select(
            *kept, *[F.col(f"__new_{c}").alias(c) for c in columns],
            F.when(hit, F.concat("__flags", F.lit(X.SEP + name))).otherwise(F.col("__flags")).alias("__flags"))
    found = F.array_remove(F.split("__flags", X.SEP), "")
    if flag_column in df.columns:
        found = F.concat(found, X.split_list(flag_column, "|"))
    return df.withColumn(flag_column, X.join_list(F.sort_array(F.array_distinct(found)))).drop("__flags", "__risky")


def client_safe(df, scored=False, keep=(), source=None):
    """Client-safe delivery table: filter, overlay, fixed columns, redaction, notes."""
    rows = df if scored else apply_sendability(df)
    rows = overlay_edits(delivery_filter(rows, source if scored else df))
    rows = rows.withColumns({
        "safe_screenshots": F.lit(""), "privacy_scan_flags": F.lit(""),
        "screenshot_privacy_notes": F.lit(""), "client_safe_notes": F.lit(T.CLIENT_SAFE_NOTE),
    })
    rows = ensure_columns(rows, CLIENT_SAFE_COLUMNS).select(*keep, *CLIENT_SAFE_COLUMNS)
    open_columns = [c for c in CLIENT_SAFE_COLUMNS if c != "privacy_scan_flags"]
    safe = redact_columns(rows, open_columns)
    note = F.concat(
        "client_safe_notes", F.lit(" Potential sensitive values were redacted: "), "privacy_scan_flags", F.lit("."))
    return safe.withColumn("client_safe_notes", F.when(
        F.col("privacy_scan_flags") != "", note).otherwise(F.col("client_safe_notes"))).select(*keep, *CLIENT_SAFE_COLUMNS)


def residual_flags(df):
    """Sensitive classes left anywhere in the table.

    Rows are scanned on their own; only the seven class switches are aggregated.
    """
    blob = F.concat_ws(" ", *[X.text(c) for c in df.columns])
    rest = df.select(blob.alias("t")).select(redact.without_redacted(F.col("t")).alias("t"))
    found = rest.select(redact.scan("t", ignore_redacted=False).alias("f"))
    names = list(redact.CLASSES)
    row = found.agg(F.count(F.lit(1)).alias("rows"), *[
        F.coalesce(F.bool_or(F.array_contains("f", n)), F.lit(False)).alias(n) for n in names])
    return row.select(F.sort_array(X.flags(*[(F.col(n), n) for n in names])).alias("flags"), "rows")


def hard_leaks(df):
    return residual_flags(df).select(F.array_intersect("flags", X.lits(T.HARD_LEAKS)).alias("leaks"))


def delivery_manifest(source, safe):
    """One-row manifest; the status is blocked when hard leaks remain.

    ``source`` are the rows before the gate; the delivered rows are counted and scanned in one pass.
    """
    n_in = source.agg(F.count(F.lit(1)).alias("n"))
    flags = residual_flags(safe)
    leaks = F.size(F.array_intersect("flags", X.lits(T.HARD_LEAKS))) > 0
    return flags.select(
        n_in.scalar().alias("input_rows"), F.col("rows").alias("client_rows"),
        F.lit("human-approved send/edit when available, otherwise sendability Send only").alias("filter_policy"),
        X.join_list("flags").alias("remaining_privacy_scan_flags"),
        F.when(leaks, "blocked").otherwise("client_safe").alias("status"))


def scan_file_names(df, columns=("shareable_screenshots", "screenshots"), key="row_idx"):
    """Privacy scan of the file names in screenshot columns."""
    items = F.array_distinct(F.concat(*[X.split_list(c, "\n|") for c in columns if c in df.columns]))
    rows = df.select(key, F.explode(items).alias("file_name"))
    return rows.withColumn("flags", redact.scan("file_name")).filter(F.size("flags") > 0)


def sending_tool(df, preset="generic"):
    """Columns of a sending tool; an unknown preset means generic."""
    mapping = T.SENDING_PRESETS.get(preset, T.SENDING_PRESETS["generic"])
    have = {"human_decision", "edited_line", "personalized_line"} <= set(df.columns)
    rows = overlay_edits(df) if have else df
    person = F.col("person") if "person" in df.columns else F.lit("")
    rows = rows.withColumns({
        "first_name": F.when(X.clean(person) == "", "").otherwise(X.first_word(person)),
        "last_name": F.when(X.clean(person) == "", "").otherwise(X.rest_words(person)),
    })
    return rows.select(*[
        (X.text(source) if source in rows.columns else F.lit("")).alias(target) for target, source in mapping])


# --- review and research layouts ----------------------------------------------------------
_OPTION_FIELDS = [
    ("line", "opening_line", None), ("qc_score", "confidence_score", None),
    ("quality_flags", "quality_flags", 220), ("needs_review", "needs_manual_review", "yes_no"),
]
_REVIEW_PLAIN = [
    "friction_type", "surface_checked", "conversion_outcome", "product_surface_type",
    "research_priority", "angle_gate_decision", "app_check_status",
]
_REVIEW_CELLS = [
    ("recommended_manual_check", "recommended_manual_check", 520),
    ("app_review_themes", "app_review_themes", 420), ("visual_flags", "visual_quality_flags", 240),
    ("visual_confidence", "visual_confidence", None),
    ("visual_confidence_score", "visual_confidence_score", None),
    ("visual_confidence_reasons", "visual_confidence_reasons", 360), ("evidence_found", "__evidence", 760),
    ("screenshots", "screenshot_paths", 520), ("shareable_screenshots", "shareable_screenshot_files", 520),
    ("trace_files", "trace_files", 520), ("ux_validator_findings", "ux_validator_findings", 520),
    ("advanced_detector_flags", "advanced_detector_flags", 240), ("dead_link_checks", "dead_link_checks", 420),
    ("needs_manual_review", "needs_manual_review", "yes_no"), ("quality_flags", "quality_flags", 240),
    ("reviewer_notes", "reviewer_notes", "notes"), ("role", "recipient_role", None),
    ("website", "website_url", None), ("source_urls", "source_urls", 520),
]
_RUN_METADATA = [
    "llm_calls", "estimated_input_tokens", "estimated_output_tokens", "tone_profile",
    "model_provider", "model_name", "prompt_set_hash", "evidence_prompt_hash", "write_prompt_hash",
    "qc_prompt_hash", "tone_profile_hash",
]
_EDIT_COLUMNS = {
    "human_decision": "unreviewed", "edited_line": "", "edit_reason_category": "not_reviewed", "edit_notes": ""}

REVIEW_COLUMNS = [
    "row_id", "run_id", "example_id", "model_opening_line", "current_opening_line",
    "final_delivery_line", "status", *GATE_COLUMNS, *_EDIT_COLUMNS, "company", "person",
    "personalized_line", *[f"option_{i}_{f}" for i in (1, 2, 3) for f, _, _ in _OPTION_FIELDS],
    "template_preview", *_REVIEW_PLAIN, *[c for c, _, _ in _REVIEW_CELLS], *_RUN_METADATA,
]


#: More characters than a cell can have: the whole text in the layout of a cell.
_WHOLE = 2 ** 31 - 1


def _shape(source, how, whole=False):
    if how is None:
        return X.text(source)
    if how == "yes_no":
        return X.yes_no(source)
    if how == "notes":
        return X.clean_notes(source, _WHOLE) if whole else X.clean_notes(source)
    return X.cell_lines(source, _WHOLE if whole else how)


def _run_line():
    missing = X.text("opening_line") == ""
    silent = X.text("quality_flags").contains("ai_generation_unavailable")
    return F.when(missing & silent, F.lit(T.RESEARCH_ONLY_LINE)).otherwise(X.text("opening_line"))


def _run_inputs(rows):
    needed = {s for _, s, _ in _REVIEW_CELLS} | set(_REVIEW_PLAIN) | set(_RUN_METADATA) | {
        "row_id", "run_id", "example_id", "company_name", "recipient_name", "opening_line",
        "evidence_used_for_copy", "evidence_points", "template_preview"} | {
        f"{s}_option_{i}" for i in (1, 2, 3) for _, s, _ in _OPTION_FIELDS} | set(_RESEARCH_SOURCES)
    return ensure_columns(rows, sorted(needed - {"__evidence"})).withColumns({
        "__evidence": X.first_present("evidence_used_for_copy", "evidence_points"), "__line": _run_line()})


def review_rows(rows, order="row_idx", shortened=False):
    """Review rows with all gate columns and whole texts in every cell.

    ``shortened`` cuts the cells for display, after the gate has seen whole texts.
    """
    df = _run_inputs(rows)
    cut = {target: (source, how) for target, source, how in _REVIEW_CELLS if isinstance(how, int)}
    line = F.col("__line")
    option = []
    for i in (1, 2, 3):
        for target, source, how in _OPTION_FIELDS:
            value = _shape(f"{source}_option_{i}", how, not shortened)
            if i == 1 and target == "line":
                value = X.first_present(value, line)
            option.append(value.alias(f"option_{i}_{target}"))
    tail = [c for c in rows.columns if c.startswith("input__")]
    out = df.select(
        order, "row_id", "run_id", "example_id",
        *[line.alias(c) for c in ("model_opening_line", "current_opening_line", "final_delivery_line", "personalized_line")],
        row_status("__line").alias("status"), F.col("company_name").alias("company"),
        F.col("recipient_name").alias("person"), *option,
        _shape("template_preview", 520, not shortened).alias("template_preview"),
        *[X.text(c).alias(c) for c in _REVIEW_PLAIN],
        *[_shape(source, how, target in cut or not shortened).alias(target) for target, source, how in _REVIEW_CELLS],
        *[_shape(source, how, not shortened).alias(f"cell__{target}") for target, (source, how) in cut.items()],
        *[X.text(c).alias(c) for c in _RUN_METADATA], *tail)
    out = apply_sendability(ensure_columns(out, _EDIT_COLUMNS), order=order)
    cells = [F.col(f"cell__{c}").alias(c) if c in cut else F.col(c) for c in REVIEW_COLUMNS]
    return out.select(order, *cells, *tail)


# research sheet column -> (source column, limit)
_RESEARCH = [
    ("company", "company_name", None), ("person", "recipient_name", None), ("role", "recipient_role", None),
    ("website", "website_url", None),
    *[(c.replace("_", " "), c, None) for c in [
        "tone_profile", "model_provider", "model_name", "prompt_set_hash", "evidence_prompt_hash",
        "write_prompt_hash", "qc_prompt_hash", "tone_profile_hash", "llm_calls",
        "estimated_input_tokens", "estimated_output_tokens", "linkedin_observation",
        "app_flow_observation", "product_surface_type", "research_priority"]],
    *[(c.replace("_", " "), c, 900) for c in ["app_review_complaints", "app_review_themes"]],
    ("app check status", "app_check_status", None),
    *[(c.replace("_", " "), c, 900) for c in [
        "recommended_manual_check", "template_preview", "app_store_summary", "visual_observations"]],
    ("visual flags", "visual_quality_flags", 500), ("visual confidence", "__visual", 80),
    ("visual confidence reasons", "visual_confidence_reasons", 900), ("screenshot paths", "screenshot_paths", 900),
    ("shareable screenshots", "shareable_screenshot_files", 900), ("trace files", "trace_files", 900),
    ("ux validator findings", "ux_validator_findings", 900),
    ("advanced detector flags", "advanced_detector_flags", 500), ("dead link checks", "dead_link_checks", 900),
    ("friction type", "friction_type", None), ("surface checked", "surface_checked", None),
    ("conversion outcome", "conversion_outcome", None), ("angle gate decision", "angle_gate_decision", None),
    ("angle gate notes", "angle_gate_notes", 500), ("blocked angles", "blocked_angles", 900),
    ("angle priority", "angle_priority", None), ("blog used", "blog_used", None),
    ("why this angle", "why_this_angle", 500), ("evidence found", "__evidence", 900),
    ("evidence strength score", "evidence_strength_score", None),
    ("personalization quality score", "personalization_quality_score", None),
    ("source urls", "source_urls", 500), ("raw reviewer notes", "reviewer_notes", "notes"),
]
_RESEARCH_SOURCES = [s for _, s, _ in _RESEARCH if not s.startswith("__")]
RESEARCH_COLUMNS = [t for t, _, _ in _RESEARCH]


def research_rows(rows, order="row_idx", shortened=False):
    """Research detail rows with whole texts; ``shortened`` cuts the cells for display."""
    df = _run_inputs(rows).withColumn("__visual", F.concat(
        X.text("visual_confidence"), F.lit(" ("), X.text("visual_confidence_score"), F.lit("/100)")))

    def shape(source, how):
        if how is None:
            return X.text(source)
        if how == "notes":
            return X.clean_notes(source) if shortened else X.clean_notes(source, _WHOLE)
        return X.shorten(source, how if shortened else _WHOLE)

    tail = [c for c in rows.columns if c.startswith("input__")]
    return df.select(order, *[shape(s, how).alias(t) for t, s, how in _RESEARCH], *tail)


REVIEWER_ORDER = [
    "status", *GATE_COLUMNS, *_EDIT_COLUMNS, "company", "person", "role", "website",
    "personalized_line", "template_preview", "evidence_found", "quality_flags",
    "needs_manual_review", "reviewer_notes", "friction_type", "surface_checked",
    "conversion_outcome", "product_surface_type", "research_priority", "visual_confidence",
    "visual_confidence_score", "visual_confidence_reasons", "visual_flags", "screenshots",
    "shareable_screenshots", "trace_files", "ux_validator_findings", "advanced_detector_flags",
    "dead_link_checks", "source_urls", *_RUN_METADATA[3:],
]


def reviewer_table(review):
    """Column order for the reviewer; columns that are missing are left out."""
    return review.select(*[c for c in REVIEWER_ORDER if c in review.columns])
