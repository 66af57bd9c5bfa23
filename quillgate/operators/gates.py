"""Sendability gate: nine sub-gates per line, combined score and decision.

The work is staged in a few projections (inputs, sub-gates, decision), so lower-cased text
and term tests are computed once and each projection compiles to its own generated code.
"""

from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import text as X
from quillgate.functions.stats import clamp
from quillgate.operators.canonical import canonicalize
from quillgate.operators.rows import ensure_columns, settle

GATE_COLUMNS = [
    "sendability_decision", "sendability_score", "sendability_reasons", "hard_fail_reasons",
    "soft_edit_reasons", "evidence_score", "copy_quality_score", "outcome_alignment_score",
    "template_fit_score", "surface_correctness", "surface_correctness_score",
    "surface_correctness_reasons", "visual_reliability_score", "viewport_scope",
    "viewport_scope_score", "viewport_scope_reasons", "evidence_scope", "privacy_flags",
    "client_safe_asset_status", "sendability_dimensions",
]
_HTML = r"<[^>\n]+>"


def deliverability(line):
    """HTML tags and spam phrases in a line."""
    return X.flags(
        (X.text(line).rlike(_HTML), "html_in_personalization_line"),
        (X.has_any(F.lower(X.text(line)), T.SPAM_PHRASES), "spam_trigger_language"),
    )


def _inputs(df):
    line, low = F.col("personalized_line"), F.lower(F.col("personalized_line"))
    shots = X.first_present("shareable_screenshots", "screenshots")
    df = df.withColumns({
        "_low": low,
        "_flags": X.split_flags("quality_flags"),
        "_shots": shots,
        "_vc": F.lower(F.col("visual_confidence")),
        "_vflags": X.split_flags("visual_flags"),
        "_ps": F.lower(F.col("product_surface_type")),
        "_blob": F.lower(F.concat_ws(" ", *[X.text(c) for c in [
            "shareable_screenshots", "screenshots", "visual_confidence_reasons", "visual_flags",
            "ux_validator_findings", "advanced_detector_flags"]])),
        "_debug": F.lower(F.concat_ws(" ", X.text("trace_files"), shots, *[X.text(c) for c in [
            "dead_link_checks", "ux_validator_findings", "advanced_detector_flags"]])),
        "_combined": F.lower(F.concat_ws(
            " ", line, "evidence_found", "surface_checked", "research_priority")),
        **{f"_over_{n}": X.more_words(line, n) for n in (35, 42)},
    })
    nothing = (line == "") | line.startswith("[")
    return df.withColumns({
        "_no_line": line == "",
        "_unsendable": nothing,
        "_opens": X.starts_any("_low", T.CONVERSATIONAL_STARTS),
        "_line_outcome": X.has_any("_low", T.OUTCOME_TERMS),
        "_line_visual": X.has_any("_low", T.VISUAL_CLAIM_TERMS),
        "_html": line.rlike(_HTML),
        "_spam": X.has_any("_low", T.SPAM_PHRASES),
        "_has_shots": F.col("_shots") != "",
        "_has_source": F.col("source_urls") != "",
    })


def _flag(*names):
    return X.overlaps(F.col("_flags"), names)


def _points(condition, n):
    return F.when(condition, n).otherwise(0)


def _evidence():
    none = F.col("evidence_found") == ""
    weak, unsupported = _flag("weak_evidence", "thin_content"), _flag("unsupported_claims", "unsupported_claim")
    low_visual = F.col("_vc") == "low"
    score = clamp(
        F.lit(50)
        + _points(F.col("_has_source"), 20)
        + _points(F.col("_has_shots"), 10)
        + F.when(F.col("_vc") == "high", 15).when(F.col("_vc") == "medium", 8).when(low_visual, -8).otherwise(0)
        - _points(weak, 15)
        - _points(unsupported, 35),
        0, 100,
    )
    score = F.when(none, 0).otherwise(score)
    hard = [
        (none, "missing_evidence"),
        (~none & unsupported, "unsupported_claim"),
        (~none & (score < 60), "evidence_below_send_threshold"),
    ]
    soft = [
        (~none & ~F.col("_has_source"), "source_url_missing"),
        (~none & low_visual, "low_visual_confidence"),
        (~none & weak, "weak_evidence"),
    ]
    return score, hard, soft


def _copy():
    line, long, longer = F.col("personalized_line"), F.col("_over_35"), F.col("_over_42")
    dash = line.contains("—") | line.contains("–")
    rigid = ~F.col("_no_line") & ~F.col("_opens")
    generic = _flag("genericness", "generic", "too_generic")
    technical, made_up = _flag("technical_audit_language"), _flag("hallucination")
    penalty = (
        _points(F.col("_unsendable"), 60) + _points(dash, 35)
        + F.when(longer, 20).when(long, 10).otherwise(0)
        + _points(rigid, 10) + _points(generic, 15) + _points(technical, 15)
        + _points(made_up, 45) + _points(F.col("_html"), 45) + _points(F.col("_spam"), 15)
    )
    hard = [
        (F.col("_unsendable"), "no_sendable_personalized_line"),
        (dash, "dash_character_in_line"),
        (made_up, "hallucination"),
        (F.col("_html"), "html_in_personalization_line"),
    ]
    soft = [
        (longer, "far_too_long"),
        (long & ~longer, "slightly_too_long"),
        (rigid, "missing_conversational_opening"),
        (generic, "too_generic"),
        (technical, "technical_audit_language"),
        (F.col("_spam"), "spam_trigger_language"),
    ]
    return clamp(F.lit(100) - penalty, 0, 100), hard, soft


def _outcome():
    hit = F.col("_line_outcome") | X.has_any(F.lower(F.col("conversion_outcome")), T.OUTCOME_TERMS)
    # a term may also span the joint of line and outcome text
    joint = X.has_any(
        F.concat_ws(" ", "_low", F.lower(F.col("conversion_outcome"))),
        [t for t in T.OUTCOME_TERMS if " " in t],
    )
    hit = hit | joint
    none = F.col("_no_line")
    score = F.when(none, 0).when(hit, 100).otherwise(55)
    return score, [
        (none, "missing_line"),
        (~none & ~hit, "missing_activation_conversion_or_dropoff_outcome"),
    ]


def _template():
    bad = F.col("_unsendable")
    rigid, long = ~F.col("_opens"), F.col("_over_35")
    unclear, question = ~F.col("_line_outcome"), F.col("personalized_line").endswith("?")
    penalty = _points(rigid, 15) + _points(long, 12) + _points(unclear, 18) + _points(question, 8)
    return F.when(bad, 0).otherwise(clamp(F.lit(100) - penalty, 0, 100)), [
        (bad, "missing_line"),
        (~bad & rigid, "missing_conversational_opening"),
        (~bad & long, "template_line_too_long"),
        (~bad & unclear, "pitch_bridge_unclear"),
        (~bad & question, "question_opening_may_break_template_flow"),
    ]


def _visual():
    claim = (F.size("_vflags") > 0) | F.col("_line_visual")
    base = X.lookup("_vc", {"high": 95, "medium": 78, "low": 45, "none": 35, "": 35}, 50)
    score = clamp(base - _points(~F.col("_has_shots"), 15), 0, 100)
    return F.when(~claim, 80).otherwise(score), [
        (claim & ~F.col("_has_shots"), "visual_claim_without_shareable_screenshot"),
        (claim & F.col("_vc").isin("", "none", "low"), "visual_claim_needs_manual_check"),
    ]


def _viewport():
    claim = F.col("_line_visual") | X.has_any("_blob", T.VISUAL_CLAIM_TERMS)
    mobile, desktop = F.col("_blob").contains("mobile"), F.col("_blob").contains("desktop")
    scope = (
        F.when(~claim, "not_required")
        .when(mobile & desktop, "mobile_and_desktop")
        .when(mobile, "mobile_only")
        .when(desktop, "desktop_only")
        .otherwise("unknown")
    )
    score = F.when(~claim, 80).when(mobile & desktop, 95).when(mobile, 72).when(desktop, 65).otherwise(35)
    return scope, score, [
        (claim & mobile & ~desktop, "visual_claim_only_confirmed_on_mobile"),
        (claim & ~mobile & desktop, "visual_claim_only_confirmed_on_desktop"),
        (claim & ~mobile & ~desktop, "visual_claim_without_viewport_scope"),
    ]


def _scope():
    source, shots = F.col("_has_source"), F.col("_has_shots")
    return (
        F.when(source & shots, "source_and_screenshot")
        .when(source, "source_only")
        .when(shots, "screenshot_only")
        .when(F.col("trace_files") != "", "trace_only_internal")
        .otherwise("thin_or_missing")
    )


def _privacy():
    debug = F.col("_debug")
    found = X.flags(
        (F.col("trace_files") != "", "trace_files_internal_only"),
        (debug.contains("c:\\users\\") | debug.contains("/users/"), "local_paths_need_sanitizing"),
        (X.has_any("_debug", ["headers", "cookie", "authorization"]), "possible_sensitive_debug_metadata"),
    )
    return X.join_list(found)


def _surface():
    """Struct of label, score, reason and whether the reason is a hard failure."""
    ps, low, combined = F.col("_ps"), "_low", "_combined"
    site_line = X.has_any(low, T.WEBSITE_LINE_TERMS) & ~F.col(low).contains("app")
    app, app_line = X.has_any(combined, T.APP_SURFACE_TERMS), X.has_any(low, T.APP_SURFACE_TERMS)
    web = X.has_any(combined, T.B2B_TERMS + T.WEBSITE_SURFACE_TERMS)

    def verdict(label, score, reason="", hard=False):
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(
            F.lit(label).alias("label"), F.lit(score).alias("score"),
            reason.alias("reason"), F.lit(hard).alias("hard"),
        )

    return (
        F.when(ps == "", verdict("Unknown", 65, "product_surface_type_missing"))
        .when((ps == "app_first_product") & site_line, verdict(
            "Wrong", 25, "app_first_product_but_line_uses_website_or_blog_surface", True))
        .when((ps == "app_first_product") & app, verdict("Correct", 95))
        .when(ps == "app_first_product", verdict(
            "Review", 60, "app_first_product_without_clear_app_surface"))
        .when((ps == "marketplace_booking_flow") & X.has_any(combined, T.BOOKING_TERMS), verdict("Correct", 95))
        .when(ps == "marketplace_booking_flow", verdict(
            "Review", 62, "booking_flow_without_booking_surface"))
        .when((ps == "commerce_product_page") & X.has_any(combined, T.COMMERCE_TERMS), verdict("Correct", 92))
        .when(ps == "commerce_product_page", verdict(
            "Review", 62, "commerce_product_without_checkout_or_product_page_surface"))
        .when((ps == "b2b_service") & web, verdict("Correct", 88))
        .when(ps == "b2b_service", verdict("Review", 65, "b2b_service_surface_unclear"))
        .when((ps == "website_first_leadgen") & web, verdict("Correct", 90))
        .when((ps == "website_first_leadgen") & app_line, verdict(
            "Review", 55, "website_first_leadgen_but_line_uses_app_surface"))
        .when(ps == "website_first_leadgen", verdict("Review", 65, "website_first_surface_unclear"))
        .otherwise(verdict(
            "Review", 60, F.concat(F.lit("unknown_product_surface_type:"), ps)))
    )


def score_lines(canonical):
    """All gate columns on canonical rows."""
    df = _inputs(canonical)
    e_score, e_hard, e_soft = _evidence()
    c_score, c_hard, c_soft = _copy()
    o_score, o_soft = _outcome()
    t_score, t_soft = _template()
    v_score, v_soft = _visual()
    scope, p_score, p_soft = _viewport()
    df = df.withColumns({
        "evidence_score": e_score, "copy_quality_score": c_score,
        "outcome_alignment_score": o_score, "template_fit_score": t_score,
        "visual_reliability_score": v_score, "viewport_scope": scope,
        "viewport_scope_score": p_score, "evidence_scope": _scope(),
        "privacy_flags": _privacy(), "_surface": _surface(),
        "_ch": X.flags(*e_hard, *c_hard), "_viewport_reasons": X.flags(*p_soft),
        "_gate_soft": X.flags(*e_soft, *c_soft, *o_soft, *t_soft, *v_soft, *p_soft),
        "_severe": X.intersect_sorted(F.col("_flags"), T.SEVERE_FLAGS),
        "_edit": X.intersect_sorted(F.col("_flags"), T.EDIT_FLAGS),
    })
    research_only = (F.lower(F.col("status")) == "research only") | _flag("research_only")
    reason = F.col("_surface.reason")
    surface_reasons = X.array_of(reason)
    surface_hard = X.array_of(F.when(F.col("_surface.hard"), reason))
    df = df.withColumns({
        "_hard": F.array_distinct(F.concat(
            X.flags((research_only, "research_only")), "_severe", "_ch", surface_hard)),
        "_soft_all": F.concat(
            X.flags((X.loose_bool("needs_manual_review"), "marked_for_manual_review")),
            "_edit", "_gate_soft", surface_reasons),
    })
    df = df.withColumn("_soft", F.array_except("_soft_all", "_hard"))
    has_hard, has_soft = F.size("_hard") > 0, F.size("_soft") > 0
    weighted = F.bround(
        F.col("evidence_score") * 0.25 + F.col("copy_quality_score") * 0.22
        + F.col("outcome_alignment_score") * 0.16 + F.col("template_fit_score") * 0.14
        + F.col("_surface.score") * 0.16 + F.col("visual_reliability_score") * 0.04
        + F.col("viewport_scope_score") * 0.03, 0,
    ).cast("int")
    capped = F.when(F.col("_no_line"), F.least(weighted, F.lit(20))).otherwise(weighted)
    capped = F.when(has_hard, F.least(capped, F.lit(59))).when(
        has_soft, F.least(capped, F.lit(84))).otherwise(capped)
    df = df.withColumn("_score", clamp(capped, 0, 100))
    decision = (
        F.when(has_hard, "Reject")
        .when(has_soft | (F.col("_score") < 85), "Edit")
        .otherwise("Send")
    )
    # filters on the verdict must not be rewritten into the sub-gate expressions
    verdict = {
        "sendability_decision": decision, "sendability_score": F.col("_score"),
        "_hard_list": F.col("_hard"), "_soft_list": F.col("_soft"),
        "surface_correctness": F.col("_surface.label"),
    }
    df = settle(df.withColumns(verdict), list(verdict))
    df = df.withColumns({
        "sendability_reasons": X.join_list(F.concat("_hard_list", "_soft_list")),
        "hard_fail_reasons": X.join_list("_hard_list"),
        "soft_edit_reasons": X.join_list("_soft_list"),
        "surface_correctness_score": F.col("_surface.score"),
        "surface_correctness_reasons": reason,
        "viewport_scope_reasons": X.join_list("_viewport_reasons"),
        "client_safe_asset_status": F.when(
            F.col("privacy_flags") != "", "client_safe_export_required").otherwise("client_safe"),
        "sendability_dimensions": F.concat(
            F.lit("evidence="), "evidence_score", F.lit("; copy="), "copy_quality_score",
            F.lit("; outcome="), "outcome_alignment_score", F.lit("; template="), "template_fit_score",
            F.lit("; surface="), F.col("_surface.score"), F.lit("; visual="), "visual_reliability_score",
            F.lit("; viewport="), "viewport_scope_score"),
    })
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def apply_sendability(df, run_id="", order="row_idx"):
    """Canonicalise review rows and add every gate column."""
    df = ensure_columns(df, {"edited_line": "", "edit_notes": ""})
    return score_lines(canonicalize(df, run_id, order))


def rescored_rows(base, edits, keys, fields):
    """The rows of ``base`` that an edit names, with the edited fields and the gate run again over these rows alone."""
    changed = edits.select(*keys, *[F.col(f).alias(f"__{f}") for f in fields])
    edited = base.join(changed, keys).withColumns({f: F.coalesce(F.col(f"__{f}"), F.col(f)) for f in fields})
    return apply_sendability(edited.drop(*[f"__{f}" for f in fields], *GATE_COLUMNS))


def rescore_edits(base, edits, keys, fields):
    """Review edits replace the edited columns of matching rows; only those rows go through the gate again."""
    again = rescored_rows(base, edits, keys, fields)
    kept = base.join(edits.select(*keys), keys, "left_anti")
    return kept.unionByName(again.select(*[c for c in base.columns if c in again.columns]), allowMissingColumns=True)
