"""Lead context: product surface, manual checks, previews, research rows."""

from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import text as X
from quillgate.functions import urls
from quillgate.operators.rows import ensure_columns, lookup_join

_SURFACE_TEXT = ["website_url", "optional_notes", "app_store_url", "app_flow_observation"]


def classify_surface(df, research=(), out="product_surface_type"):
    """Ordered rules over the lead's text: app, booking, commerce, B2B, lead generation.

    ``research`` names further text columns (summaries, source urls, checklist).
    """
    df = ensure_columns(df, _SURFACE_TEXT)
    text = F.lower(F.concat_ws(" ", *[X.text(c) for c in [*_SURFACE_TEXT, *research]]))
    df = df.withColumn("__text", text)
    app = (
        urls.netloc("website_url").endswith(".app")
        | (X.clean("app_store_url") != "")
        | X.has_any("__text", T.CLASSIFY_APP)
    )
    label = (
        F.when(app, "app_first_product")
        .when(X.has_any("__text", T.CLASSIFY_BOOKING), "marketplace_booking_flow")
        .when(X.has_any("__text", T.CLASSIFY_COMMERCE), "commerce_product_page")
        .when(X.has_any("__text", T.CLASSIFY_B2B), "b2b_service")
        .otherwise("website_first_leadgen")
    )
    return df.withColumn(out, label).drop("__text")


def research_priority(surface="product_surface_type"):
    return X.lookup(surface, T.RESEARCH_PRIORITY, T.RESEARCH_PRIORITY_DEFAULT)


def is_app_first(surface="product_surface_type"):
    return F.col(surface) == "app_first_product"


def looks_app_first(columns):
    """App-first by surface, .app host, store url or wording."""
    names = [c for c in [
        "website_url", "optional_notes", "app_store_url", "app_flow_observation",
        "app_store_summary", "surface_checked", "raw_research_summary",
    ] if c in columns]
    text = F.lower(F.concat_ws(" ", *[X.text(c) for c in names]))
    surface = is_app_first() if "product_surface_type" in columns else F.lit(False)
    store = X.clean("app_store_url") != "" if "app_store_url" in columns else F.lit(False)
    return (
        surface | urls.netloc("website_url").endswith(".app") | store
        | X.has_any(text, T.APP_FIRST_MARKERS)
    )


def friction_checklist(df, out="friction_checklist"):
    """Which kinds of supporting observations a lead already has."""
    fields = [
        "optional_notes", "linkedin_observation", "app_flow_observation", "recent_news_note",
        "recent_news_url", "competitor_context", "screenshot_url", "app_store_summary",
    ]
    df = ensure_columns(df, fields)
    combined = F.lower(F.concat_ws(" ", *[X.text(c) for c in [
        "optional_notes", "linkedin_observation", "app_flow_observation", "recent_news_note",
        "competitor_context", "app_store_summary"]]))
    df = df.withColumn("__notes", combined)
    has = lambda *cols: X.first_present(*cols) != ""
    found = X.flags(
        (has("linkedin_observation"), "manual LinkedIn observation provided"),
        (has("app_flow_observation"), "manual app/onboarding observation provided"),
        (has("screenshot_url"), "screenshot reference provided"),
        (has("app_store_summary"), "public app-store evidence found"),
        (has("recent_news_note", "recent_news_url"), "recent news/product note provided"),
        *[(F.col("__notes").rlike(pattern), label) for label, pattern in T.CHECKLIST_PATTERNS],
    )
    return df.withColumn(out, F.when(F.size(found) == 0, X.lits([T.CHECKLIST_EMPTY])).otherwise(found)).drop("__notes")


def manual_check(df):
    """App-check status and the joined manual-check notes."""
    df = ensure_columns(df, [
        "quality_flags", "visual_confidence", "friction_type", "surface_checked",
        "evidence_points", "app_flow_observation",
    ])
    flags_text = F.lower(X.text("quality_flags"))
    friction = F.lower(X.text("friction_type"))
    walk = looks_app_first(df.columns) & (X.clean("app_flow_observation") == "")
    df = df.withColumn("__walk", walk)
    notes = X.flags(
        (F.col("__walk"), T.NOTE_APP_WALK),
        (flags_text.contains("low_confidence_visual_finding") | (F.lower(X.text("visual_confidence")) == "low"), T.NOTE_VISUAL),
        (flags_text.contains("evidence_failed") | flags_text.contains("research_failed")
         | (X.clean("evidence_points") == ""), T.NOTE_FIND_ISSUE),
        (friction.isin(T.PROOF_FRICTION), T.NOTE_PROOF),
        (friction.isin(T.POSITIONING_FRICTION), T.NOTE_POSITIONING),
        (F.lower(X.text("surface_checked")).contains("app listing") | flags_text.contains("app_store_angle_review"),
         T.NOTE_APP_LISTING),
    )
    return df.withColumns({
        "app_check_status": F.when(F.col("__walk"), "app walkthrough recommended").otherwise("not required"),
        "recommended_manual_check": F.array_join(F.array_distinct(notes), " "),
    }).drop("__walk")


def first_name(name):
    return F.when(X.clean(name) == "", F.lit("[Name]")).otherwise(X.first_word(name))


def next_sentence(company="company_name", role="recipient_role"):
    company, role = X.clean(company), X.clean(role)
    return (
        F.when((company != "") & (role != ""), F.concat(
            F.lit("Curious where "), company, F.lit(" is seeing the biggest drop-off from a "), role, F.lit(" perspective.")))
        .when(company != "", F.concat(
            F.lit("Curious what's top of mind at "), company, F.lit(" when it comes to user drop-off and conversion.")))
        .when(role != "", F.lit("Curious where teams are seeing the biggest friction or drop-off for users right now."))
        .otherwise(F.lit(T.PITCH_SENTENCE))
    )


def template_preview(line="opening_line", name="recipient_name", context="campaign_context"):
    """Greeting, line and next sentence; blank for rows without a usable line."""
    opener = X.clean(line)
    follow = X.first_present(context, next_sentence())
    full = F.concat(F.lit("Hey "), first_name(name), F.lit("\n\n"), opener, F.lit("\n\n"), follow)
    return F.when((opener == "") | opener.startswith("["), F.lit("")).otherwise(full)


def row_status(line="personalized_line"):
    t = X.clean(line)
    return (
        F.when((t == "") | t.startswith("["), "Research only")
        .when(F.lower(X.text("quality_flags")).contains("ai_generation_unavailable"), "Research only")
        .when(X.loose_bool("needs_manual_review"), "Review")
        .otherwise("Ready")
    )


def placeholder_rows(leads, note):
    """Rows of leads that are not processed: flag, joined errors and note."""
    return leads.withColumns({
        "quality_flags": F.lit("manual_review"),
        "reviewer_notes": X.join_list(F.concat(F.col("validation_errors"), F.array(F.lit(note)))),
        "send_confidence": F.lit("review"),
        "needs_manual_review": F.lit(True),
    })


def route_rows(leads, processed, note, order="row_idx"):
    """Processed rows of the valid leads plus placeholder rows of the invalid ones."""
    invalid = placeholder_rows(leads.filter(~F.col("is_valid")), note)
    done = processed.withColumn("row_kind", F.lit("processed"))
    return done.unionByName(invalid.withColumn("row_kind", F.lit("placeholder")), allowMissingColumns=True)


def attach_research(leads, summaries, chosen=None, key="company_key"):
    """Research summary, surface and chosen fact beside each lead; status of missing parts.

    Without ``chosen`` the leads already carry their ``selected`` fact.
    """
    df = lookup_join(leads, summaries, [key])
    if chosen is not None:
        df = lookup_join(df, chosen, [key])
    df = classify_surface(df, research=["summary", "source_urls"])
    df = df.withColumn("research_priority", research_priority())
    headline = F.concat(
        F.lit("Product surface type: "), "product_surface_type", F.lit(". Research priority: "), "research_priority")
    missing_research, missing_fact = F.col("summary").isNull(), F.col("selected").isNull()
    return df.withColumns({
        "raw_research_summary": X.join_present(headline, "summary"),
        "friction_type": X.text("selected.friction_type"),
        "surface_checked": X.text("selected.surface_checked"),
        "conversion_outcome": X.text("selected.conversion_outcome"),
        "row_state": F.when(missing_research, "research_failed").when(missing_fact, "evidence_failed").otherwise("ready"),
        "quality_flags": X.join_present(
            F.when(missing_research, F.lit("research_failed")).when(missing_fact, F.lit("evidence_failed")),
            F.when(~missing_research & ~missing_fact & F.col("selected.blog_used"), F.lit("blog_angle_low_value"))),
    })


def research_only_rows(df):
    """Research-only output: ordered evidence parts, fixed flags and notes.

    Needs first_pages_text (excerpts of up to two pages, spaced-bar joined), summary and
    the optional review, app-store, visual and validator columns.
    """
    cols = [
        "app_review_complaints", "app_review_themes", "app_store_summary", "visual_observations",
        "visual_confidence", "visual_confidence_score", "visual_confidence_reasons",
        "screenshot_paths", "ux_validator_findings", "dead_link_checks", "visual_quality_flags",
        "first_pages_text", "summary", "reviewer_notes",
    ]
    df = ensure_columns(df, cols)
    app = is_app_first()

    def part(prefix, *names):
        value = X.join_present(*names)
        return F.when(X.first_present(*names) != "", F.concat(F.lit(prefix), value))

    visual = F.when(X.clean("visual_observations") != "", F.concat(
        F.lit("Visual review evidence: "), "visual_observations",
        F.lit(" Visual confidence: "), X.first_present("visual_confidence", F.lit("none")),
        F.lit(" ("), X.text("visual_confidence_score"), F.lit("/100). "), X.text("visual_confidence_reasons"),
        F.lit(" Screenshot paths: "), X.text("screenshot_paths")))
    validator = F.when(X.first_present("ux_validator_findings", "dead_link_checks") != "", F.concat(
        F.lit("Internal UX validator evidence, do not copy technical wording directly: "), X.text("ux_validator_findings"),
        F.when(X.clean("dead_link_checks") != "", F.concat(F.lit(" Dead link checks: "), "dead_link_checks")).otherwise("")))
    evidence = X.join_present(
        part("Public review complaint signals: ", "app_review_complaints"),
        part("Public review theme clusters: ", "app_review_themes"),
        F.when(app, F.concat(F.lit("Research priority: "), "research_priority")),
        "first_pages_text", X.text("app_store_summary"), visual, validator,
    )
    return df.withColumns({
        "evidence_points": evidence,
        "raw_research_summary": F.when(app, X.join_present(F.concat(
            F.lit("Product surface type: "), "product_surface_type",
            F.lit(". Research priority: "), "research_priority"), "summary")).otherwise(X.text("summary")),
        "quality_flags": X.join_present(
            F.lit("offline_research_only"), F.lit("ai_generation_unavailable"), "visual_quality_flags"),
        "send_confidence": F.lit("review"),
        "needs_manual_review": F.lit(True),
        "reviewer_notes": X.join_present("reviewer_notes", F.lit(T.NOTE_RESEARCH_ONLY)),
    })


# label -> column of the research context text, in output order
CONTEXT_SECTIONS = [
    ("LinkedIn observation supplied by reviewer: ", "linkedin_observation"),
    ("LinkedIn source note: ", "linkedin_source_note"),
    ("Public app-store or app listing evidence: ", "app_store_summary"),
    ("Public review theme clusters: ", "app_review_themes"),
    ("Manual app/onboarding observation supplied by reviewer: ", "app_flow_observation"),
    ("App/onboarding source note: ", "app_flow_source_note"),
    ("Screenshot reference supplied by reviewer: ", "screenshot_url"),
    ("Recent news or product update note: ", "recent_news_note"),
    ("Recent news or product update URL: ", "recent_news_url"),
    ("Competitor/context note supplied by reviewer: ", "competitor_context"),
    ("Friction checklist: ", "friction_checklist"),
    ("Public review complaint signals: ", "app_review_complaints"),
]


def context_text(df, out="research_context"):
    """Labelled research context, one line per section that has text."""
    df = ensure_columns(df, [c for _, c in CONTEXT_SECTIONS])
    types = dict(df.dtypes)

    def value(c):
        return X.join_list(c) if types[c].startswith("array") else X.text(c)

    return df.withColumn(out, F.concat_ws("\n", *[
        F.when(value(c) != "", F.concat(F.lit(label), value(c))) for label, c in CONTEXT_SECTIONS]))
