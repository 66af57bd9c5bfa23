"""Copy guardrails: draft clean-up, grounding, own flags, QC merge, review rule."""

from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import text as X
from quillgate.functions import urls
from quillgate.functions.stats import clamp
from quillgate.operators.gates import deliverability

_EDGE_L, _EDGE_R = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"


def remove_download_claims(c):
    out = X.text(c)
    for pattern, replacement in T.DOWNLOAD_REWRITES:
        out = F.regexp_replace(out, "(?iU)" + pattern, replacement)
    return out


def has_download_claim(c, lowered=None):
    """Does the text say that something was downloaded or installed?  ``lowered`` names a column that holds it in lower case."""
    low = F.lower(X.text(c)) if lowered is None else F.col(lowered)
    return X.any_of([low.contains(h) for h in T.DOWNLOAD_HINTS]) & X.text(c).rlike("(?iU)" + T.DOWNLOAD_CLAIM)


def brands(company, website):
    """(longer brand, shorter brand): company name and host stem, null where unusable."""
    name = X.collapse(company)
    raw_host = F.regexp_extract(X.text(website), r"^https?://([^/?#]*)", 1)
    stem = F.split_part(F.replace(raw_host, F.lit("www."), F.lit("")), F.lit("."), F.lit(1))

    def usable(c):
        return F.when((F.length(c) >= 3) & ~F.lower(c).isin(T.BRAND_EXCLUDED), c)

    name, stem = usable(name), usable(stem)
    stem = F.when(name.isNull() | (F.lower(stem) != F.lower(name)), stem)
    stem_first = F.coalesce(F.length(stem), F.lit(0)) > F.coalesce(F.length(name), F.lit(0))
    return F.when(stem_first, stem).otherwise(name), F.when(stem_first, name).otherwise(stem)


def _brand_core(brand):
    return F.replace(F.lower(brand), F.lit("\\e"), F.lit(""))


def _plain(c):
    return F.octet_length(c) == F.length(c)


def _mentions(t, low, brand):
    """False only where the text surely has no mention: a mention in ASCII letters is in its lower-case form too."""
    core = _brand_core(brand)
    return ~(_plain(t) & _plain(core)) | low.contains(core)


def _brand_pattern(brand, fold=True):
    quoted = F.concat(F.lit("\\Q"), _brand_core(brand), F.lit("\\E"))
    return F.concat(F.lit(("(?iu)" if fold else "") + _EDGE_L), quoted, F.lit(_EDGE_R))


def replace_brand_casing(c, company, website, lower=False):
    """Whole-token brand mentions get the lead's own casing (or lower case)."""
    out = X.text(c)
    for brand in brands(company, website):
        wanted = F.lower(brand) if lower else brand
        safe = F.regexp_replace(wanted, r"([\\$])", r"\\$1")
        out = F.when(brand.isNull(), out).otherwise(F.regexp_replace(out, _brand_pattern(brand), safe))
    return out


def has_non_lowercase_brand(c, company, website, lowered=None):
    """A brand mention that is not written in lower case.  ``lowered`` names a column that holds the text in lower case."""
    t = X.text(c)
    low = F.lower(t) if lowered is None else F.col(lowered)
    hits = []
    for brand in brands(company, website):
        # dropping the all-lower mentions leaves exactly the mentions with upper case, if there is any mention
        rest = F.regexp_replace(t, _brand_pattern(brand, fold=False), F.lit("\x00"))
        mentioned = _mentions(t, low, brand) & F.regexp_like(t, _brand_pattern(brand))
        hits.append(F.coalesce(mentioned & F.regexp_like(rest, _brand_pattern(brand)), F.lit(False)))
    return X.any_of(hits)


def sanitize_draft(df, company="company_name", website="website_url", lower=False):
    """Download claims and brand casing repaired in the draft's text fields."""
    def fix(c, claims=True):
        t = remove_download_claims(c) if claims else X.text(c)
        return X.strip(replace_brand_casing(t, company, website, lower))

    used = F.transform(
        F.filter("evidence_used_for_copy", lambda e: X.clean(e) != ""),
        lambda e: fix(e, claims=False),
    )
    return df.withColumns({
        "opening_line": fix("opening_line"),
        "tailored_insight": fix("tailored_insight"),
        "chosen_angle": fix("chosen_angle", claims=False),
        "evidence_used_for_copy": used,
    })


def _overlap_below(claim, evidence, limit):
    n = F.size(claim)
    shared = F.size(F.array_intersect(claim, evidence))
    return (n > 0) & (shared.cast("double") / n < limit)


def grounding(df, line="opening_line", used="used_text", evidence="evidence_text", out="grounding_flags"):
    """Keyword overlap of the claimed text with the evidence text."""
    df = df.withColumns({
        "__kev": X.keywords(evidence), "__kline": X.keywords(line), "__kused": X.keywords(used),
    })
    none = F.size("__kev") == 0
    found = X.flags(
        (none, "missing_grounding_evidence"),
        (~none & _overlap_below(F.col("__kused"), F.col("__kev"), 0.2), "evidence_used_not_in_extracted_facts"),
        (~none & _overlap_below(F.col("__kline"), F.col("__kev"), 0.18), "line_not_grounded_in_evidence"),
    )
    return df.withColumn(out, found).drop("__kev", "__kline", "__kused")


def copy_flags(df, out="copy_flags", has_evidence=True):
    """Own flags of a draft, followed by deliverability and grounding flags.

    Needs opening_line, tailored_insight, used_text (joined evidence items), company_name,
    website_url and, with evidence, evidence_text and app_evidence_text.
    """
    df = df.withColumns({
        "__text": F.concat_ws(" ", X.text("opening_line"), X.text("tailored_insight")),
        "__line": F.lower(X.text("opening_line")),
    })
    df = df.withColumn("__low", F.lower("__text"))
    line, has_line = F.col("__line"), X.text("opening_line") != ""
    friction = X.has_any("__line", T.COPY_FRICTION_TERMS)
    own = X.flags(
        (F.col("__text").contains("—"), "em_dash"),
        (X.has_any("__low", T.FILLER_WORDS), "generic_praise"),
        (line.contains("blog") | line.contains("article"), "blog_angle_low_value"),
        (X.more_words("opening_line", 40, slash_splits=False), "opening_line_too_long"),
        (X.clean("used_text") == "", "missing_evidence_used_for_copy"),
        (has_download_claim("__text", "__low"), "download_claim"),
        (has_non_lowercase_brand("opening_line", F.col("company_name"), F.col("website_url"), "__line"),
         "company_name_not_lowercase"),
        (has_line & ~X.starts_any("__line", T.TEMPLATE_STARTS), "missing_conversational_template_open"),
        (has_line & ~X.has_any("__line", T.OUTCOME_TERMS + ["complete"]), "missing_specific_dropoff_hypothesis"),
        (X.has_any("__line", T.ABSTRACT_PHRASES) & ~friction, "too_abstract"),
        (X.has_any("__line", T.POSITIVE_OBSERVATION_TERMS) & ~friction, "missing_visible_friction"),
        (X.has_any("__line", T.TECHNICAL_TERMS), "technical_audit_language"),
    )
    parts = [own, deliverability("opening_line")]
    if has_evidence:
        df = grounding(df, out="__grounding")
        app = X.has_any(F.lower(X.text("app_evidence_text")), T.APP_EVIDENCE_TERMS)
        wrong = app & (line.contains("website") | line.contains("blog")) & ~line.contains("app")
        parts += [F.col("__grounding"), X.flags((wrong, "wrong_surface"))]
    return df.withColumn(out, F.array_distinct(F.concat(*parts))).drop(
        "__text", "__line", "__low", "__grounding")


def merge_qc(df, model_flags="model_flags", own_flags="copy_flags"):
    """Model and own flags merged; blocking flags fail the draft and cap its score at 7."""
    merged = F.array_distinct(F.concat(model_flags, own_flags))
    raw = F.coalesce(F.col("model_score").cast("int"), F.lit(0))
    df = df.withColumns({"qc_flags": merged, "__raw": raw})
    blocked = X.overlaps(F.col("qc_flags"), T.BLOCKING_QC_FLAGS)
    score = F.when(blocked, F.least("__raw", F.lit(7))).otherwise(F.col("__raw"))
    passed = ~blocked & F.coalesce(F.col("model_pass"), F.lit(False)) & (F.col("__raw") >= 8)
    return df.withColumns({"qc_score": clamp(score, 0, 10), "qc_passed": passed}).drop("__raw")


def needs_review(df, carried=("research_review", "evidence_review", "selection_review"),
                 all_flags="all_flags", out="needs_review"):
    """Anything upstream asked for review, QC is short of a pass, or a serious flag is set."""
    upstream = X.any_of([F.coalesce(F.col(c), F.lit(False)) for c in carried])
    serious = X.overlaps(F.col(all_flags), T.SERIOUS_FLAGS)
    return df.withColumn(out, upstream | ~F.col("qc_passed") | (F.col("qc_score") < 8) | serious)


def send_confidence():
    """'send' only without review and with enough evidence strength."""
    return F.when(
        ~F.col("needs_review") & (F.col("evidence_strength_score") >= 3), "send"
    ).otherwise("review")
