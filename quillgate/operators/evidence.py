"""Evidence facts: parsing, blocking, ranking, support, strength; attempts and variants."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import text as X
from quillgate.functions.json import parse_object
from quillgate.operators.rows import top_k

FACT_TEXT = [
    "fact", "why_it_matters", "source_url", "friction_type", "surface_checked",
    "conversion_outcome", "why_this_angle",
]
REPLY_SCHEMA = (
    "facts array<string>, possible_angles array<string>, needs_manual_review boolean, "
    "reviewer_notes array<string>"
)
FACT_SCHEMA = (
    "fact string, why_it_matters string, source_url string, strength string, "
    "too_generic_to_use boolean, friction_type string, surface_checked string, "
    "conversion_outcome string, angle_priority string, blog_used boolean, why_this_angle string"
)


def parse_facts(replies, key="lead_id", reply="reply"):
    """One row per fact object of a JSON reply; items that are no objects are skipped."""
    parsed = replies.select(key, parse_object(reply, REPLY_SCHEMA).alias("r"))
    items = parsed.select(key, F.posexplode("r.facts").alias("fact_pos", "item"))
    items = items.filter(F.ltrim("item").startswith("{"))
    f = F.from_json("item", FACT_SCHEMA)
    out = items.withColumn("f", f)
    return out.select(
        key, "fact_pos",
        *[X.clean(f"f.{c}").alias(c) for c in FACT_TEXT],
        F.lower(X.clean(F.coalesce("f.strength", F.lit("weak")))).alias("strength"),
        F.coalesce("f.too_generic_to_use", F.lit(True)).alias("too_generic_to_use"),
        F.coalesce(F.col("f.angle_priority").try_cast("int"), F.lit(0)).alias("angle_priority"),
        F.coalesce("f.blog_used", F.lit(False)).alias("blog_used"),
    )


def strong_fact_review(facts, key="lead_id"):
    """Leads without a strong, specific fact need review and get a note."""
    strong = F.bool_or((F.col("strength") == "strong") & ~F.col("too_generic_to_use"))
    return facts.groupBy(key).agg(
        F.count(F.lit(1)).alias("facts"), (~strong).alias("needs_manual_review")
    ).withColumn("reviewer_note", F.when(
        F.col("needs_manual_review"), "No strong, specific evidence found").otherwise(""))


def _texts(df):
    evidence = F.lower(F.concat_ws(" ", *[X.text(c) for c in [
        "fact", "why_it_matters", "surface_checked", "conversion_outcome", "why_this_angle"]]))
    combined = F.lower(F.concat_ws(" ", *[X.text(c) for c in [
        "fact", "why_it_matters", "friction_type", "surface_checked", "conversion_outcome",
        "why_this_angle"]]))
    df = df.withColumns({
        "_ev": evidence, "_all": combined, "_surf": F.lower(X.text("surface_checked")),
    })
    known = F.col("friction_type").isin(list(T.FRICTION_PRIORITY))
    return df.withColumns({
        "_known": known,
        "_visible": (known & (F.col("friction_type") != "other_specific_friction"))
        | X.has_any("_ev", T.FACT_FRICTION_TERMS),
        "_bug": X.has_any("_all", T.BUG_TERMS),
        "_cta": X.has_any("_all", T.CTA_TERMS),
        "_flow": X.has_any("_all", T.FLOW_TERMS),
        "_vis": visual_rank("_all"),
    })


def visual_rank(text):
    return (
        F.when(X.has_any(text, ["visual confidence: high", "high-confidence"]), 0)
        .when(X.has_any(text, ["visual confidence: medium", "medium-confidence"]), 1)
        .when(X.has_any(text, ["visual confidence: low", "low-confidence"]), 3)
        .otherwise(2)
    )


def _block_flags():
    ft = F.col("friction_type")
    outcome = (X.clean("conversion_outcome") != "") | X.has_any("_all", T.OUTCOME_TERMS + ["trust"])
    claim = X.has_any("_all", T.VISUAL_FACT_TERMS) | ft.isin(T.VISUAL_FRICTION)
    return [
        (F.col("too_generic_to_use"), "generic_evidence"),
        (F.col("blog_used") | ft.isin(T.DISALLOWED_FRICTION) | F.col("_surf").contains("blog"),
         "blog_angle_low_value"),
        (~F.col("_known"), "unsupported_friction_type"),
        (~F.col("_visible"), "missing_visible_friction"),
        (~outcome, "missing_outcome_tie"),
        (X.has_any("_all", T.POSITIVE_ONLY_TERMS) & ~F.col("_visible"), "positive_observation_only"),
        ((F.col("_vis") == 3) & claim, "low_confidence_visual_finding"),
    ]


BLOCK_REASONS = [
    "generic_evidence", "blog_angle_low_value", "unsupported_friction_type",
    "missing_visible_friction", "missing_outcome_tie", "positive_observation_only",
    "low_confidence_visual_finding",
]


def _bucket():
    ft = F.col("friction_type")
    return (
        F.when((ft == "broken_formatting") | F.col("_bug"), 0)
        .when(ft.isin(T.FLOW_FRICTION) | F.col("_flow"), 1)
        .when((ft == "low_visibility_cta") | F.col("_cta"), 2)
        .when(ft.isin(T.PROOF_FRICTION) | X.has_any("_all", T.PROOF_TERMS), 3)
        .when(ft.isin(T.POSITIONING_FRICTION) | X.has_any("_all", T.POSITIONING_TERMS), 4)
        .when((ft == "app_store_signal") & X.has_any("_all", T.APP_FIRST_TERMS), 1)
        .when(ft == "app_store_signal", 5)
        .otherwise(X.lookup(ft, T.FRICTION_PRIORITY, 99))
    )


def _surface_rank():
    s, ev = "_surf", "_ev"
    return (
        F.when(X.has_any(s, ["app onboarding", "signup", "checkout", "booking"])
               | X.has_any(ev, T.TOP_SURFACE_TERMS), 0)
        .when(X.has_any(s, ["app listing", "app-store", "google play"]), 1)
        .when(F.col(s).contains("mobile") | F.col(ev).contains("screenshot"), 2)
        .when(X.has_any(s, ["landing", "homepage", "website"]), 3)
        .when(X.has_any(s, ["case study", "testimonial"]), 4)
        .when(F.col(s).contains("blog"), 7)
        .otherwise(5)
    )


def score_facts(facts):
    """Block reasons and the rank keys of every fact."""
    df = _texts(facts)
    micro = X.has_any("_all", T.MICRO_UX_TERMS) & ~(F.col("_bug") | F.col("_cta") | F.col("_flow"))
    return df.withColumns({
        "block_reasons": X.flags(*_block_flags()),
        "angle_bucket": _bucket(),
        "micro_penalty": F.when(micro, 2).otherwise(0),
        "strength_rank": X.lookup("strength", {"strong": 0, "medium": 1, "weak": 2}, 3),
        "visual_rank": F.col("_vis"),
        "surface_rank": _surface_rank(),
        "explicit_priority": F.when(F.col("angle_priority") > 0, F.col("angle_priority")).otherwise(9),
        "fact_length": F.length("fact"),
    }).drop("_ev", "_all", "_surf", "_known", "_visible", "_bug", "_cta", "_flow", "_vis")


RANK_KEYS = [
    "angle_bucket", "micro_penalty", "strength_rank", "visual_rank", "surface_rank",
    "explicit_priority", "fact_length", "fact_pos",
]


def rank_allowed(scored, key="lead_id", k=3):
    """The k best unblocked facts per lead, rank 1 first."""
    allowed = scored.filter(F.size("block_reasons") == 0)
    return top_k(allowed, [key], [F.col(c) for c in RANK_KEYS], k)


def blocked_facts(scored):
    """All blocked facts with their reasons, one row each."""
    note = F.concat("fact", F.lit(" ["), F.array_join("block_reasons", ", "), F.lit("]"))
    return scored.filter(F.size("block_reasons") > 0).withColumn("blocked_note", note)


_FACT_FIELDS = [
    "fact_pos", "fact", "friction_type", "surface_checked", "conversion_outcome", "strength",
    "too_generic_to_use", "blog_used", "angle_priority", "why_this_angle",
]


def widen_top(ranked, key="lead_id", k=3):
    """Ranked facts as struct columns fact_1..fact_k, one row per lead."""
    fields = F.struct(*[c for c in _FACT_FIELDS if c in ranked.columns])
    return ranked.groupBy(key).agg(*[
        F.max_by(fields, F.when(F.col("rank") == i, F.lit(1))).alias(f"fact_{i}")
        for i in range(1, k + 1)
    ])


def select_angle(scored, key="lead_id"):
    """Chosen fact, decision label, flags and review switch per lead."""
    reasons = F.col("block_reasons")
    # first position at which each reason shows up gives the flag order
    firsts = [
        F.min(F.when(F.array_contains(reasons, r), F.col("fact_pos") * 10 + i)).alias(f"__r{i}")
        for i, r in enumerate(BLOCK_REASONS)
    ]
    allowed = F.size(reasons) == 0
    best = F.min_by(
        F.struct(*[c for c in _FACT_FIELDS if c in scored.columns]),
        F.when(allowed, F.struct(*RANK_KEYS)),
    )
    per_lead = scored.groupBy(key).agg(
        best.alias("selected"),
        F.count_if(allowed).alias("allowed_facts"),
        F.count_if(~allowed).alias("blocked_facts"),
        *firsts,
    )
    ordered = F.array_sort(F.array_compact(F.array(*[
        F.when(F.col(f"__r{i}").isNotNull(), F.struct(F.col(f"__r{i}").alias("p"), F.lit(r).alias("r")))
        for i, r in enumerate(BLOCK_REASONS)
    ])))
    none = F.col("allowed_facts") == 0
    chosen = X.flags(
        (F.col("selected.strength") != "strong", "selected_angle_not_strong"),
        (F.col("selected.friction_type") == "app_store_signal", "app_store_angle_review"),
    )
    blocked_flags = F.concat(F.transform(ordered, lambda x: x["r"]), F.array(F.lit("angle_gate_no_sendable_friction")))
    df = per_lead.withColumn("selection_flags", F.when(none, blocked_flags).otherwise(chosen))
    return df.withColumns({
        "decision": F.when(none, "manual_review_no_sendable_angle")
        .when(F.size("selection_flags") == 0, "selected_sendable_angle")
        .otherwise("selected_review_angle"),
        "needs_manual_review": none | (F.size("selection_flags") > 0),
    }).drop(*[f"__r{i}" for i in range(len(BLOCK_REASONS))])


def _matches(candidate, base, with_friction=True, excluded=None):
    c, b = F.col(candidate), F.col(base)
    hit = (c["conversion_outcome"] == b["conversion_outcome"]) | (c["surface_checked"] == b["surface_checked"])
    if with_friction:
        hit = hit | (c["friction_type"] == b["friction_type"])
    if excluded is not None:
        hit = hit & ~F.array_contains(excluded, c["friction_type"])
    return c.isNotNull() & hit


def support_fact(widened):
    """First other top fact that shares friction, outcome or surface with the chosen one."""
    support = F.when(_matches("fact_2", "fact_1"), F.col("fact_2")).when(
        _matches("fact_3", "fact_1"), F.col("fact_3"))
    return widened.withColumn("support", support)


def variant_support(widened, excluded="excluded_friction", k=3):
    """For each option its own fact and a support fact (outcome or surface match only),
    leaving out friction types that earlier options already used."""
    out = widened
    for i in range(1, k + 1):
        support = None
        for j in [j for j in range(1, k + 1) if j != i]:
            cond = _matches(f"fact_{j}", f"fact_{i}", False, F.col(excluded)) & F.col(f"fact_{i}").isNotNull()
            support = F.when(cond, F.col(f"fact_{j}")) if support is None else support.when(cond, F.col(f"fact_{j}"))
        out = out.withColumn(f"support_{i}", support)
    return out


def angle_text(fact):
    f = F.col(fact)
    return F.when(f.isNotNull(), X.strip(F.concat(
        f["friction_type"], F.lit(": "), f["fact"], F.lit(" Outcome: "), f["conversion_outcome"])))


def angle_texts(widened):
    """Angle text of the chosen and the support fact."""
    return widened.withColumns({
        "chosen_angle": angle_text("fact_1"), "support_angle": angle_text("support"),
    })


def _strength_points(f):
    return F.when(f["too_generic_to_use"], 0).when(f["strength"] == "strong", 2).when(
        f["strength"] == "medium", 1).otherwise(0)


def evidence_strength(facts, key="lead_id"):
    """0..5 strength of a lead's facts (0 only for leads without facts)."""
    points = (
        F.when(F.col("too_generic_to_use"), 0).when(F.col("strength") == "strong", 2)
        .when(F.col("strength") == "medium", 1).otherwise(0)
    )
    return facts.groupBy(key).agg(F.sum(points).alias("__points")).select(
        key, F.least(F.greatest(F.col("__points"), F.lit(1)), F.lit(5)).alias("evidence_strength_score"))


def gated_strength(supported):
    """Strength over the chosen fact and its support only."""
    total = _strength_points(F.col("fact_1")) + F.coalesce(_strength_points(F.col("support")), F.lit(0))
    return supported.withColumn("evidence_strength_score", F.when(
        F.col("fact_1").isNull(), 0).otherwise(F.least(F.greatest(total, F.lit(1)), F.lit(5))))


def top_evidence(facts, key="lead_id"):
    """The leading fact by priority, strength and blog use; specific facts go first."""
    order = F.struct(
        F.col("too_generic_to_use").cast("int"),
        F.when(F.col("angle_priority") == 0, 99).otherwise(F.col("angle_priority")),
        X.lookup("strength", {"strong": 0, "medium": 1, "weak": 2}, 3),
        F.col("blog_used").cast("int"),
        F.col("fact_pos"),
    )
    best = F.min_by(F.struct("fact_pos", "fact", "strength", "friction_type"), order)
    return facts.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def fact_text(fact, strength, generic, friction, surface, outcome, source):
    """One fact as text: fact (strength, specific, friction, surface, outcome, source: url)."""
    kind = F.when(generic, F.lit("generic")).otherwise(F.lit("specific"))
    detail = F.concat_ws(", ", *[F.nullif(c, F.lit("")) for c in (strength, kind, friction, surface, outcome)])
    return F.concat(fact, F.lit(" ("), detail, F.lit(", source: "), source, F.lit(")"))


def format_fact_rows(facts):
    return facts.withColumn("fact_text", fact_text(*[F.col(c) for c in [
        "fact", "strength", "too_generic_to_use", "friction_type", "surface_checked",
        "conversion_outcome", "source_url"]]))


def format_evidence(rows, facts="facts", out="evidence_points"):
    """Text of a whole evidence result; works on the row's own fact array."""
    parts = F.transform(facts, lambda f: X.strip(fact_text(
        f["fact"], f["strength"], f["too_generic_to_use"], f["friction_type"],
        f["surface_checked"], f["conversion_outcome"], f["source_url"])))
    return rows.withColumn(out, X.join_list(parts))


def pad_variants(ranked, key="lead_id", k=3):
    """k options per lead; missing options repeat the last allowed fact."""
    top = ranked.filter(F.col("rank") <= k)
    last = top.groupBy(key).agg(F.max("rank").alias("__n"))
    # the lowest-ranked fact also serves every option above its rank
    joined = top.join(last, key)
    upto = F.when(F.col("rank") == F.col("__n"), F.lit(k)).otherwise(F.col("rank"))
    return joined.withColumn("variant", F.explode(F.sequence(F.col("rank"), upto))).drop("__n")


def best_attempt(attempts, keys=("lead_id", "variant")):
    """Best attempt per variant: attempts stop at the first pass with score 8 or more;
    passing beats failing, then the higher score, then the earlier attempt.

    A stopping attempt always wins (nothing before it both passed and scored 8), so one
    partial aggregation is enough.
    """
    columns = [c for c in attempts.columns if c not in keys]
    row = F.struct(*columns)
    strong = F.col("passed") & (F.col("score") >= 8)
    stop = F.min_by(row, F.when(strong, F.col("iteration")))
    other = F.max_by(row, F.struct(F.col("passed").cast("int"), F.col("score"), -F.col("iteration")))
    best = attempts.groupBy(*keys).agg(stop.alias("__stop"), other.alias("__other"))
    best = best.withColumn("__b", F.coalesce("__stop", "__other"))
    return best.select(*keys, *[F.col(f"__b.`{c}`").alias(c) for c in columns])


def best_variant(variants, key="lead_id"):
    """Index of the best option of any number; options after the first score-10 pass without serious
    flags count as never written.  Needs one row per (lead, variant)."""
    stop = F.min(F.when(
        F.col("passed") & (F.col("score") >= 10) & ~F.col("serious"), F.col("variant")))
    options = variants.withColumn("__stop", stop.over(W.partitionBy(key)))  # the options of one lead
    written = F.col("__stop").isNull() | (F.col("variant") <= F.col("__stop"))
    best = F.min(F.when(written, F.struct(
        F.col("needs_review").cast("int").alias("review"), (-F.col("score")).alias("score"),
        F.col("serious").cast("int").alias("serious"), F.col("variant").cast("int").alias("variant"))))
    return options.groupBy(key).agg(F.coalesce(best["variant"], F.lit(0)).alias("best_variant"))


def widen_variants(variants, fields, key="lead_id", max_options=None):
    """Option columns <field>_option_1..k, one row per lead; k is the largest variant unless given."""
    if max_options is None:
        max_options = variants.agg(F.max("variant")).head()[0] or 0
    return variants.groupBy(key).agg(*[
        F.max(F.when(F.col("variant") == i, F.col(f))).alias(f"{f}_option_{i}")
        for i in range(1, max_options + 1) for f in fields
    ])
