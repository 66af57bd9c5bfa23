"""Queries over message lines: gates, evaluation, labels, delivery, privacy, reports."""

from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import json as J
from quillgate.functions import redact
from quillgate.functions import text as X
from quillgate.operators import canonical, copyguard, delivery, evals, gates, outreach, prompts, reports
from quillgate.operators.order import stored
from quillgate.plans import views as V
from quillgate.plans.registry import (
    SQL, any_sql, dedupe_sql, flags_sql, items, join_sql, pct_sql, q, query, starts_sql, with_,
)

WS = V.WS_CLASS_SQL


def _pts(cond, n):
    return f"(case when {cond} then {n} else 0 end)"


def _has(*names):
    return f"list_has_any(fl, {items(names)})"


SPLIT_FLAGS = (
    "list_distinct(list_filter(list_transform(string_split_regex(lower({c}), '[\\n;,|]'), "
    "lambda x: trim(x)), lambda x: x <> ''))"
)
_EV = (
    f"50 + {_pts('src', 20)} + {_pts('shot', 10)} + case vc when 'high' then 15 when 'medium' then 8 when 'low' then -8 else 0 end"
    f" - {_pts(_has('weak_evidence', 'thin_content'), 15)} - {_pts(_has('unsupported_claims', 'unsupported_claim'), 35)}"
)
_COPY = (
    f"100 - {_pts('bad', 60)} - {_pts('dash', 35)} - case when words > 42 then 20 when words > 35 then 10 else 0 end"
    f" - {_pts('rigid', 10)} - {_pts(_has('genericness', 'generic', 'too_generic'), 15)}"
    f" - {_pts(_has('technical_audit_language'), 15)} - {_pts(_has('hallucination'), 45)} - {_pts('html', 45)} - {_pts('spam', 15)}"
)
_SURF_KEYS = [
    ("ps = ''", "Unknown", 65, "'product_surface_type_missing'"),
    ("ps = 'app_first_product' and site_line", "Wrong", 25, "'app_first_product_but_line_uses_website_or_blog_surface'"),
    ("ps = 'app_first_product' and app_all", "Correct", 95, "''"),
    ("ps = 'app_first_product'", "Review", 60, "'app_first_product_without_clear_app_surface'"),
    ("ps = 'marketplace_booking_flow' and book_all", "Correct", 95, "''"),
    ("ps = 'marketplace_booking_flow'", "Review", 62, "'booking_flow_without_booking_surface'"),
    ("ps = 'commerce_product_page' and shop_all", "Correct", 92, "''"),
    ("ps = 'commerce_product_page'", "Review", 62, "'commerce_product_without_checkout_or_product_page_surface'"),
    ("ps = 'b2b_service' and web_all", "Correct", 88, "''"),
    ("ps = 'b2b_service'", "Review", 65, "'b2b_service_surface_unclear'"),
    ("ps = 'website_first_leadgen' and web_all", "Correct", 90, "''"),
    ("ps = 'website_first_leadgen' and app_line", "Review", 55, "'website_first_leadgen_but_line_uses_app_surface'"),
    ("ps = 'website_first_leadgen'", "Review", 65, "'website_first_surface_unclear'"),
]


def _surf(part, other):
    pos = {"label": 1, "score": 2, "reason": 3}[part]
    value = lambda row: q(row[pos]) if part == "label" else str(row[pos])
    return "case " + " ".join(f"when {r[0]} then {value(r)}" for r in _SURF_KEYS) + f" else {other} end"


GATES = V.LINES + f""",
g0 as (
  select *, lower(personalized_line) as low, lower(visual_confidence) as vc, lower(product_surface_type) as ps,
    {SPLIT_FLAGS.format(c='quality_flags')} as fl, source_urls <> '' as src, shareable_screenshots <> '' as shot,
    lower(concat_ws(' ', shareable_screenshots, '', '', '', ux_validator_findings, '')) as blob,
    lower(concat_ws(' ', trace_files, shareable_screenshots, '', ux_validator_findings, '')) as debug,
    lower(concat_ws(' ', personalized_line, {V.strip_sql('evidence_found')}, surface_checked, research_priority)) as comb,
    case when {V.strip_sql("replace(personalized_line, '/', ' ')")} = '' then 0
      else len(string_split_regex({V.strip_sql("replace(personalized_line, '/', ' ')")}, '{WS}+')) end as words
  from lines
),
g1 as (
  select *, personalized_line = '' as noline, personalized_line = '' or personalized_line like '[%' as bad,
    contains(personalized_line, '—') or contains(personalized_line, '–') as dash,
    personalized_line <> '' and not {starts_sql('low', T.CONVERSATIONAL_STARTS)} as rigid,
    not {starts_sql('low', T.CONVERSATIONAL_STARTS)} as stiff,
    regexp_matches(personalized_line, '<[^>\\n]+>') as html, {any_sql('low', T.SPAM_PHRASES)} as spam,
    {any_sql('low', T.OUTCOME_TERMS)} as out_line, {any_sql("low || ' ' || lower(conversion_outcome)", T.OUTCOME_TERMS)} as out_all,
    {any_sql('low', T.VISUAL_CLAIM_TERMS)} as vis_line, {any_sql('blob', T.VISUAL_CLAIM_TERMS)} as vis_blob,
    contains(blob, 'mobile') as mob, contains(blob, 'desktop') as desk,
    {any_sql('low', T.WEBSITE_LINE_TERMS)} and not contains(low, 'app') as site_line,
    {any_sql('comb', T.APP_SURFACE_TERMS)} as app_all, {any_sql('low', T.APP_SURFACE_TERMS)} as app_line,
    {any_sql('comb', T.BOOKING_TERMS)} as book_all, {any_sql('comb', T.COMMERCE_TERMS)} as shop_all,
    {any_sql('comb', T.B2B_TERMS + T.WEBSITE_SURFACE_TERMS)} as web_all, {V.strip_sql('evidence_found')} = '' as noev
  from g0
),
g2 as (
  select *, case when noev then 0 else greatest(0, least(100, {_EV})) end as ev, greatest(0, least(100, {_COPY})) as cp,
    case when noline then 0 when out_all then 100 else 55 end as oc,
    case when bad then 0 else greatest(0, 100 - {_pts('stiff', 15)} - {_pts('words > 35', 12)} - {_pts('not out_line', 18)}
      - {_pts("personalized_line like '%?'", 8)}) end as tp,
    vis_line as claim, vis_line or vis_blob as vclaim,
    {_surf('label', "'Review'")} as s_label, {_surf('score', '60')} as s_score,
    {_surf('reason', "'unknown_product_surface_type:' || ps")} as s_reason
  from g1
),
g3 as (
  select *, case when not claim then 80 else greatest(0, case vc when 'high' then 95 when 'medium' then 78 when 'low' then 45
      when 'none' then 35 when '' then 35 else 50 end - {_pts('not shot', 15)}) end as vs,
    case when not vclaim then 'not_required' when mob and desk then 'mobile_and_desktop' when mob then 'mobile_only'
      when desk then 'desktop_only' else 'unknown' end as vp,
    case when not vclaim then 80 when mob and desk then 95 when mob then 72 when desk then 65 else 35 end as vps,
    {flags_sql(('vclaim and mob and not desk', 'visual_claim_only_confirmed_on_mobile'),
               ('vclaim and not mob and desk', 'visual_claim_only_confirmed_on_desktop'),
               ('vclaim and not mob and not desk', 'visual_claim_without_viewport_scope'))} as vpr
  from g2
),
g4 as (
  select *, {flags_sql(("lower(status) = 'research only' or " + _has('research_only'), 'research_only'))}
      || list_sort(list_intersect(fl, {items(T.SEVERE_FLAGS)}))
      || {flags_sql(('noev', 'missing_evidence'), ('not noev and ' + _has('unsupported_claims', 'unsupported_claim'), 'unsupported_claim'),
                    ('not noev and ev < 60', 'evidence_below_send_threshold'), ('bad', 'no_sendable_personalized_line'),
                    ('dash', 'dash_character_in_line'), (_has('hallucination'), 'hallucination'), ('html', 'html_in_personalization_line'),
                    ("s_label = 'Wrong'", 'app_first_product_but_line_uses_website_or_blog_surface'))} as hard0,
    {flags_sql(("needs_manual_review = 'yes'", 'marked_for_manual_review'))}
      || list_sort(list_intersect(fl, {items(T.EDIT_FLAGS)}))
      || {flags_sql(('not noev and not src', 'source_url_missing'), ("not noev and vc = 'low'", 'low_visual_confidence'),
                    ('not noev and ' + _has('weak_evidence', 'thin_content'), 'weak_evidence'), ('words > 42', 'far_too_long'),
                    ('words > 35 and words <= 42', 'slightly_too_long'), ('rigid', 'missing_conversational_opening'),
                    (_has('genericness', 'generic', 'too_generic'), 'too_generic'), (_has('technical_audit_language'), 'technical_audit_language'),
                    ('spam', 'spam_trigger_language'), ('noline', 'missing_line'),
                    ('not noline and not out_all', 'missing_activation_conversion_or_dropoff_outcome'), ('bad', 'missing_line'),
                    ('not bad and stiff', 'missing_conversational_opening'), ('not bad and words > 35', 'template_line_too_long'),
                    ('not bad and not out_line', 'pitch_bridge_unclear'),
                    ("not bad and personalized_line like '%?'", 'question_opening_may_break_template_flow'),
                    ('claim and not shot', 'visual_claim_without_shareable_screenshot'),
                    ("claim and vc in ('', 'none', 'low')", 'visual_claim_needs_manual_check'))}
      || vpr || list_filter([s_reason], lambda x: x <> '') as soft0
  from g3
),
g5 as (select *, {dedupe_sql('hard0')} as hard, list_filter({dedupe_sql('soft0')}, lambda x: not list_contains(hard0, x)) as soft from g4),
g6 as (
  select *, round_even(ev * 0.25::double + cp * 0.22::double + oc * 0.16::double + tp * 0.14::double + s_score * 0.16::double
    + vs * 0.04::double + vps * 0.03::double, 0)::int as w0 from g5
),
g7 as (select *, case when noline then least(w0, 20) else w0 end as w1 from g6),
g8 as (select *, greatest(0, least(100, case when len(hard) > 0 then least(w1, 59) when len(soft) > 0 then least(w1, 84) else w1 end)) as score from g7),
gates as materialized (
  select *, case when len(hard) > 0 then 'Reject' when len(soft) > 0 or score < 85 then 'Edit' else 'Send' end as decision,
    {flags_sql(("trace_files <> ''", 'trace_files_internal_only'),
               ("contains(debug, 'c:\\users\\') or contains(debug, '/users/')", 'local_paths_need_sanitizing'),
               (any_sql('debug', ['headers', 'cookie', 'authorization']), 'possible_sensitive_debug_metadata'))} as priv
  from g8
)"""


def scored(spark, sf_dir):
    return gates.apply_sendability(V.lines(spark, sf_dir))


_VERDICTS = f"""
select row_idx, decision as sendability_decision, cast(score as bigint) as sendability_score,
  {join_sql('hard || soft')} as sendability_reasons, {join_sql('hard')} as hard_fail_reasons, {join_sql('soft')} as soft_edit_reasons,
  'evidence=' || ev || '; copy=' || cp || '; outcome=' || oc || '; template=' || tp || '; surface=' || s_score
    || '; visual=' || vs || '; viewport=' || vps as sendability_dimensions from gates"""


@query("gate_sendability", with_(GATES, select=_VERDICTS))
def gate_sendability(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "row_idx", "sendability_decision", F.col("sendability_score").cast("bigint").alias("sendability_score"),
        "sendability_reasons", "hard_fail_reasons", "soft_edit_reasons", "sendability_dimensions")


#: The name under which whole texts were judged first; lines are whole texts everywhere now.
query("gate_sendability_whole", with_(GATES, select=_VERDICTS))(gate_sendability)


@query("gate_scores", with_(GATES, select=f"""
select row_idx, cast(ev as bigint) as evidence_score, cast(cp as bigint) as copy_quality_score, cast(oc as bigint) as outcome_alignment_score,
  cast(tp as bigint) as template_fit_score, cast(vs as bigint) as visual_reliability_score, vp as viewport_scope,
  cast(vps as bigint) as viewport_scope_score, {join_sql('vpr')} as viewport_scope_reasons,
  case when src and shot then 'source_and_screenshot' when src then 'source_only' when shot then 'screenshot_only'
    when trace_files <> '' then 'trace_only_internal' else 'thin_or_missing' end as evidence_scope from gates"""))
def gate_scores(spark, sf_dir):
    ints = ["evidence_score", "copy_quality_score", "outcome_alignment_score", "template_fit_score",
            "visual_reliability_score", "viewport_scope_score"]
    return scored(spark, sf_dir).select(
        "row_idx", *[F.col(c).cast("bigint").alias(c) for c in ints], "viewport_scope", "viewport_scope_reasons", "evidence_scope")


@query("gate_surface", with_(GATES, select="""
select s_label as surface_correctness, product_surface_type, s_reason as surface_correctness_reasons,
  count(*) as rows, cast(sum(s_score) as bigint) as score_sum from gates group by all"""))
def gate_surface(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("surface_correctness", "product_surface_type", "surface_correctness_reasons").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("surface_correctness_score").alias("score_sum"))


@query("gate_privacy", with_(GATES, select=f"""
select row_idx, {join_sql('priv')} as privacy_flags,
  case when len(priv) > 0 then 'client_safe_export_required' else 'client_safe' end as client_safe_asset_status from gates"""))
def gate_privacy(spark, sf_dir):
    return scored(spark, sf_dir).select("row_idx", "privacy_flags", "client_safe_asset_status")


@query("flag_deliverability", with_(V.LINES, select=f"""
select row_idx, {join_sql(flags_sql(("regexp_matches(x, '<[^>\\n]+>')", 'html_in_personalization_line'),
                                    (any_sql('lower(x)', T.SPAM_PHRASES), 'spam_trigger_language')))} as flags
from (select row_idx, personalized_line || ' ' || text as x from lines)"""))
def flag_deliverability(spark, sf_dir):
    df = V.lines(spark, sf_dir).select("row_idx", F.concat_ws(" ", "personalized_line", "text").alias("x"))
    return df.select("row_idx", X.join_list(gates.deliverability("x")).alias("flags"))


# --- canonical rows --------------------------------------------------------------------------
def _stable(*cols):
    parts = ", ".join(f"nullif(lower({c}), '')" for c in cols)
    return f"left(sha256(concat_ws(chr(10), {parts})), 16)"


@query("canonical_rows", with_(V.LINES, select=f"""
select row_idx, row_id, run_id, {_stable('run_id', 'row_id', 'company', 'person', 'website', 'model_line')} as example_id,
  model_line as model_opening_line, personalized_line as current_opening_line,
  case when human_decision in ('send', 'edit') and edited_line <> '' then edited_line else personalized_line end as final_delivery_line,
  human_decision, edit_reason_category, status, run_id as origin_run_id, 'run_output' as source_kind
from (select * replace ({V.strip_sql('personalized_line')} as personalized_line, {V.strip_sql('edited_line')} as edited_line),
  coalesce(nullif(model_opening_line, ''), {V.strip_sql('personalized_line')}) as model_line from lines)"""))
def canonical_rows(spark, sf_dir):
    return canonical.flatten_evidence(canonical.nest_evidence(canonical.canonicalize(V.lines(spark, sf_dir)))).select(
        "row_idx", "row_id", "run_id", "example_id", "model_opening_line", "current_opening_line", "final_delivery_line",
        "human_decision", "edit_reason_category", "status", "origin_run_id", "source_kind")


@query("line_provenance", with_(V.LINES, select=f"""
select row_idx, m as model_opening_line, c as current_opening_line,
  case when human_decision in ('send', 'edit') and {V.strip_sql('edited_line')} <> '' then edited_line else c end as final_delivery_line,
  {_stable('run_id', 'row_id', 'company', 'person', 'website', V.strip_sql('m'))} as example_id
from (select *, case when (select bool_or({V.strip_sql('personalized_line')} <> '') from lines) then personalized_line else '' end as c,
  case when model_opening_line <> '' then model_opening_line else personalized_line end as m from lines)"""))
def line_provenance(spark, sf_dir):
    return canonical.line_provenance(V.lines(spark, sf_dir)).select(
        "row_idx", "model_opening_line", "current_opening_line", "final_delivery_line", "example_id")


@query("split_flags", with_(V.LINES, select=f"""
select flag, count(*) as rows from (select unnest({SPLIT_FLAGS.format(c='quality_flags')}) as flag from lines) group by flag"""))
def split_flags(spark, sf_dir):
    return V.lines(spark, sf_dir).select(F.explode(X.split_flags("quality_flags")).alias("flag")).groupBy("flag").agg(
        F.count(F.lit(1)).alias("rows"))


# --- copy guardrails ---------------------------------------------------------------------------
def _kw(expr):
    return (
        f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({expr}), '[a-z][a-z0-9''-]{{3,}}'), "
        f"lambda w: not list_contains({items(T.STOPWORDS)}, w)), lambda w: rtrim(w, '''')))"
    )


@query("flag_grounding", with_(V.LINES, select=f"""
select row_idx, {join_sql(flags_sql(
    ('len(e) = 0', 'missing_grounding_evidence'),
    ('len(e) > 0 and len(u) > 0 and len(list_intersect(u, e)) / len(u)::double < 0.2', 'evidence_used_not_in_extracted_facts'),
    ('len(e) > 0 and len(l) > 0 and len(list_intersect(l, e)) / len(l)::double < 0.18', 'line_not_grounded_in_evidence')))} as flags
from (select row_idx, {_kw('evidence_found')} as e, {_kw('personalized_line')} as l, {_kw("surface_checked || ' ' || research_priority")} as u from lines)"""))
def flag_grounding(spark, sf_dir):
    df = V.lines(spark, sf_dir).select(
        "row_idx", F.col("personalized_line").alias("opening_line"), F.col("evidence_found").alias("evidence_text"),
        F.concat_ws(" ", "surface_checked", "research_priority").alias("used_text"))
    return copyguard.grounding(df).select("row_idx", X.join_list("grounding_flags").alias("flags"))


_DRAFT = V.LINES + f""",
drafts as (
  select row_idx, personalized_line as opening_line, 'Because ' || research_priority as tailored_insight, surface_checked as used_text,
    company as company_name, 'https://www.GitHub.com/x' as website_url, evidence_found as evidence_text, human_decision,
    lower(evidence_found || ' ' || surface_checked) as app_text, lower(personalized_line) as line,
    lower(personalized_line || ' Because ' || research_priority) as low from lines
)"""


def _drafts(spark, sf_dir):
    return V.lines(spark, sf_dir).select(
        "row_idx", F.col("personalized_line").alias("opening_line"),
        F.concat(F.lit("Because "), "research_priority").alias("tailored_insight"), F.col("surface_checked").alias("used_text"),
        F.col("company").alias("company_name"), F.lit("https://www.GitHub.com/x").alias("website_url"),
        F.col("evidence_found").alias("evidence_text"),
        F.concat_ws(" ", "evidence_found", "surface_checked").alias("app_evidence_text"), "human_decision", "status")


_FR = any_sql("line", T.COPY_FRICTION_TERMS)
_CF = flags_sql(
    ("contains(opening_line || ' ' || tailored_insight, '—')", "em_dash"),
    (any_sql("low", T.FILLER_WORDS), "generic_praise"),
    ("contains(line, 'blog') or contains(line, 'article')", "blog_angle_low_value"),
    (f"opening_line <> '' and len(string_split_regex({V.strip_sql('opening_line')}, '{WS}+')) > 40", "opening_line_too_long"),
    ("used_text = ''", "missing_evidence_used_for_copy"),
    ("regexp_matches(low, '\\bi\\s+downloaded\\b|\\bi\\s+installed\\b|\\bafter\\s+(downloading|installing)\\b')", "download_claim"),
    ("regexp_matches(opening_line, '(^|[^A-Za-z0-9])(GitHub|GITHUB|Github)($|[^A-Za-z0-9])')", "company_name_not_lowercase"),
    ("opening_line <> '' and not " + starts_sql("line", T.TEMPLATE_STARTS), "missing_conversational_template_open"),
    ("opening_line <> '' and not " + any_sql("line", T.OUTCOME_TERMS + ["complete"]), "missing_specific_dropoff_hypothesis"),
    (any_sql("line", T.ABSTRACT_PHRASES) + f" and not {_FR}", "too_abstract"),
    (any_sql("line", T.POSITIVE_OBSERVATION_TERMS) + f" and not {_FR}", "missing_visible_friction"),
    (any_sql("line", T.TECHNICAL_TERMS), "technical_audit_language"),
    ("regexp_matches(opening_line, '<[^>\\n]+>')", "html_in_personalization_line"),
    (any_sql("line", T.SPAM_PHRASES), "spam_trigger_language"),
    ("len(e) = 0", "missing_grounding_evidence"),
    ("len(e) > 0 and len(u) > 0 and len(list_intersect(u, e)) / len(u)::double < 0.2", "evidence_used_not_in_extracted_facts"),
    ("len(e) > 0 and len(l) > 0 and len(list_intersect(l, e)) / len(l)::double < 0.18", "line_not_grounded_in_evidence"),
    (any_sql("app_text", T.APP_EVIDENCE_TERMS) + " and (contains(line, 'website') or contains(line, 'blog')) and not contains(line, 'app')", "wrong_surface"),
)
_COPYFLAGS = _DRAFT + f""",
cf as (select *, {_CF} as cflags from (select *, {_kw('evidence_text')} as e, {_kw('opening_line')} as l, {_kw('used_text')} as u from drafts))"""


@query("copy_flags", with_(_COPYFLAGS, select=f"select row_idx, {join_sql('cflags')} as flags from cf"))
def copy_flags(spark, sf_dir):
    return copyguard.copy_flags(_drafts(spark, sf_dir)).select("row_idx", X.join_list("copy_flags").alias("flags"))


@query("qc_merge", with_(_COPYFLAGS, select=f"""
select row_idx, {join_sql(dedupe_sql('af'))} as qc_flags,
  cast(greatest(0, least(10, case when blocked then least(ms, 7) else ms end)) as bigint) as qc_score,
  not blocked and mp and ms >= 8 as qc_passed,
  (human_decision = 'reject') or not (not blocked and mp and ms >= 8) or greatest(0, least(10, case when blocked then least(ms, 7) else ms end)) < 8
    or list_has_any(af, {items(T.SERIOUS_FLAGS)}) as needs_review, qc_reasons
from (select *, list_has_any(af, {items(T.BLOCKING_QC_FLAGS)}) as blocked from (
  select *, (case when failed then [] when row_idx % 6 = 1 then ['hallucination'] when row_idx % 6 = 3 then ['minor_tone'] else [] end) || cflags as af,
    case when failed then 0 else row_idx % 12 end as ms, not failed and row_idx % 3 <> 0 as mp, case when failed then '' else status end as qc_reasons
  from (select cf.*, status, row_idx % 10 = 9 as failed from cf join (select row_idx, status from lines) using (row_idx))))"""))
def qc_merge(spark, sf_dir):
    """Reviewer replies as JSON text, parsed and merged with the own flags; every tenth reply holds no JSON."""
    k = F.col("row_idx")
    flags = F.when(k % 6 == 1, X.lits(["hallucination", " "])).when(k % 6 == 3, X.lits([" minor_tone "])).otherwise(F.array().cast("array<string>"))
    body = F.to_json(F.struct((k % 12).alias("score"), (k % 3 != 0).alias("pass"), F.array("status", F.lit("")).alias("reasons"), flags.alias("quality_flags")))
    reply = F.when(k % 10 == 9, "no reply").when(k % 4 == 0, F.concat(F.lit("Verdict: "), body)).otherwise(body)
    df = copyguard.copy_flags(_drafts(spark, sf_dir)).withColumns({"research_review": F.col("human_decision") == "reject", "reply": reply})
    df = copyguard.merge_qc(prompts.parse_qc(df, keep=["row_idx", "copy_flags", "research_review"]))
    df = copyguard.needs_review(df, carried=["research_review"], all_flags="qc_flags")
    return df.select("row_idx", X.join_list("qc_flags").alias("qc_flags"), F.col("qc_score").cast("bigint").alias("qc_score"), "qc_passed", "needs_review",
                     X.join_list("qc_reasons").alias("qc_reasons"))


@query("draft_sanitize", with_(_DRAFT, select=r"""
select row_idx, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(opening_line,
    '\bi\s+downloaded\s+the\b', 'I opened the', 'gi'), '\bi\s+downloaded\b', 'I opened', 'gi'), '\bi\s+installed\b', 'I opened', 'gi'),
    '\bafter\s+(downloading|installing)\b', 'after opening', 'gi'),
    '(^|[^A-Za-z0-9])github($|[^A-Za-z0-9])', '\1GitHub\2', 'gi')) as opening_line from drafts"""))
def draft_sanitize(spark, sf_dir):
    df = _drafts(spark, sf_dir).withColumns({"chosen_angle": F.col("used_text"), "evidence_used_for_copy": F.array("used_text")})
    return copyguard.sanitize_draft(df).select("row_idx", "opening_line")


_BRANDED = V.LINES + """,
branded as (
  select row_idx, source || 'Hub' as longer, source as shorter, 'I checked ' || upper(source) || 'hub and ' || upper(source) || ' on x.' || source || '.io: ' || text as opening_line
  from (select *, replace(company, ' labs', '') as source from lines))"""


def _cased(text, brand):
    """Whole-token mentions of a brand in its own casing; a mark behind every other character keeps neighbours apart."""
    marked = f"regexp_replace({text}, '([^A-Za-z0-9])', '\\1' || chr(1), 'g')"
    return f"replace(regexp_replace({marked}, '(?i)(^|' || chr(1) || ')' || {brand} || '($|[^A-Za-z0-9])', '\\1' || {brand} || '\\2', 'g'), chr(1), '')"


@query("draft_brands", with_(_BRANDED, select=f"""
select row_idx, {V.strip_sql('once')} as opening_line from (select row_idx, {_cased('twice', 'shorter')} as once from (select *, {_cased('opening_line', 'longer')} as twice from branded))"""))
def draft_brands(spark, sf_dir):
    """Two brands of a lead, the company's name and the shorter stem of its host, in the lead's own casing."""
    source = F.replace("company", F.lit(" labs"), F.lit(""))
    df = V.lines(spark, sf_dir).select("row_idx", "text", source.alias("source")).withColumns({
        "company_name": F.concat("source", F.lit("Hub")), "website_url": F.concat(F.lit("https://www."), "source", F.lit(".example.com/x")),
        "opening_line": F.concat(F.lit("I checked "), F.upper("source"), F.lit("hub and "), F.upper("source"), F.lit(" on x."), "source", F.lit(".io: "), "text")})
    return df.select("row_idx", X.strip(copyguard.replace_brand_casing("opening_line", "company_name", "website_url")).alias("opening_line"))


# --- evaluation ----------------------------------------------------------------------------------
_METRIC_VALUES = f"""cast(count(*) as double) as frozen_eval_rows,
    {pct_sql("count(*) filter (e = decision)", "count(*)")} as exact_gate_human_agreement_pct,
    {pct_sql("count(*) filter (decision = 'Send' and human_decision = 'send')", "count(*) filter (decision = 'Send')")} as send_precision_pct,
    {pct_sql("count(*) filter (decision = 'Reject' and human_decision = 'reject')", "count(*) filter (human_decision = 'reject')")} as reject_recall_pct,
    cast(count(*) filter (decision = 'Send' and human_decision <> 'send') as double) as false_send_rows,
    {pct_sql("count(*) filter (s_label = 'Correct')", "count(*)")} as surface_correct_rate_pct,
    {pct_sql("count(*) filter (s_label = 'Correct' and ps = 'app_first_product')", "count(*) filter (ps = 'app_first_product')")} as app_first_surface_correct_rate_pct,
    round_even(avg(ev), 1) as avg_evidence_score, round_even(avg(tp), 1) as avg_template_fit_score
  from (select *, case human_decision when 'send' then 'Send' when 'edit' then 'Edit' when 'reject' then 'Reject' else 'Unknown' end as e from gates)"""
_METRICS_OF = f""",
agg as materialized (select {_METRIC_VALUES}),
metrics as materialized (select metric, value from (unpivot agg on columns(*) into name metric value value))"""
_METRICS = GATES + _METRICS_OF


@query("eval_metrics", with_(_METRICS, select="select metric, value from metrics"))
def eval_metrics(spark, sf_dir):
    return evals.metrics(scored(spark, sf_dir))


@query("eval_decision_counts", with_(GATES, select="""
select metric, cast(count(*) as double) as value from (
  select 'gate_' || lower(decision) || '_rows' as metric from gates union all select 'human_' || human_decision || '_rows' from gates) group by metric"""))
def eval_decision_counts(spark, sf_dir):
    return evals.decision_counts(scored(spark, sf_dir))


@query("release_gate", with_(_METRICS, select="""
select m.metric, rule, value, threshold from metrics m join (values
  ('send_precision_pct', 'min_send_precision', 90.0::double), ('exact_gate_human_agreement_pct', 'min_exact_agreement', 78.0::double),
  ('surface_correct_rate_pct', 'min_surface_correct_rate', 85.0::double), ('app_first_surface_correct_rate_pct', 'min_app_first_surface_correct_rate', 90.0::double),
  ('false_send_rows', 'max_false_sends', 0.0::double)) t(metric, rule, threshold) on m.metric = t.metric
where case when rule = 'max_false_sends' then value > threshold when rule like 'min_app%' then value > 0 and value < threshold else value < threshold end"""))
def release_gate(spark, sf_dir):
    return evals.release_gate(evals.metrics(scored(spark, sf_dir)))


@query("eval_attention", with_(GATES, select="""
select row_idx, decision as gate_decision, human_decision, decision = 'Send' and human_decision <> 'send' as is_false_send from gates
where (case human_decision when 'send' then 'Send' when 'edit' then 'Edit' when 'reject' then 'Reject' else 'Unknown' end) <> decision"""))
def eval_attention(spark, sf_dir):
    df = evals.needs_attention(evals.with_agreement(scored(spark, sf_dir)))
    return df.select("row_idx", "gate_decision", "human_decision", "is_false_send")


#: Six evaluations a week apart, each of another part of the lines; every second one became a baseline a day later.
COHORTS, FIRST_EVALUATION = 6, "2024-02-01 00:00:00"
_COHORT_METRICS = GATES + f""",
cohorts as materialized (select row_idx % {COHORTS} as cohort, {_METRIC_VALUES} group by 1),
timed as (
  select cohort, metric, value, timestamp '{FIRST_EVALUATION}' + to_days(cast(7 * cohort as int)) as evaluated_at
  from (unpivot cohorts on columns(* exclude (cohort)) into name metric value value)),
history as (select metric, value as baseline_value, evaluated_at + interval 1 day as created_at from timed where cohort % 2 = 0),
against as (select t.*, h.baseline_value from timed t asof left join history h on t.metric = h.metric and t.evaluated_at > h.created_at)"""


def _against_baselines(spark, sf_dir):
    """Metrics of every cohort with the latest baseline before it; the gate runs once, its tallies are stored."""
    cohort = (F.col("row_idx") % COHORTS).alias("cohort")
    rows = stored(evals.tallies(scored(spark, sf_dir), [cohort]))
    at = F.lit(FIRST_EVALUATION).cast("timestamp") + F.make_dt_interval((F.col("cohort") * 7).cast("int"))
    now = evals.metrics_of(rows, ["cohort"]).withColumn("evaluated_at", at)
    history = now.filter(F.col("cohort") % 2 == 0).select("metric", "value", (F.col("evaluated_at") + F.expr("interval 1 day")).alias("created_at"))
    return evals.baseline_before(now, history)


@query("baseline_changes", with_(_COHORT_METRICS, select="""
select cohort, metric, value, baseline_value, round_even(value - baseline_value, 4) as change from against where baseline_value is not null"""))
def baseline_changes(spark, sf_dir):
    rows = stored(_against_baselines(spark, sf_dir))
    known = rows.filter(F.col("baseline_value").isNotNull()).select("cohort", "metric", F.col("baseline_value").alias("value"))
    return evals.baseline_changes(rows.select("cohort", "metric", "value"), known, ["cohort"])


_REGRESSION = "send_precision_pct exact_gate_human_agreement_pct reject_recall_pct surface_correct_rate_pct app_first_surface_correct_rate_pct".split()


@query("release_gate_baseline", with_(_COHORT_METRICS, select=f"""
select cohort, m.metric, rule, value, threshold from timed m join (values
  ('send_precision_pct', 'min_send_precision', 90.0::double), ('exact_gate_human_agreement_pct', 'min_exact_agreement', 78.0::double),
  ('surface_correct_rate_pct', 'min_surface_correct_rate', 85.0::double), ('app_first_surface_correct_rate_pct', 'min_app_first_surface_correct_rate', 90.0::double),
  ('false_send_rows', 'max_false_sends', 0.0::double)) t(metric, rule, threshold) on m.metric = t.metric
where case when rule = 'max_false_sends' then value > threshold when rule like 'min_app%' then value > 0 and value < threshold else value < threshold end
union all select cohort, metric, 'no_regression', value, baseline_value from against
where (metric in ({", ".join(map(q, _REGRESSION))}) and baseline_value > 0 and value < baseline_value) or (metric = 'false_send_rows' and value > baseline_value)"""))
def release_gate_baseline(spark, sf_dir):
    """The release gate of every cohort, with the regression rules against the latest baseline before it."""
    rows = stored(_against_baselines(spark, sf_dir))
    known = rows.select("cohort", "metric", F.col("baseline_value").alias("value"))
    return evals.release_gate(rows.select("cohort", "metric", "value"), baseline=known, keys=["cohort"])


_EDITED_GATES = GATES.replace("lines as (", "stated as (", 1).replace(",\ng0 as (", """,
lines as (select * replace (case when human_decision = 'edit' then edited_line else personalized_line end as personalized_line) from stated),
g0 as (""", 1)


@query("rescored_metrics", with_(_EDITED_GATES + _METRICS_OF, select="select metric, value from metrics"))
def rescored_metrics(spark, sf_dir):
    """Metrics after review edits: the stored verdicts stay, edited rows alone are judged again and exchanged in the tallies."""
    base = stored(scored(spark, sf_dir).select("row_idx", *evals.TALLIED))
    edits = V.lines(spark, sf_dir).filter(F.col("human_decision") == "edit").select("row_idx", F.col("edited_line").alias("personalized_line"))
    old = evals.tallies(base.join(edits.select("row_idx"), "row_idx", "left_semi"))
    new = evals.tallies(gates.rescored_rows(V.lines(spark, sf_dir), edits, ["row_idx"], ["personalized_line"]))
    return evals.metrics_of(evals.corrected(evals.tallies(base), old, new))


@query("judge_agreement", with_(GATES, select=f"""
select model_name as model, count(*) as rows, count(*) filter (lower(decision) = h) as agreements,
  {pct_sql("count(*) filter (lower(decision) = h)", "count(*)")} as agreement_pct
from (select *, case when human_decision = 'unreviewed' then 'unknown' else human_decision end as h from gates) group by model_name"""))
def judge_agreement(spark, sf_dir):
    judged = scored(spark, sf_dir).select("row_idx", F.col("model_name").alias("model"), F.lower("sendability_decision").alias("judge_decision"))
    return evals.judge_agreement(V.lines(spark, sf_dir).select("row_idx", "human_decision"), judged, "row_idx")


_JUDGED = ["original_line", "model_opening_line", "personalized_line", "opening_line", "current_opening_line"]


@query("candidate_lines", with_(V.LINES, select=f"""
select row_idx, coalesce(nullif({V.strip_sql('original_line')}, ''), nullif({V.strip_sql('model_opening_line')}, ''), {V.strip_sql('personalized_line')}) as candidate_line,
  case when row_idx % 3 = 0 then 'Ready' else status end as status, surface_checked as surface_used
from (select *, case when row_idx % 2 = 0 then ' ' else edited_line end as original_line from lines)"""))
def candidate_lines(spark, sf_dir):
    """Goldset rows with old column names and blanks, as the judges see them."""
    k = F.col("row_idx")
    df = V.lines(spark, sf_dir).withColumns({
        "original_line": F.when(k % 2 == 0, " ").otherwise(F.col("edited_line")), "status": F.when(k % 3 == 0, "").otherwise(F.col("status"))})
    df = evals.normalize_goldset(df.withColumnRenamed("surface_checked", "surface_used"))
    return df.select("row_idx", evals.candidate_line(df.columns).alias("candidate_line"), "status", F.col("surface_checked").alias("surface_used"))


@query("goldset_summary", with_(V.LINES, select="""
select s as split, count(row_idx) as rows, count(*) filter (human_decision = 'send') as send, count(*) filter (human_decision = 'edit') as edit,
  count(*) filter (human_decision = 'reject') as reject, coalesce(max(top), '') as top_reason
from (select unnest(['reviewed_examples', 'frozen_eval_set', 'candidate_training_set']) as s)
left join (select *, (['reviewed_examples', 'frozen_eval_set'])[row_idx % 2 + 1] as sp from lines) on s = sp
left join (select sp as tsp, arg_max(r, [n, -f]) as top from (
  select (['reviewed_examples', 'frozen_eval_set'])[row_idx % 2 + 1] as sp, edit_reason_category as r, count(*) as n, min(row_idx) as f
  from lines where edit_reason_category <> 'not_reviewed' group by 1, 2) group by sp) on s = tsp group by s"""))
def goldset_summary(spark, sf_dir):
    rows = V.lines(spark, sf_dir).withColumn("goldset_split", V.pick(T.GOLDSET_SPLITS[:2], F.col("row_idx")))
    return evals.goldset_summary(rows)


@query("preference_pairs", with_(V.LINES, select=f"""
select row_idx, case when human_decision in ('send', 'edit') then coalesce(nullif({V.strip_sql('edited_line')}, ''), {V.strip_sql('personalized_line')}) else '' end as preferred_line,
  case when human_decision = 'reject' then m when edited_line <> '' and {V.strip_sql('edited_line')} <> m then m else '' end as non_preferred_line,
  website || '' as website
from (select *, coalesce(nullif(model_opening_line, ''), {V.strip_sql('personalized_line')}) as m from lines) where human_decision <> 'unreviewed'"""))
def preference_pairs(spark, sf_dir):
    rows = canonical.canonicalize(V.lines(spark, sf_dir)).filter(F.col("human_decision") != "unreviewed")
    return evals.preference_pairs(rows).select("row_idx", "preferred_line", "non_preferred_line", "website")


@query("goldset_rows", with_(GATES, select=f"""
select row_id, 'reviewed_examples' as goldset_split, human_decision, decision as sendability_decision, 'no' as is_frozen_eval_example,
  source_urls || ' | ' || shareable_screenshots as evidence_refs, surface_checked as surface_used, product_surface_type as product_type
from gates where human_decision <> 'unreviewed'"""))
def goldset_rows(spark, sf_dir):
    rows = evals.goldset_rows(V.lines(spark, sf_dir), "reviewed_examples", "2024-02-01 00:00:00")
    return rows.select("row_id", "goldset_split", "human_decision", "sendability_decision", "is_frozen_eval_example",
                       "evidence_refs", "surface_used", "product_type")


@query("split_guard", with_(V.LINES, select=f"""
select split, kind, count(*) as rows, not (split not in ('reviewed_examples', 'frozen_eval_set', 'candidate_training_set')
  or (split = 'frozen_eval_set' and kind = 'client_feedback')) as accepted
from (select {V.pick_sql(T.GOLDSET_SPLITS + ['other'], 'row_idx')} as split, case when row_idx % 3 = 0 then 'client_feedback' else 'operator_review' end as kind from lines)
group by all"""))
def split_guard(spark, sf_dir):
    k = F.col("row_idx")
    rows = V.lines(spark, sf_dir).select(
        V.pick(T.GOLDSET_SPLITS + ["other"], k).alias("goldset_split"),
        F.when(k % 3 == 0, "client_feedback").otherwise("operator_review").alias("source_kind"))
    good, bad = evals.split_guard(rows)
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return both.groupBy(F.col("goldset_split").alias("split"), F.col("source_kind").alias("kind"), "accepted").agg(F.count(F.lit(1)).alias("rows"))


_LABELS = V.LINES + f""",
client as (
  select row_idx, company, personalized_line as opening_line, model_opening_line as current_line, {V.pick_sql(V.DECISIONS, 'row_idx')} as client_decision,
    edited_line as client_rewrite, {V.pick_sql(V.LABEL_REASONS, 'row_idx')} as main_reason, surface_checked as surface_to_focus_on,
    case when row_idx % 2 = 0 then source_urls else evidence_found end as evidence_or_context, research_priority as final_notes from lines
)"""


@query("client_labels", with_(_LABELS, select=f"""
select row_idx, case when {V.strip_sql('opening_line')} <> '' then opening_line else current_line end as personalized_line,
  coalesce(map {{'send as is': 'send', 'rewrite': 'edit', 'reject': 'reject'}}[lower(client_decision)], 'unreviewed') as human_decision,
  coalesce(map {{'good as is': 'good_as_is', 'tone wrong': 'tone', 'too long': 'too_long'}}[lower(main_reason)], 'other') as edit_reason_category,
  concat_ws(' | ', case when surface_to_focus_on <> '' then 'Surface: ' || surface_to_focus_on end, nullif(final_notes, '')) as edit_notes,
  case when evidence_or_context like 'http%' then evidence_or_context else '' end as source_urls
from client where client_decision <> ''"""))
def client_labels(spark, sf_dir):
    k = F.col("row_idx")
    df = V.lines(spark, sf_dir).select(
        "row_idx", "company", F.col("personalized_line").alias("opening_line"), F.col("model_opening_line").alias("current_line"),
        V.pick(V.DECISIONS, k).alias("client_decision"), F.col("edited_line").alias("client_rewrite"),
        V.pick(V.LABEL_REASONS, k).alias("main_reason"), F.col("surface_checked").alias("surface_to_focus_on"),
        F.when(k % 2 == 0, F.col("source_urls")).otherwise(F.col("evidence_found")).alias("evidence_or_context"),
        F.col("research_priority").alias("final_notes"))
    return evals.normalize_labels(df, "2024-02-01").select(
        "row_idx", "personalized_line", "human_decision", "edit_reason_category", "edit_notes", "source_urls")


@query("label_template", with_(V.LINES, select="""
select company, person, role, website, personalized_line as current_line, personalized_line as opening_line, '' as client_decision,
  surface_checked as surface_to_focus_on, evidence_found as evidence_or_context from lines"""))
def label_template(spark, sf_dir):
    return evals.training_template(V.lines(spark, sf_dir)).select(
        "company", "person", "role", "website", "current_line", "opening_line", "client_decision", "surface_to_focus_on", "evidence_or_context")


@query("campaign_template", with_(V.LINES, select=f"""
select company, website, coalesce(nullif({V.strip_sql('edited_line')}, ''), {V.strip_sql('personalized_line')}) as delivered_line, '' as sent from lines"""))
def campaign_template(spark, sf_dir):
    return evals.campaign_template(V.lines(spark, sf_dir)).select("company", "website", "delivered_line", "sent")


# --- delivery and privacy ---------------------------------------------------------------------------
_B = r"(^|[^\pL\pN_])"


@query("redact_text", with_(V.LINES, select=r"""
select row_idx, regexp_replace(regexp_replace(x, '[A-Za-z]:\\Users\\[^|;\n\r\t]+', '[redacted]', 'gi'), '/Users/[^|;\n\r\t]+|/home/[^|;\n\r\t]+', '[redacted]', 'gi') as path_free
from (select row_idx, trace_files || ' ; ' || text as x from lines)"""))
def redact_text(spark, sf_dir):
    df = V.lines(spark, sf_dir).select("row_idx", F.concat_ws(" ; ", "trace_files", "text").alias("x"))
    t = F.col("x")
    for _, pattern, replacement in redact.STEPS[:2]:
        t = F.regexp_replace(t, pattern, replacement)
    return df.select("row_idx", t.alias("path_free"))


_SENSITIVE = V.LINES + """,
sensitive as (select row_idx, trace_files || ' ; ' || source_urls || ' ; ' || text as x from lines)"""


def _sensitive(spark, sf_dir):
    return V.lines(spark, sf_dir).select("row_idx", F.concat_ws(" ; ", "trace_files", "source_urls", "text").alias("x"))


@query("redact_full", with_(_SENSITIVE, redact.sanitize_sql("sensitive", "x"), select=f"""
select row_idx, x as redacted, {join_sql('found')} as flags from redacted"""))
def redact_full(spark, sf_dir):
    out = redact.sanitize_columns(_sensitive(spark, sf_dir), "x", "redacted", "flags")
    return out.select("row_idx", "redacted", X.join_list("flags").alias("flags"))


@query("privacy_scan", with_(V.LINES, select=rf"""
select row_idx, {join_sql(flags_sql(
    (r"regexp_matches(x, '(?i)[A-Za-z]:\\Users\\[^|;\n\r\t]+')", 'local_windows_path'),
    (r"regexp_matches(x, '(?i)/Users/[^|;\n\r\t]+|/home/[^|;\n\r\t]+')", 'local_unix_user_path'),
    (r"regexp_matches(x, '(?i)[A-Z0-9._%+-]*[A-Z0-9_][A-Z0-9._%+-]*@[A-Z0-9.-]+\.[A-Z]{2,}($|[^\pL\pN_])')", 'email_address'),
    (r"regexp_matches(x, '(?i)\.trace\.zip($|[^\pL\pN_])|\.zip($|[^\pL\pN_])')", 'trace_file'),
    (r"regexp_matches(x, '(?i)[?&](api[_-]?key|key|token|access[_-]?token|auth|authorization|signature|sig|secret|expires|x-amz-[^=\s&|]+)=[^&\s|]+')", 'secret_query_parameter')))} as flags
from (select row_idx, trace_files || ' ; ' || source_urls || ' ; ' || text as x from lines)"""))
def privacy_scan(spark, sf_dir):
    df = V.lines(spark, sf_dir).select("row_idx", F.concat_ws(" ; ", "trace_files", "source_urls", "text").alias("x"))
    shown = ["local_windows_path", "local_unix_user_path", "email_address", "trace_file", "secret_query_parameter"]
    found = redact.scan("x")
    return df.withColumn("f", found).select("row_idx", X.join_list(
        X.flags(*[(F.array_contains("f", n), n) for n in shown])).alias("flags"))


@query("privacy_scan_all_classes", with_(_SENSITIVE, select=f"select row_idx, {join_sql(redact.scan_sql('x'))} as flags from sensitive"))
def privacy_scan_all_classes(spark, sf_dir):
    return _sensitive(spark, sf_dir).select("row_idx", X.join_list(redact.scan("x")).alias("flags"))


@query("privacy_spans", with_(_SENSITIVE, select=redact.span_rows_sql("sensitive", "row_idx", "x")))
def privacy_spans(spark, sf_dir):
    return redact.span_rows(_sensitive(spark, sf_dir), "row_idx", "x")


@query("privacy_spans_merged", with_(_SENSITIVE, "spans as (" + redact.span_rows_sql("sensitive", "row_idx", "x") + ")", select="""
select row_idx, min(start) as start, max(start + length) - min(start) as length, array_to_string(list_sort(list_distinct(list(class))), ' | ') as classes from (
  select *, sum(fresh) over (partition by row_idx order by start, length, class) as island from (
    select *, case when start < max(start + length) over (partition by row_idx order by start, length, class rows between unbounded preceding and 1 preceding)
      then 0 else 1 end as fresh from spans)) group by row_idx, island"""))
def privacy_spans_merged(spark, sf_dir):
    found = redact.merged_spans(redact.span_rows(_sensitive(spark, sf_dir), "row_idx", "x"), "row_idx")
    return found.select("row_idx", "start", "length", X.join_list("classes").alias("classes"))


@query("screenshot_name_scan", with_(V.LINES, select=r"""
select row_idx, trim(n) as file_name, case when lower(n) like '%.zip' then 'trace_file' end as flags
from (select row_idx, unnest(string_split(shareable_screenshots || ' | ' || 'run_' || row_idx || '.zip', '|')) as n from lines) where lower(n) like '%.zip'"""))
def screenshot_name_scan(spark, sf_dir):
    df = V.lines(spark, sf_dir).withColumn("screenshots", F.concat(F.lit("run_"), F.col("row_id"), F.lit(".zip")))
    return delivery.scan_file_names(df).select("row_idx", "file_name", X.join_list("flags").alias("flags"))


_APPROVED = "(human_decision in ('send', 'edit') or (not (select bool_or(human_decision in ('send', 'edit')) from gates) and decision = 'Send'))"


@query("delivery_filter", with_(GATES, select=f"""
select row_idx, case when human_decision in ('send', 'edit') and edited_line <> '' then {V.strip_sql('edited_line')} else {V.strip_sql('personalized_line')} end as personalized_line
from gates where {_APPROVED}"""))
def delivery_filter(spark, sf_dir):
    return delivery.overlay_edits(delivery.delivery_filter(scored(spark, sf_dir), V.lines(spark, sf_dir))).select("row_idx", "personalized_line")


_SAFE_CELLS = [c for c in delivery.CLIENT_SAFE_COLUMNS if c != "privacy_scan_flags"]
_LINE = f"case when human_decision in ('send', 'edit') and edited_line <> '' then {V.strip_sql('edited_line')} else {V.strip_sql('personalized_line')} end"
_SAFE_VALUES = {
    "sendability_decision": "decision", "personalized_line": _LINE, "evidence_found": V.strip_sql("evidence_found"), "surface_correctness": "s_label",
    "evidence_score": "ev::varchar", "visual_reliability_score": "vs::varchar", "viewport_scope": "vp", "safe_screenshots": "''",
    "screenshot_privacy_notes": "''", "client_safe_notes": q(T.CLIENT_SAFE_NOTE),
}
#: Cells as rows, redacted class by class, and put together again.
_SAFE = GATES + f""",
cells as (select row_idx, name, x from (unpivot (
  select row_idx, {", ".join(f"{_SAFE_VALUES.get(c, c)} as {c}" for c in _SAFE_CELLS)} from gates where {_APPROVED})
  on columns(* exclude (row_idx)) into name name value x)),
""" + redact.sanitize_sql("cells", "x") + f""",
safe as materialized (
  select * replace (case when privacy_scan_flags <> '' then client_safe_notes || ' Potential sensitive values were redacted: ' || privacy_scan_flags || '.'
    else client_safe_notes end as client_safe_notes)
  from (select row_idx, {", ".join(f"max(x) filter (name = {q(c)}) as {c}" for c in _SAFE_CELLS)},
    {join_sql('list_sort(list_distinct(flatten(list(found))))')} as privacy_scan_flags from redacted group by row_idx))"""
_RESIDUAL = f"(select list_sort(list_distinct(flatten(list({redact.scan_sql('blob')})))) from (select concat_ws(' ', {', '.join(delivery.CLIENT_SAFE_COLUMNS)}) as blob from safe))"


def _safe(spark, sf_dir, **how):
    return delivery.client_safe(scored(spark, sf_dir), scored=True, source=V.lines(spark, sf_dir), **how)


@query("client_safe_table", with_(_SAFE, select=f"select row_idx, {', '.join(delivery.CLIENT_SAFE_COLUMNS)} from safe"))
def client_safe_table(spark, sf_dir):
    return _safe(spark, sf_dir, keep=["row_idx"])


@query("client_safe_leaks", with_(_SAFE, select=f"select {join_sql(_RESIDUAL)} as residual_flags"))
def client_safe_leaks(spark, sf_dir):
    return delivery.residual_flags(_safe(spark, sf_dir)).select(X.join_list("flags").alias("residual_flags"))


@query("delivery_manifest", with_(_SAFE, select=f"""
select (select count(*) from gates) as input_rows, (select count(*) from safe) as client_rows,
  'human-approved send/edit when available, otherwise sendability Send only' as filter_policy, {join_sql('r')} as remaining_privacy_scan_flags,
  case when list_has_any(r, {items(T.HARD_LEAKS)}) then 'blocked' else 'client_safe' end as status from (select {_RESIDUAL} as r)"""))
def delivery_manifest(spark, sf_dir):
    return delivery.delivery_manifest(V.lines(spark, sf_dir), _safe(spark, sf_dir))


@query("delivery_policies", with_(GATES, select="""
select 'all' as policy, count(*) as rows from gates union all select 'send', count(*) from gates where decision = 'Send'
union all select 'approved', count(*) from gates where human_decision in ('send', 'edit')"""))
def delivery_policies(spark, sf_dir):
    return delivery.policy_counts(scored(spark, sf_dir))


_NAME = f"string_split_regex({V.strip_sql('person')}, ' +')"


@query("export_sending_tool", with_(V.LINES, select=f"""
select case when person = '' then '' else {_NAME}[1] end as "firstName", case when person = '' then '' else array_to_string({_NAME}[2:], ' ') end as "lastName",
  company as "companyName", role as "jobTitle", website,
  case when human_decision in ('send', 'edit') and {V.strip_sql('edited_line')} <> '' then edited_line else personalized_line end as icebreaker from lines"""))
def export_sending_tool(spark, sf_dir):
    return delivery.sending_tool(V.lines(spark, sf_dir), "lemlist")


@query("review_queue", with_(GATES, select="""
select row_idx, decision as sendability_decision, s_label as surface_correctness from gates where decision in ('Edit', 'Reject') and s_label in ('Review', 'Correct')"""))
def review_queue(spark, sf_dir):
    df = delivery.facet_filter(delivery.review_queue(scored(spark, sf_dir)), surface_correctness=["Review", "Correct"], status=[])
    return delivery.by_priority(df).select("row_idx", "sendability_decision", "surface_correctness")


_REPAIRED = "x"
for _bad, _good in T.TEXT_REPAIRS:
    _REPAIRED = f"replace({_REPAIRED}, {q(_bad)}, {q(_good)})"


@query("shorten_text", with_(V.LINES, select=f"""
select row_idx, case when length(t) <= 420 then t else rtrim(left(t, 417), {V.WS_SQL}) || '...' end as short_text
from (select row_idx, {V.strip_sql(f"regexp_replace({_REPAIRED}, '{WS}+', ' ', 'g')")} as t from (select row_idx, personalized_line || ' ’ ' || text as x from lines))"""))
def shorten_text(spark, sf_dir):
    df = V.lines(spark, sf_dir).select("row_idx", F.concat_ws(" ’ ", "personalized_line", "text").alias("x"))
    return df.select("row_idx", X.shorten("x").alias("short_text"))


def run_rows(spark, sf_dir):
    """Lines in the shape of finished run rows."""
    k = F.col("row_idx")
    return V.lines(spark, sf_dir).select(
        "row_idx", "row_id", "run_id", F.col("company").alias("company_name"), F.col("person").alias("recipient_name"),
        F.col("role").alias("recipient_role"), F.col("website").alias("website_url"),
        F.col("personalized_line").alias("opening_line"), F.col("evidence_found").alias("evidence_points"),
        F.col("personalized_line").alias("opening_line_option_1"), F.when(k % 2 == 0, F.col("model_opening_line")).otherwise("").alias("opening_line_option_2"),
        (k % 11).cast("string").alias("confidence_score_option_1"), F.col("quality_flags").alias("quality_flags_option_1"),
        F.col("needs_manual_review").alias("needs_manual_review_option_1"), "friction_type", "surface_checked", "conversion_outcome",
        "product_surface_type", "research_priority", "visual_confidence", F.col("shareable_screenshots").alias("shareable_screenshot_files"),
        "trace_files", "ux_validator_findings", "quality_flags", "needs_manual_review", "source_urls", "tone_profile", "model_name",
        F.concat(F.lit("note; "), "status").alias("reviewer_notes"), (k % 7).cast("string").alias("input__Rank"))


def _squeezed(column):
    return V.strip_sql(f"regexp_replace({_REPAIRED.replace('(x', f'({column}')}, '{WS}+', ' ', 'g')")


def _cell(column):
    return f"replace(replace({_squeezed(column)}, ' | ', chr(10)), '; ', chr(10))"


_REVIEW_SAME = ["friction_type", "surface_checked", "conversion_outcome", "product_surface_type", "research_priority", "role", "website", "model_name",
                "visual_confidence", "needs_manual_review", "tone_profile"]
_REVIEW_CELLS = ["quality_flags", "evidence_found", "shareable_screenshots", "trace_files", "ux_validator_findings", "source_urls"]


@query("review_rows", with_(V.LINES, select=f"""
select row_idx, case when bad then 'Research only' when needs_manual_review = 'yes' then 'Review' else 'Ready' end as status, company, person,
  personalized_line, personalized_line as option_1_line, case when row_idx % 2 = 0 then model_opening_line else '' end as option_2_line,
  cast(row_idx % 11 as varchar) as option_1_qc_score, needs_manual_review as option_1_needs_review, {", ".join(_REVIEW_SAME)},
  {", ".join(f"{_cell(c)} as {c}" for c in _REVIEW_CELLS)}, 'note; ' || status as reviewer_notes, cast(row_idx % 7 as varchar) as "input__Rank"
from (select * replace ({V.strip_sql('personalized_line')} as personalized_line), personalized_line = '' or personalized_line like '[%' as bad from lines)"""))
def review_rows(spark, sf_dir):
    return delivery.review_rows(run_rows(spark, sf_dir)).select(
        "row_idx", "status", "company", "person", "personalized_line", "option_1_line", "option_2_line", "option_1_qc_score",
        "option_1_needs_review", *_REVIEW_SAME, *_REVIEW_CELLS, "reviewer_notes", "input__Rank")


@query("research_rows", with_(V.LINES, select=f"""
select row_idx, company, 'visual ' || visual_confidence as v, {_squeezed("evidence_found")} as "evidence found" from lines"""))
def research_rows(spark, sf_dir):
    return delivery.research_rows(run_rows(spark, sf_dir)).select(
        "row_idx", "company", F.concat(F.lit("visual "), F.split_part("visual confidence", F.lit("("), F.lit(1))).alias("v"), "evidence found").withColumn(
        "v", F.when(F.trim("v") == "visual", F.lit("visual ")).otherwise(F.rtrim("v")))


#: The name under which whole texts were shown first; they are in all research rows now.
query("research_rows_whole", SQL["research_rows"])(research_rows)


# --- reports ---------------------------------------------------------------------------------------
_STATUS = "case when noline or bad then 'Research only' when needs_manual_review = 'yes' then 'Review' else 'Ready' end"
_SUMMARY = [
    ("Total contact rows", "count(*)"), ("Unique companies", "count(distinct lower(company))"),
    ("Rows with personalized line", "count(*) filter (not bad)"), ("Rows ready to send", "count(*) filter (status = 'Ready')"),
    ("Sendability: Send", "count(*) filter (decision = 'Send')"), ("Sendability: Edit", "count(*) filter (decision = 'Edit')"),
    ("Sendability: Reject", "count(*) filter (decision = 'Reject')"), ("Surface correctness: Correct", "count(*) filter (s_label = 'Correct')"),
    ("Surface correctness: Review", "count(*) filter (s_label = 'Review')"), ("Surface correctness: Wrong", "count(*) filter (s_label = 'Wrong')"),
    ("Rows needing review", "count(*) filter (needs_manual_review = 'yes')"), ("Research-only rows", "count(*) filter (status = 'Research only')"),
    ("Rows with source URLs", "count(*) filter (src)"), ("High visual-confidence rows", "count(*) filter (vc = 'high')"),
    ("Medium visual-confidence rows", "count(*) filter (vc = 'medium')"), ("Low visual-confidence rows", "count(*) filter (vc = 'low')"),
    ("Rows where app walkthrough is recommended", "0"),
    ("Tone profile", "(select string_agg(t, ', ' order by t) from (select distinct tone_profile as t from lines where tone_profile <> ''))"),
    ("Model", "(select string_agg(t, ', ' order by t) from (select distinct model_name as t from lines where model_name <> ''))"),
    ("How to use", "'Start in the Review tab. Edit personalized_line if needed, then check Research Details for longer evidence.'"),
]


@query("batch_summary", with_(GATES, select=" union all ".join(
    f"select cast({i} as bigint) as position, {q(n)} as metric, cast({e} as varchar) as value from gates" if "count" in e and "select" not in e
    else f"select cast({i} as bigint), {q(n)}, cast({e} as varchar)" for i, (n, e) in enumerate(_SUMMARY))))
def batch_summary(spark, sf_dir):
    return reports.batch_summary(scored(spark, sf_dir), V.lines(spark, sf_dir)).withColumn("position", F.col("position").cast("bigint"))


@query("top_flags", with_(V.LINES, select="""
select f as label, count(*) as rows from (
  select row_idx, trim(p) as f, generate_subscripts(string_split_regex(quality_flags, '[\\n;|]'), 1) as pos from lines, unnest(string_split_regex(quality_flags, '[\\n;|]')) t(p))
where f <> '' group by f order by rows desc, min(row_idx), f limit 8""".replace(
    ", generate_subscripts(string_split_regex(quality_flags, '[\\n;|]'), 1) as pos", "").replace("\\n", "\\n")))
def top_flags(spark, sf_dir):
    return reports.top_counts(V.lines(spark, sf_dir), "quality_flags", 8, split=True)


@query("top_friction", with_(V.LINES, select="""
select friction_type as label, count(*) as rows from lines where friction_type <> '' group by 1 order by rows desc, min(row_idx) limit 8"""))
def top_friction(spark, sf_dir):
    return reports.top_counts(V.lines(spark, sf_dir), "friction_type", 8)


@query("dashboard_numbers", with_(GATES, select=f"""
select count(*) as rows, count(distinct lower(company)) as unique_companies, count(*) filter (status = 'Ready') as ready,
  count(*) filter (status = 'Review') as review, count(*) filter (status = 'Research only') as research_only,
  count(*) filter (decision = 'Send') as send, count(*) filter (decision = 'Edit') as edit, count(*) filter (decision = 'Reject') as reject,
  count(*) filter (not bad) as generated, count(*) filter (src) as with_sources, round_even(avg(ev) filter (ev > 0), 1) as avg_evidence,
  round_even(avg(s_score) filter (s_score > 0), 1) as avg_surface, 0.0::double as avg_quality,
  round_even(cast(count(*) filter (status = 'Ready') as double) / count(*) * 100.0, 0) as ready_rate,
  (select c from (select case when vc = '' then 'none' else vc end as c, count(*) as n from gates group by 1)
    order by n desc, list_position(['high', 'medium', 'low', 'none'], c) limit 1) as strongest_visual from gates"""))
def dashboard_numbers(spark, sf_dir):
    return reports.dashboard(scored(spark, sf_dir))


@query("status_counts", with_(V.LINES, select="""
select status, count(*) as rows, cast(case status when 'Ready' then 0 when 'Review' then 1 when 'Research only' then 2 else 9 end as bigint) as position from lines group by status"""))
def status_counts(spark, sf_dir):
    return reports.ordered_status_counts(V.lines(spark, sf_dir)).withColumn("position", F.col("position").cast("bigint"))


@query("row_context", with_(V.LINES, select=f"""
select row_idx, case when line = '' or line like '[%' then '' else 'Hey ' || case when person = '' then '[Name]' else {_NAME}[1] end || chr(10) || chr(10) || line || chr(10) || chr(10)
    || case when role <> '' then 'Curious where ' || company || ' is seeing the biggest drop-off from a ' || role || ' perspective.'
       else 'Curious what''s top of mind at ' || company || ' when it comes to user drop-off and conversion.' end end as template_preview,
  case when walk then 'app walkthrough recommended' else 'not required' end as app_check_status,
  array_to_string({flags_sql(('walk', T.NOTE_APP_WALK), ("visual_confidence = 'low'", T.NOTE_VISUAL), (V.strip_sql('evidence_found') + " = ''", T.NOTE_FIND_ISSUE),
     ("friction_type in ('weak_testimonial_or_case_study', 'weak_or_missing_proof')", T.NOTE_PROOF),
     ("friction_type in ('broad_positioning', 'unclear_value_prop')", T.NOTE_POSITIONING), ("contains(surface_checked, 'app listing')", T.NOTE_APP_LISTING))}, ' ') as recommended_manual_check
from (select *, {V.strip_sql('personalized_line')} as line, product_surface_type = 'app_first_product'
  or {any_sql("lower(website || ' ' || surface_checked)", T.APP_FIRST_MARKERS)} as walk from lines)"""))
def row_context(spark, sf_dir):
    df = V.lines(spark, sf_dir).withColumns({
        "company_name": F.col("company"), "recipient_name": F.col("person"), "recipient_role": F.col("role"),
        "website_url": F.col("website"), "opening_line": F.col("personalized_line"), "campaign_context": F.lit(""),
        "evidence_points": F.col("evidence_found")})
    out = outreach.manual_check(df).withColumn("template_preview", outreach.template_preview())
    return out.select("row_idx", "template_preview", "app_check_status", "recommended_manual_check")


@query("prompt_render", with_(V.LINES, select="""
select row_idx, 'Company: ' || company || chr(10) || 'Line: ' || personalized_line || chr(10) || 'Keep {unknown}' as prompt, sha256(text) as text_key from lines"""))
def prompt_render(spark, sf_dir):
    df = V.lines(spark, sf_dir).withColumn("template", F.lit("Company: {company}\nLine: {personalized_line}\nKeep {unknown}"))
    return df.select("row_idx", prompts.render("template", ["company", "personalized_line"]).alias("prompt"), prompts.page_key("text").alias("text_key"))


# --- run rows ----------------------------------------------------------------------------------------
@query("send_confidence", with_(_COPYFLAGS, select=f"""
select row_idx, case when not list_has_any(cflags, {items(T.SERIOUS_FLAGS)}) and row_idx % 12 >= 8 and not list_has_any(cflags, {items(T.BLOCKING_QC_FLAGS)}) and row_idx % 6 >= 3
  then 'send' else 'review' end as send_confidence from cf"""))
def send_confidence(spark, sf_dir):
    k = F.col("row_idx")
    df = copyguard.copy_flags(_drafts(spark, sf_dir)).withColumns({
        "model_flags": F.array().cast("array<string>"), "model_score": k % 12, "model_pass": F.lit(True),
        "evidence_strength_score": k % 6, "research_review": F.lit(False)})
    df = copyguard.needs_review(copyguard.merge_qc(df), carried=["research_review"], all_flags="qc_flags")
    return df.select("row_idx", copyguard.send_confidence().alias("send_confidence"))


@query("run_stamp", with_(V.LINES, select=f"""
select row_idx, run_id, row_id, {_stable('run_id', 'row_id', 'company', 'person', V.strip_sql('personalized_line'))} as example_id, 'h1' as write_prompt_hash, 't1' as tone_profile_hash from lines"""))
def run_stamp(spark, sf_dir):
    rows = run_rows(spark, sf_dir)
    return canonical.stamp_run(rows, "run_x", {"write_prompt_hash": "h1"}, "t1").select(
        "row_idx", "run_id", "row_id", "example_id", "write_prompt_hash", "tone_profile_hash")


@query("run_counts", with_(V.LINES, select=f"""
select count(*) as rows, count(*) filter ({V.strip_sql('personalized_line')} <> '') as generated, count(*) filter (needs_manual_review = 'yes') as needs_review,
  cast(0 as bigint) as timed, cast(0 as bigint) as in_test, cast(0 as bigint) as in_sequence from lines"""))
def run_counts(spark, sf_dir):
    return reports.run_counts(run_rows(spark, sf_dir))


@query("strongest_visual", with_(V.LINES, select="""
select c as class, n as rows from (select case when visual_confidence = '' then 'none' else visual_confidence end as c, count(*) as n from lines group by 1)
order by n desc, list_position(['high', 'medium', 'low', 'none'], c) limit 1"""))
def strongest_visual(spark, sf_dir):
    return reports.strongest_class(V.lines(spark, sf_dir), "visual_confidence", ["high", "medium", "low", "none"])


@query("email_log", with_(V.LINES, select=f"""
select run_id, row_id, company, person, website, model_name, {V.strip_sql('personalized_line')} as personalized_line from (select * replace ({V.strip_sql('person')} as person) from lines)"""))
def email_log(spark, sf_dir):
    from quillgate.sources.tables import email_log_rows

    return email_log_rows(run_rows(spark, sf_dir), "2024-02-01").select(
        "run_id", "row_id", "company", "person", "website", "model_name", "personalized_line")


@query("profile_resolution", with_(V.LINES, select="""
select row_idx, 'friction_first' as resolved_profile from lines where tone_profile <> 'proof_led' union all select row_idx, 'proof_led' from lines where tone_profile = 'proof_led'"""))
def profile_resolution(spark, sf_dir):
    from quillgate.sources.dims import profile_dimension, with_profile

    rows = V.lines(spark, sf_dir)
    names = rows.filter(F.col("tone_profile") != "").select(F.col("tone_profile").alias("name")).distinct()
    return with_profile(rows, profile_dimension(names.withColumn("description", F.lit("d")))).select("row_idx", "resolved_profile")


@query("reviewer_table", with_(GATES, select="select decision as sendability_decision, company, person, role, website, tone_profile from (select * replace (trim(person) as person) from gates)"))
def reviewer_table(spark, sf_dir):
    return delivery.reviewer_table(scored(spark, sf_dir)).select("sendability_decision", "company", "person", "role", "website", "tone_profile")
