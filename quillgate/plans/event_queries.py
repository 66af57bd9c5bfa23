"""Queries over sends, experiments, facts, attempts, follow-up steps and prompts."""

from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import text as X
from quillgate.functions.json import parse_object
from quillgate.operators import evidence as E
from quillgate.operators import evals, experiments, feedback, prompts, reports, sequences
from quillgate.operators.order import running
from quillgate.operators.rows import append_with_ids, last_per_key, resume_split, append_rows
from quillgate.plans import views as V
from quillgate.plans.registry import any_sql, dedupe_sql, flags_sql, items, join_sql, pct_sql, q, query, with_

# --- funnels ------------------------------------------------------------------------------------
_N = "count(*) as total, count(*) filter (was_opened) as opened, count(*) filter (got_reply) as replied, count(*) filter (converted) as converted"
_RATE = pct_sql("converted", "total")


@query("funnel_totals", with_(V.SENDS, select=f"""
select total as total_sends, opened, replied, converted, {pct_sql('opened', 'total')} as open_rate, {pct_sql('replied', 'total')} as reply_rate,
  {_RATE} as conversion_rate, cast(round_even(m, 0) as bigint) as avg_reply_time_minutes
from (select {_N}, avg(time_to_reply_minutes) filter (time_to_reply_minutes > 0) as m from sends)"""))
def funnel_totals(spark, sf_dir):
    return feedback.funnel_totals(V.sends(spark, sf_dir))


@query("funnel_by_friction", with_(V.SENDS, select=f"""
select *, {_RATE} as conversion_rate from (select friction_type, {_N} from sends where friction_type <> '' group by 1)"""))
def funnel_by_friction(spark, sf_dir):
    return feedback.funnel_by_friction(V.sends(spark, sf_dir))


@query("funnel_by_angle", with_(V.SENDS, select=f"""
select *, {_RATE} as conversion_rate from (
  select case when contains(chosen_angle, ':') then split_part(chosen_angle, ':', 1) else '' end as angle_category, {_N} from sends where chosen_angle <> '' group by 1)"""))
def funnel_by_angle(spark, sf_dir):
    return feedback.funnel_by_angle(V.sends(spark, sf_dir))


_PATTERNS = """patterns as (
  select chosen_angle, friction_type, surface_checked, min(conversion_outcome) as conversion_outcome, count(*) as times_used, count(*) filter (converted) as conversions,
    count(*) filter (got_reply) as replies, count(*) filter (was_opened) as opens, round(count(*) filter (converted)::double / count(*) * 100.0, 1) as conv_rate
  from sends where chosen_angle <> '' group by 1, 2, 3),
plines as (select distinct chosen_angle, friction_type, surface_checked, opening_line from sends where chosen_angle <> '')"""


@query("patterns_success", with_(V.SENDS, _PATTERNS, select="""
select p.*, (select count(*) from plines l where l.chosen_angle = p.chosen_angle and l.friction_type = p.friction_type and l.surface_checked = p.surface_checked) as example_lines,
  (select string_agg(opening_line, '|' order by opening_line) from (select opening_line from plines l where l.chosen_angle = p.chosen_angle and l.friction_type = p.friction_type
    and l.surface_checked = p.surface_checked order by opening_line limit 2)) as examples
from (select * from patterns order by conversions desc, conv_rate desc, chosen_angle, friction_type, surface_checked limit 20) p"""))
def patterns_success(spark, sf_dir):
    return feedback.success_patterns(V.sends(spark, sf_dir))


@query("pattern_lines", with_(V.SENDS, select="""
select chosen_angle, friction_type, surface_checked, opening_line, count(*) as times_used from sends where chosen_angle <> '' group by all"""))
def pattern_lines(spark, sf_dir):
    return feedback.pattern_lines(V.sends(spark, sf_dir))


@query("patterns_failing", with_(V.SENDS, _PATTERNS, select="""
select chosen_angle, friction_type, surface_checked, times_used, conversions, conv_rate from patterns where times_used >= 2 and conversions = 0
order by times_used desc, chosen_angle, friction_type, surface_checked limit 20"""))
def patterns_failing(spark, sf_dir):
    return feedback.failing_patterns(V.sends(spark, sf_dir))


@query("feedback_context")
def feedback_context(spark, sf_dir):
    return feedback.feedback_context(V.sends(spark, sf_dir))


@query("latest_run", with_(V.SENDS, select="select max(run_id) as run_id from sends"))
def latest_run(spark, sf_dir):
    return feedback.latest_run(V.sends(spark, sf_dir))


@query("sends_of_run", with_(V.SENDS, select="select row_id, updated_at, opening_line from sends where run_id = 'run_2024-01-15'"))
def sends_of_run(spark, sf_dir):
    return feedback.newest_first(V.sends(spark, sf_dir), "run_2024-01-15").select("row_id", "updated_at", "opening_line")


@query("sends_awaiting", with_(V.SENDS, select="select run_id, row_id from sends where not (was_opened or got_reply or converted)"))
def sends_awaiting(spark, sf_dir):
    return feedback.awaiting(V.sends(spark, sf_dir)).select("run_id", "row_id")


@query("pending_feedback", with_(V.LINES, select=f"""
select run_id, row_id, {V.strip_sql('personalized_line')} as opening_line, company as company_name, false as was_opened from lines
where {V.strip_sql('personalized_line')} <> '' and personalized_line not like '[%'"""))
def pending_feedback(spark, sf_dir):
    df = V.lines(spark, sf_dir).withColumnsRenamed({"personalized_line": "opening_line", "company": "company_name"})
    return feedback.pending_rows(df, "2024-02-01 00:00:00").select("run_id", "row_id", "opening_line", "company_name", "was_opened")


def _results(spark, sf_dir):
    """Partial results for the sends: two reviews each, named by row id or example id."""
    s = V.sends(spark, sf_dir)
    k = F.col("event_id")
    base = s.select("run_id", "row_id", "example_id", "event_id", "k", F.explode(F.array(F.lit(1), F.lit(2))).alias("turn"))
    return base.select(
        "run_id",
        F.when(F.col("example_id") == "", F.col("row_id")).otherwise("").alias("row_id"),
        F.when(k % 10 == 9, F.concat(F.lit("no_"), "row_id")).otherwise(F.col("example_id")).alias("example_id"),
        F.when(F.col("turn") == 1, F.lit(True)).alias("was_opened"),
        F.when(k % 4 == 0, (F.col("turn") == 2)).alias("got_reply"),
        F.when(k % 5 == 0, F.concat(F.lit("text "), F.col("turn").cast("string"))).alias("reply_text"),
        F.concat(F.lit("2024-02-0"), F.col("turn").cast("string")).alias("reviewed_at"))


@query("ingest_results", with_(V.SENDS, select="""
select run_id, row_id, case when hit then true else was_opened end as was_opened, case when hit and event_id % 4 = 0 then true else got_reply end as got_reply,
  case when hit and event_id % 5 = 0 then 'text 2' end as reply_text, hit as was_updated from (select *, event_id % 10 <> 9 as hit from sends)"""))
def ingest_results(spark, sf_dir):
    return feedback.ingest_results(V.sends(spark, sf_dir), _results(spark, sf_dir)).select(
        "run_id", "row_id", "was_opened", "got_reply", "reply_text", "was_updated")


@query("known_results", with_(V.SENDS, select="select count(*) as rows from sends where event_id % 3 <> 0 and event_id % 10 <> 9"))
def known_results(spark, sf_dir):
    res = _results(spark, sf_dir).filter((F.col("row_id") != "") & (F.col("reviewed_at") == "2024-02-01"))
    res = res.filter(~F.col("example_id").startswith("no_"))
    return feedback.known_results(res, V.sends(spark, sf_dir)).agg(F.count(F.lit(1)).alias("rows"))


@query("upsert_feedback", with_(V.SENDS, select="""
select run_id, row_id, created_at, case when was_opened then 'new' else friction_type end as friction_type from sends where friction_type <> ''
union all select run_id, row_id, '2024-03-01', 'new' from sends where friction_type = '' and was_opened"""))
def upsert_feedback(spark, sf_dir):
    s = V.sends(spark, sf_dir).select("run_id", "row_id", "friction_type", "created_at", "updated_at", "was_opened")
    old = s.filter(F.col("friction_type") != "").drop("was_opened")
    new = s.filter("was_opened").withColumns({
        "friction_type": F.lit("new"), "created_at": F.lit("2024-03-01"), "updated_at": F.lit("2024-03-01")}).drop("was_opened")
    return feedback.save(old, new).select("run_id", "row_id", "created_at", "friction_type")


@query("dedupe_keep_last", with_(V.SENDS, select="""
select run_id as campaign_name, lead_id as person, cast(max(event_id) as bigint) as last_event from sends where was_opened group by 1, 2"""))
def dedupe_keep_last(spark, sf_dir):
    yes = lambda c: F.when(F.col(c), "yes").otherwise("")
    rows = V.sends(spark, sf_dir).select(
        F.col("run_id").alias("campaign_name"), F.lit("c").alias("company"), F.col("lead_id").alias("person"), F.lit("l").alias("delivered_line"),
        yes("was_opened").alias("opened"), yes("got_reply").alias("replied"), "event_id")
    rows = evals.normalize_campaign(rows, "2024-02-01")
    old, new = rows.filter(F.col("replied") == ""), rows.filter(F.col("replied") != "")
    kept = last_per_key(append_rows(old, new), ["campaign_name", "company", "person", "delivered_line"], ["imported_at", "event_id"])
    return kept.select("campaign_name", "person", F.col("event_id").alias("last_event"))


# --- experiments -----------------------------------------------------------------------------------
@query("ab_assign_hash", with_(V.EXPERIMENT_SENDS, select="select experiment_id, lead_id, event_id, lead_hash, variant_id from esends"))
def ab_assign_hash(spark, sf_dir):
    return V.experiment_sends(spark, sf_dir).select("experiment_id", "lead_id", "event_id", "lead_hash", "variant_id")


_VCOLS = f"{pct_sql('opened', 'total')} as open_rate, {pct_sql('replied', 'total')} as reply_rate, {_RATE} as conversion_rate"


@query("ab_results", with_(V.EXPERIMENT_SENDS, select=f"select *, {_VCOLS} from variants"))
def ab_results(spark, sf_dir):
    return experiments.variant_results(V.experiment_results(spark, sf_dir))


_CELL = lambda o, e: f"(greatest(abs({o} - {e}) - 0.5::double, 0.0::double) ** 2 / {e})"
_POLY = "(((((1.061405429::double * t + -1.453152027::double) * t + 1.421413741::double) * t + -0.284496736::double) * t + 0.254829592::double) * t)"
_Z = "1.96::double"
_SIG = V.EXPERIMENT_SENDS + f""",
vs as (select v.*, first_value(variant_id) over w as control_id, first_value(total) over w as cn, first_value(converted) over w as cs from variants v
  window w as (partition by experiment_id order by variant_id rows between unbounded preceding and unbounded following)),
s1 as (select *, (cs + converted)::double / (cn + total) as pool from vs),
s2 as (select *, {_CELL('cs', '(cn * pool)')} + {_CELL('converted', '(total * pool)')} + {_CELL('(cn - cs)', '(cn * (1 - pool))')}
  + {_CELL('(total - converted)', '(total * (1 - pool))')} as chi2 from s1),
s3 as (select *, 1.0 / (1.0 + 0.3275911::double * sqrt(chi2)) as t, variant_id <> control_id and total >= 30 and cn >= 30 as tested from s2),
s4 as (select *, case when not tested then null when pool <= 0 or pool >= 1 or chi2 <= 0 then 1.0
  else least(1.0, greatest(0.0, 0.5 * (1.0 - (1.0 - {_POLY} * exp(-chi2 / 2.0))))) end as p,
  converted::double / total as rate, 1 + {_Z} * {_Z} / total as den from s3),
sig as (select *, {_VCOLS}, round_even(p, 4) as p_value, coalesce(p < 0.05 and rate > cs::double / cn, false) as significant_winner, total >= 30 as enough_data,
  greatest(0.0, (rate + {_Z} * {_Z} / (2 * total)) / den - {_Z} * sqrt((rate * (1 - rate) + {_Z} * {_Z} / (4 * total)) / total) / den) as lo,
  least(1.0, (rate + {_Z} * {_Z} / (2 * total)) / den + {_Z} * sqrt((rate * (1 - rate) + {_Z} * {_Z} / (4 * total)) / total) / den) as hi from s4)"""


@query("ab_significance", with_(_SIG, select="select experiment_id, variant_id, control_id, total, converted, p_value, significant_winner, enough_data from sig"))
def ab_significance(spark, sf_dir):
    res = experiments.variant_results(V.experiment_results(spark, sf_dir))
    return experiments.significance(res).select(
        "experiment_id", "variant_id", "control_id", "total", "converted", "p_value", "significant_winner", "enough_data")


@query("ab_wilson", with_(_SIG, select="select experiment_id, variant_id, round_even(lo * 100, 1) as ci_low, round_even(hi * 100, 1) as ci_high from sig"))
def ab_wilson(spark, sf_dir):
    res = experiments.variant_results(V.experiment_results(spark, sf_dir))
    return experiments.wilson_intervals(res).select("experiment_id", "variant_id", "ci_low", "ci_high")


@query("ab_report", with_(_SIG, select="""
select experiment_id, variants, total_leads, status, winner_variant_id, is_significant, p_value, case
    when variants < 2 then 'Nog onvoldoende data — wacht tot minstens 2 varianten resultaten hebben.'
    when status = 'significant' then 'WINNAAR: ''' || winner_variant_id || ''' met ' || rate || '% conversie (p=' || rtrim_p || '). Schaal deze variant op.'
    when status = 'inconclusive' then 'Geen statistisch significant verschil. Beste performer: ''' || winner_variant_id || ''' (' || rate || '%), maar niet significant. Verzamel meer data of pas varianten aan.'
    else 'Te weinig data — minstens 30 per variant nodig. Huidige voorloper: ''' || winner_variant_id || ''' (' || rate || '%).' end as recommendation
from (
  select *, regexp_replace(printf('%.4f', arg_p), '(\\.\\d+?)0+$', '\\1') as rtrim_p from (
    select experiment_id, count(*) as variants, cast(sum(total) as bigint) as total_leads,
      case when count(*) < 2 then 'running' when bool_or(significant_winner) then 'significant' when bool_and(enough_data) then 'inconclusive' else 'running' end as status,
      case when count(*) >= 2 then coalesce(arg_max(variant_id, [conversion_rate, -vi]) filter (significant_winner), arg_max(variant_id, [conversion_rate, -vi])) end as winner_variant_id,
      case when count(*) >= 2 then coalesce(arg_max(conversion_rate, [conversion_rate, -vi]) filter (significant_winner), max(conversion_rate)) end as rate,
      coalesce(arg_max(p_value, [conversion_rate, -vi]) filter (significant_winner), 0) as arg_p,
      case when count(*) >= 2 then arg_min(p_value, variant_id) filter (significant_winner) end as p_value,
      count(*) >= 2 and bool_or(significant_winner) as is_significant
    from (select *, list_position(['a_control', 'b_proof', 'c_short'], variant_id) as vi from sig) group by experiment_id))"""))
def ab_report(spark, sf_dir):
    res = experiments.variant_results(V.experiment_results(spark, sf_dir))
    return experiments.report(experiments.significance(res)).select(
        "experiment_id", "variants", "total_leads", "status", "winner_variant_id", "is_significant", "p_value", "recommendation")


@query("ab_posteriors", with_(V.EXPERIMENT_SENDS, select="""
select experiment_id, variant_id, (1 + converted)::double as alpha, (1 + total - converted)::double as beta,
  round((1 + converted)::double / (2 + total), 6) as mean, total::double as samples from variants"""))
def ab_posteriors(spark, sf_dir):
    res = experiments.variant_results(V.experiment_results(spark, sf_dir))
    return experiments.posteriors(res).select("experiment_id", "variant_id", "alpha", "beta", F.round("mean", 6).alias("mean"), "samples")


def _experiment_leads(spark, sf_dir):
    return V.experiment_sends(spark, sf_dir).select("experiment_id", "lead_id").distinct()


_DIGITS = lambda h, first, count: f"((('0x' || substr({h}, {first}, {count}))::bigint::double + 0.5::double) / {16 ** count}::double)"
_LEADS = V.EXPERIMENT_SENDS + """,
xleads as (select distinct experiment_id, lead_id from esends)"""
_FIXED = _LEADS + f""",
fixed as (select experiment_id, lead_id, case when u < 0.5 then 'a_control' when u < 0.75 then 'b_proof' else 'c_short' end as variant_id from (
  select *, {_DIGITS('h', 1, 13)} as u from (select *, md5(experiment_id || ':' || lead_id || ':7') as h from xleads)))"""
_THOMPSON = _LEADS + f""",
shapes as (
  select xleads.experiment_id, lead_id, v as variant_id, pos, side, case side when 'a' then 1.0::double + coalesce(converted, 0) else 1.0::double + coalesce(total - converted, 0) end as shape
  from xleads, (select unnest({items(V.VARIANTS)}) as v, unnest(range(3)) as pos), (select unnest(['a', 'b']) as side)
  left join variants on variants.experiment_id = xleads.experiment_id and variants.variant_id = v),
tries as (
  select *, sqrt(-2.0::double * ln({_DIGITS('h', 1, 11)})) * cos(2.0::double * pi() * {_DIGITS('h', 12, 11)}) as normal, ln({_DIGITS('h', 23, 10)}) as refusal from (
    select *, shape - 1.0::double / 3.0::double as d, md5(experiment_id || ':' || lead_id || ':' || variant_id || ':7:' || side || ':' || i) as h
    from shapes, (select unnest(range({experiments.TRIES})) as i))),
cubes as (select *, base * base * base as cube from (select *, 1.0::double + normal / sqrt(9.0::double * d) as base from tries)),
gammas as (
  select experiment_id, lead_id, variant_id, pos, side, coalesce(arg_min(d * cube, i) filter (
    case when base > 0 then refusal < 0.5::double * normal * normal + d - d * cube + d * ln(cube) else false end), any_value(d)) as g from cubes group by all),
thompson as (
  select experiment_id, lead_id, arg_max(variant_id, [draw, -pos]) as variant_id from (
    select experiment_id, lead_id, variant_id, pos, max(g) filter (side = 'a') / (max(g) filter (side = 'a') + max(g) filter (side = 'b')) as draw
    from gammas group by all) group by all)"""


@query("ab_thompson", with_(_THOMPSON, select="select experiment_id, lead_id, variant_id from thompson"))
def ab_thompson(spark, sf_dir):
    res = experiments.variant_results(V.experiment_results(spark, sf_dir))
    return experiments.assign_thompson(_experiment_leads(spark, sf_dir), res, V.VARIANTS, seed=7)


_WEIGHTS = {"a_control": 2.0, "b_proof": 1.0, "c_short": 1.0}


@query("ab_fixed", with_(_FIXED, select="select experiment_id, lead_id, variant_id from fixed"))
def ab_fixed(spark, sf_dir):
    return experiments.assign_fixed(_experiment_leads(spark, sf_dir), _WEIGHTS, seed=7)


def _sticky_sql(strategy):
    return f"""
select experiment_id, lead_id, v as variant_id, experiment_id <> 'exp_0' as is_new, case when v = 'a_control' then 'Control' else v end as variant_label
from (select experiment_id, lead_id, case when experiment_id = 'exp_0' then 'b_proof' else variant_id end as v from {strategy})"""


def _sticky(spark, sf_dir, strategy, **how):
    rows = _experiment_leads(spark, sf_dir)
    known = rows.filter(F.col("experiment_id") == "exp_0").withColumn("variant_id", F.lit("b_proof"))
    out = experiments.assign(rows, known, strategy, V.VARIANTS, labels={"a_control": "Control"}, seed=7, **how)
    return out.select("experiment_id", "lead_id", "variant_id", "is_new", "variant_label")


@query("ab_sticky_fixed", with_(_FIXED, select=_sticky_sql("fixed")))
def ab_sticky_fixed(spark, sf_dir):
    return _sticky(spark, sf_dir, "fixed", weights=_WEIGHTS)


@query("ab_sticky_thompson", with_(_THOMPSON, select=_sticky_sql("thompson")))
def ab_sticky_thompson(spark, sf_dir):
    return _sticky(spark, sf_dir, "thompson", results=experiments.variant_results(V.experiment_results(spark, sf_dir)))


@query("ab_recorded", with_(V.EXPERIMENT_SENDS, select="""
select experiment_id, variant_id, lead_id, coalesce(max(recorded_at) filter (fresh), max(recorded_at)) as recorded_at,
  coalesce(arg_max(converted, recorded_at) filter (fresh), arg_max(converted, recorded_at)) as converted
from (select *, stamp || ' ' || lpad(event_id::varchar, 9, '0') as recorded_at, event_id % 3 = 0 as fresh from (select *, sent_at as stamp from esends)) group by all"""))
def ab_recorded(spark, sf_dir):
    """Recorded results, of which a later import replaces those of the same lead."""
    rows = V.experiment_sends(spark, sf_dir).select(
        "experiment_id", "variant_id", "lead_id", F.concat("sent_at", F.lit(" "), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("recorded_at"),
        "converted", (F.col("event_id") % 3 == 0).alias("fresh"))
    old, new = rows.filter("not fresh").drop("fresh"), rows.filter("fresh").drop("fresh")
    return experiments.record_results(old, new).select("experiment_id", "variant_id", "lead_id", "recorded_at", "converted")


@query("ab_sticky", with_(V.EXPERIMENT_SENDS, select=_sticky_sql("(select distinct experiment_id, lead_id, variant_id from esends)")))
def ab_sticky(spark, sf_dir):
    return _sticky(spark, sf_dir, "random")


@query("ab_registry", with_(V.EXPERIMENT_SENDS, select="""
select experiment_id, cast(pos as bigint) as variant_pos, variant_id, 'Label ' || variant_id as label from (
  select distinct experiment_id from esends where experiment_id <> 'exp_2'), (values (0, 'a_control'), (1, 'b_proof'), (2, 'c_short')) t(pos, variant_id)"""))
def ab_registry(spark, sf_dir):
    ids = V.experiment_sends(spark, sf_dir).select("experiment_id").distinct()
    item = lambda v: F.struct(F.lit(v).alias("variant_id"), F.lit(f"Label {v}").alias("label"))
    new = ids.select("experiment_id", F.to_json(F.array(*map(item, V.VARIANTS))).alias("variants_json"),
                     (F.col("experiment_id") != "exp_2").alias("enabled"), F.lit("2024-02-01").alias("created_at"), F.lit("2024-02-01").alias("updated_at"))
    old = new.withColumns({"enabled": F.lit(True), "updated_at": F.lit("2024-01-01"), "variants_json": F.lit("[]")})
    return experiments.variants_of(experiments.active(experiments.register(old, new))).select(
        "experiment_id", F.col("variant_pos").cast("bigint").alias("variant_pos"), "variant_id", "label")


# --- facts ---------------------------------------------------------------------------------------------
_FRK = items(list(T.FRICTION_PRIORITY))
_FACTS = V.FACTS + f""",
f0 as (select *, lower(concat_ws(' ', fact, why_it_matters, surface_checked, conversion_outcome, why_this_angle)) as ev,
  lower(concat_ws(' ', fact, why_it_matters, friction_type, surface_checked, conversion_outcome, why_this_angle)) as al, lower(surface_checked) as surf from facts),
f1 as (select *, list_contains({_FRK}, friction_type) as known,
  (list_contains({_FRK}, friction_type) and friction_type <> 'other_specific_friction') or {any_sql('ev', T.FACT_FRICTION_TERMS)} as visible,
  {any_sql('al', T.BUG_TERMS)} as bug, {any_sql('al', T.CTA_TERMS)} as cta, {any_sql('al', T.FLOW_TERMS)} as flow,
  case when {any_sql('al', ['visual confidence: high', 'high-confidence'])} then 0 when {any_sql('al', ['visual confidence: medium', 'medium-confidence'])} then 1
    when {any_sql('al', ['visual confidence: low', 'low-confidence'])} then 3 else 2 end as vr from f0),
f2 as (select *, {flags_sql(('too_generic_to_use', 'generic_evidence'), ("blog_used or friction_type = 'blog_low_priority' or contains(surf, 'blog')", 'blog_angle_low_value'),
    ('not known', 'unsupported_friction_type'), ('not visible', 'missing_visible_friction'),
    ("not (conversion_outcome <> '' or " + any_sql('al', T.OUTCOME_TERMS + ['trust']) + ")", 'missing_outcome_tie'),
    (any_sql('al', T.POSITIVE_ONLY_TERMS) + ' and not visible', 'positive_observation_only'),
    ("vr = 3 and (" + any_sql('al', T.VISUAL_FACT_TERMS) + f" or list_contains({items(T.VISUAL_FRICTION)}, friction_type))", 'low_confidence_visual_finding'))} as reasons,
  case when friction_type = 'broken_formatting' or bug then 0 when list_contains({items(T.FLOW_FRICTION)}, friction_type) or flow then 1
    when friction_type = 'low_visibility_cta' or cta then 2 when list_contains({items(T.PROOF_FRICTION)}, friction_type) or {any_sql('al', T.PROOF_TERMS)} then 3
    when list_contains({items(T.POSITIONING_FRICTION)}, friction_type) or {any_sql('al', T.POSITIONING_TERMS)} then 4
    when friction_type = 'app_store_signal' and {any_sql('al', T.APP_FIRST_TERMS)} then 1 when friction_type = 'app_store_signal' then 5
    else coalesce(map {{{", ".join(f"{q(k)}: {v}" for k, v in T.FRICTION_PRIORITY.items())}}}[friction_type], 99) end as bucket,
  case when {any_sql('al', T.MICRO_UX_TERMS)} and not (bug or cta or flow) then 2 else 0 end as micro,
  case strength when 'strong' then 0 when 'medium' then 1 when 'weak' then 2 else 3 end as sr,
  case when {any_sql('surf', ['app onboarding', 'signup', 'checkout', 'booking'])} or {any_sql('ev', T.TOP_SURFACE_TERMS)} then 0
    when {any_sql('surf', ['app listing', 'app-store', 'google play'])} then 1 when contains(surf, 'mobile') or contains(ev, 'screenshot') then 2
    when {any_sql('surf', ['landing', 'homepage', 'website'])} then 3 when {any_sql('surf', ['case study', 'testimonial'])} then 4 when contains(surf, 'blog') then 7 else 5 end as fr,
  case when angle_priority > 0 then angle_priority else 9 end as ep from f1),
ranked as (select *, row_number() over (partition by lead_id order by bucket, micro, sr, vr, fr, ep, length(fact), fact_pos) as rank from f2 where len(reasons) = 0)"""


def scored_facts(spark, sf_dir):
    return E.score_facts(V.facts(spark, sf_dir))


@query("fact_scores", with_(_FACTS, select=f"""
select lead_id, cast(fact_pos as bigint) as fact_pos, {join_sql('reasons')} as block_reasons, cast(bucket as bigint) as angle_bucket, cast(micro as bigint) as micro_penalty,
  cast(sr as bigint) as strength_rank, cast(vr as bigint) as visual_rank, cast(fr as bigint) as surface_rank from f2"""))
def fact_scores(spark, sf_dir):
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return scored_facts(spark, sf_dir).select(
        "lead_id", big("fact_pos"), X.join_list("block_reasons").alias("block_reasons"), *[big(c) for c in
        ["angle_bucket", "micro_penalty", "strength_rank", "visual_rank", "surface_rank"]])


@query("rank_facts", with_(_FACTS, select="select lead_id, cast(fact_pos as bigint) as fact_pos, fact, cast(rank as bigint) as rank from ranked where rank <= 3"))
def rank_facts(spark, sf_dir):
    return E.rank_allowed(scored_facts(spark, sf_dir)).select(
        "lead_id", F.col("fact_pos").cast("bigint").alias("fact_pos"), "fact", F.col("rank").cast("bigint").alias("rank"))


@query("blocked_facts", with_(_FACTS, select="""
select lead_id, cast(fact_pos as bigint) as fact_pos, fact || ' [' || array_to_string(reasons, ', ') || ']' as blocked_note from f2 where len(reasons) > 0"""))
def blocked_facts(spark, sf_dir):
    return E.blocked_facts(scored_facts(spark, sf_dir)).select("lead_id", F.col("fact_pos").cast("bigint").alias("fact_pos"), "blocked_note")


_SELECTION = """sel as (
  select f.lead_id, count(*) filter (len(f.reasons) = 0) as allowed, count(*) filter (len(f.reasons) > 0) as blocked, any_value(r.fact) as fact,
    any_value(r.strength) as strength, any_value(r.friction_type) as friction from f2 f left join ranked r on r.lead_id = f.lead_id and r.rank = 1 group by 1),
firstflags as (select lead_id, reason, min(fact_pos * 10 + idx) as p from (
  select lead_id, fact_pos, unnest(reasons) as reason, list_position(%s, unnest(reasons)) as idx from f2) group by 1, 2),
blockflags as (select lead_id, string_agg(reason, ' | ' order by p) as fl from firstflags group by 1)""" % items(E.BLOCK_REASONS)


@query("select_angle", with_(_FACTS, _SELECTION, select="""
select s.lead_id, coalesce(fact, '') as fact, allowed as allowed_facts, blocked as blocked_facts,
  case when allowed = 0 then 'manual_review_no_sendable_angle' when strength = 'strong' and friction <> 'app_store_signal' then 'selected_sendable_angle' else 'selected_review_angle' end as decision,
  case when allowed = 0 then fl || ' | angle_gate_no_sendable_friction' else concat_ws(' | ', case when strength <> 'strong' then 'selected_angle_not_strong' end,
    case when friction = 'app_store_signal' then 'app_store_angle_review' end) end as selection_flags
from sel s left join blockflags b on s.lead_id = b.lead_id"""))
def select_angle(spark, sf_dir):
    return E.select_angle(scored_facts(spark, sf_dir)).select(
        "lead_id", X.text("selected.fact").alias("fact"), "allowed_facts", "blocked_facts", "decision", X.join_list("selection_flags").alias("selection_flags"))


_SUPPORT = """sup as (
  select a.lead_id, a.fact as fact, a.friction_type as friction, a.conversion_outcome as outcome, a.strength as st, min(b.rank) as sr
  from ranked a left join ranked b on a.lead_id = b.lead_id and b.rank in (2, 3) and (a.friction_type = b.friction_type
    or a.conversion_outcome = b.conversion_outcome or a.surface_checked = b.surface_checked) where a.rank = 1 group by all)"""


@query("support_fact", with_(_FACTS, _SUPPORT, select=f"""
select s.lead_id, {V.strip_sql("s.friction || ': ' || s.fact || ' Outcome: ' || s.outcome")} as chosen_angle,
  case when b.fact is null then '' else {V.strip_sql("b.friction_type || ': ' || b.fact || ' Outcome: ' || b.conversion_outcome")} end as support_angle,
  cast(greatest(1, (case st when 'strong' then 2 when 'medium' then 1 else 0 end) + coalesce(case b.strength when 'strong' then 2 when 'medium' then 1 else 0 end, 0)) as bigint) as evidence_strength_score
from sup s left join ranked b on b.lead_id = s.lead_id and b.rank = s.sr"""))
def support_fact(spark, sf_dir):
    wide = E.widen_top(E.rank_allowed(scored_facts(spark, sf_dir)))
    out = E.gated_strength(E.angle_texts(E.support_fact(wide)))
    return out.select("lead_id", "chosen_angle", X.text("support_angle").alias("support_angle"), F.col("evidence_strength_score").cast("bigint").alias("evidence_strength_score"))


@query("variant_support", with_(_FACTS, select="""
select a.lead_id, cast(a.rank as bigint) as variant, a.fact, coalesce(arg_min(b.fact, b.rank), '') as support from ranked a
left join ranked b on a.lead_id = b.lead_id and b.rank <= 3 and b.rank <> a.rank and b.friction_type <> 'signup_friction'
  and (a.conversion_outcome = b.conversion_outcome or a.surface_checked = b.surface_checked) where a.rank <= 3 group by 1, 2, 3"""))
def variant_support(spark, sf_dir):
    wide = E.widen_top(E.rank_allowed(scored_facts(spark, sf_dir))).withColumn("excluded_friction", X.lits(["signup_friction"]))
    out = E.variant_support(wide)
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("variant"), F.col(f"fact_{i}.fact").alias("fact"), X.text(f"support_{i}.fact").alias("support")) for i in (1, 2, 3)])
    return out.select("lead_id", F.explode(rows).alias("v")).select("lead_id", "v.*").filter(F.col("fact").isNotNull())


@query("pad_variants", with_(_FACTS, select="""
select r.lead_id, cast(v as bigint) as variant, fact from ranked r join (select lead_id, least(3, max(rank)) as n from ranked group by 1) m on r.lead_id = m.lead_id,
  (select unnest([1, 2, 3]) as v) where r.rank = least(v, n)"""))
def pad_variants(spark, sf_dir):
    return E.pad_variants(E.rank_allowed(scored_facts(spark, sf_dir))).select("lead_id", F.col("variant").cast("bigint").alias("variant"), "fact")


@query("evidence_strength", with_(V.FACTS, select="""
select lead_id, cast(least(5, greatest(1, sum(case when too_generic_to_use then 0 when strength = 'strong' then 2 when strength = 'medium' then 1 else 0 end))) as bigint) as evidence_strength_score
from facts group by 1"""))
def evidence_strength(spark, sf_dir):
    return E.evidence_strength(V.facts(spark, sf_dir))


@query("fact_review", with_(V.FACTS, select="""
select lead_id, count(*) as facts, not bool_or(strength = 'strong' and not too_generic_to_use) as needs_manual_review from facts group by 1"""))
def fact_review(spark, sf_dir):
    return E.strong_fact_review(V.facts(spark, sf_dir)).select("lead_id", "facts", "needs_manual_review")


@query("top_evidence", with_(V.FACTS, select="""
select lead_id, cast(fact_pos as bigint) as fact_pos, fact, friction_type from (select *, row_number() over (partition by lead_id order by too_generic_to_use,
  case when angle_priority = 0 then 99 else angle_priority end, case strength when 'strong' then 0 when 'medium' then 1 when 'weak' then 2 else 3 end, blog_used, fact_pos) as r from facts) where r = 1"""))
def top_evidence(spark, sf_dir):
    return E.top_evidence(V.facts(spark, sf_dir)).select("lead_id", F.col("fact_pos").cast("bigint").alias("fact_pos"), "fact", "friction_type")


@query("format_facts", with_(V.FACTS, select="""
select lead_id, cast(fact_pos as bigint) as fact_pos, fact || ' (' || concat_ws(', ', nullif(strength, ''), case when too_generic_to_use then 'generic' else 'specific' end,
  nullif(friction_type, ''), nullif(surface_checked, ''), nullif(conversion_outcome, '')) || ', source: ' || source_url || ')' as fact_text from facts"""))
def format_facts(spark, sf_dir):
    return E.format_fact_rows(V.facts(spark, sf_dir)).select("lead_id", F.col("fact_pos").cast("bigint").alias("fact_pos"), "fact_text")


@query("parse_facts", with_(V.LINES, select=f"""
select row_idx as lead_id, case when row_idx % 4 = 0 then '' else {V.strip_sql('evidence_found')} end as fact, 'strong' as strength, cast(row_idx % 9 as bigint) as angle_priority, true as too_generic_to_use
from lines where trace_files = ''"""))
def parse_facts(spark, sf_dir):
    k = F.col("row_idx")
    fact = F.to_json(F.struct(F.when(k % 4 != 0, F.col("evidence_found")).alias("fact"), F.lit(" Strong ").alias("strength"), (k % 9).cast("string").alias("angle_priority")))
    body = F.concat(F.lit('{"facts": ["skip me", '), fact, F.lit(']}'))
    reply = F.when(F.col("trace_files") != "", F.lit("no json here")).when(k % 3 == 0, F.concat(F.lit("Sure:\n"), body, F.lit("\nDone"))).otherwise(body)
    rows = V.lines(spark, sf_dir).select(k.alias("lead_id"), reply.alias("reply"))
    return E.parse_facts(rows).select("lead_id", "fact", "strength", F.col("angle_priority").cast("bigint").alias("angle_priority"), "too_generic_to_use")


# --- attempts ------------------------------------------------------------------------------------------
@query("best_attempt", with_(V.ATTEMPTS, select="""
select lead_id, cast(variant as bigint) as variant, cast(iteration as bigint) as iteration, cast(score as bigint) as score, passed from (
  select *, row_number() over (partition by lead_id, variant order by passed desc, score desc, iteration) as r from (
    select *, min(case when passed and score >= 8 then iteration end) over (partition by lead_id, variant) as stop from attempts)
  where stop is null or iteration <= stop) where r = 1"""))
def best_attempt(spark, sf_dir):
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return E.best_attempt(V.attempts(spark, sf_dir)).select("lead_id", big("variant"), big("iteration"), big("score"), "passed")


_BEST = V.ATTEMPTS + """,
ba as (select * from (select *, row_number() over (partition by lead_id, variant order by passed desc, score desc, iteration) as r from (
    select *, min(case when passed and score >= 8 then iteration end) over (partition by lead_id, variant) as stop from attempts)
  where stop is null or iteration <= stop) where r = 1)"""


@query("best_variant", with_(_BEST, select="""
select lead_id, cast(variant as bigint) as best_variant from (select *, row_number() over (partition by lead_id order by needs_review, score desc, serious, variant) as n from (
  select *, min(case when passed and score >= 10 and not serious then variant end) over (partition by lead_id) as cut from ba) where cut is null or variant <= cut) where n = 1"""))
def best_variant(spark, sf_dir):
    return E.best_variant(E.best_attempt(V.attempts(spark, sf_dir))).withColumn("best_variant", F.col("best_variant").cast("bigint"))


@query("option_columns", with_(_BEST, select="""
select lead_id, max(case when variant = 1 then opening_line end) as opening_line_option_1, max(case when variant = 2 then opening_line end) as opening_line_option_2,
  max(case when variant = 3 then opening_line end) as opening_line_option_3 from ba group by 1"""))
def option_columns(spark, sf_dir):
    return E.widen_variants(E.best_attempt(V.attempts(spark, sf_dir)), ["opening_line"])


# --- sequences ---------------------------------------------------------------------------------------------
_SEQ = V.STEPS + f""",
keyed as (select *, case when chosen_angle <> '' then lower(trim(split_part(chosen_angle, ':', 1))) end as ak from kept),
looked as (select *, list(ak) over (partition by lead_id order by step_number rows between unbounded preceding and 1 preceding) as before from keyed),
checked as (select *, {flags_sql(("chosen_angle = ''", 'missing_angle'), ("opening_line = ''", 'missing_opening_line'), ("body_text = ''", 'missing_body_text'),
   ("cta_text = '' and follow_up_type <> 'breakup'", 'missing_cta'),
   ("ak is not null and len(list_filter(coalesce(before, []), lambda a: a is not null and (contains(ak, a) or contains(a, ak)))) > 0", 'repeated_angle'),
   ("opening_line <> '' and length(opening_line) < 20", 'opening_too_short'), ("body_text <> '' and length(body_text) < 30", 'body_too_short'),
   ("follow_up_type <> 'breakup' and " + any_sql("lower(opening_line || ' ' || body_text)", T.GENERIC_FOLLOW_UPS), 'generic_followup_language'))} as flags from looked),
scored as (select *, 8.0::double - ({" + ".join(f"case when list_contains(flags, {q(n)}) then {p}::double else 0 end" for n, p in T.FOLLOW_UP_PENALTIES)}) as raw,
   list_has_any(flags, ['missing_angle', 'missing_opening_line', 'missing_body_text', 'missing_cta', 'repeated_angle', 'generic_followup_language']) as severe from checked)"""


@query("sequence_flags", with_(_SEQ, select=f"""
select lead_id, cast(step_number as bigint) as step_number, follow_up_type, {join_sql('flags')} as quality_flags, greatest(0.0, least(10.0, raw)) as quality_score, severe or raw < 7 as needs_review from scored"""))
def sequence_flags(spark, sf_dir):
    return sequences.check_steps(V.steps(spark, sf_dir)).select(
        "lead_id", F.col("step_number").cast("bigint").alias("step_number"), "follow_up_type", X.join_list("quality_flags").alias("quality_flags"), "quality_score", "needs_review")


_REPLIES = _SEQ.replace("raw_steps as (", "said_steps as (", 1).replace("),\nsteps as (", """),
raw_steps as (
  select lead_id, step_number, case when lead_id % 13 = 5 then 'value' else kind end as kind, case when lead_id % 13 = 5 then '' else chosen_angle end as chosen_angle,
    case when lead_id % 13 = 5 then '' else opening_line end as opening_line, case when lead_id % 13 = 5 then '' else body_text end as body_text,
    case when lead_id % 13 = 5 then '' else cta_text end as cta_text from said_steps),
steps as (""", 1)


@query("step_replies", with_(_REPLIES, select=f"""
select lead_id, cast(step_number as bigint) as step_number, follow_up_type, opening_line, {join_sql('flags')} as quality_flags,
  greatest(0.0, least(10.0, raw)) as quality_score, severe or raw < 7 as needs_review, lead_id % 13 = 5 as reply_failed from scored"""))
def step_replies(spark, sf_dir):
    """Follow-up replies as JSON text, parsed, checked and scored; some replies hold no JSON."""
    fields = ["follow_up_type", "chosen_angle", "opening_line", "body_text", "cta_text", "evidence_used_for_copy"]
    body = F.to_json(F.struct(*fields))
    reply = F.when(F.col("lead_id") % 13 == 5, "no reply").when(F.col("step_number") == 2, F.concat(F.lit("Step: "), body)).otherwise(body)
    steps = sequences.parse_steps(V.steps(spark, sf_dir).withColumn("reply", reply))
    return sequences.check_steps(steps).select(
        "lead_id", F.col("step_number").cast("bigint").alias("step_number"), "follow_up_type", "opening_line",
        X.join_list("quality_flags").alias("quality_flags"), "quality_score", "needs_review", "reply_failed")


@query("sequence_status", with_(_SEQ, select="""
select lead_id, count(*) as steps, coalesce(round_even(avg(raw) filter (raw > 0), 1), 0.0) as overall_quality_score, bool_or(severe or raw < 7) as needs_review,
  case when bool_or(severe or raw < 7) then 'needs_review' else 'qc_passed' end as sequence_status from scored group by 1"""))
def sequence_status(spark, sf_dir):
    return sequences.sequence_status(sequences.check_steps(V.steps(spark, sf_dir)))


@query("sequence_rows", with_(_SEQ, select="""
select lead_id, 'base' as company, cast(step_number as bigint) as sequence_step, 'user' = role_text or 'assistant' = role_text or 'system' = role_text as has_evidence,
  case when raw >= 5 then 'keep' else 'drop' end as verdict from (select s.*, c.role as role_text from scored s join conversations c on c.conv_id = s.lead_id and c.turn + 1 = s.step_number)"""))
def sequence_rows(spark, sf_dir):
    checked = sequences.check_steps(V.steps(spark, sf_dir))
    base = V.steps(spark, sf_dir).select("lead_id").distinct().withColumn("company", F.lit("base"))
    rows = sequences.sequence_rows(base, checked)
    return rows.select("lead_id", "company", F.col("sequence_step").cast("bigint").alias("sequence_step"), (F.col("sequence_evidence_used") != "").alias("has_evidence"),
                       F.when(F.col("sequence_quality_score") >= 5, "keep").otherwise("drop").alias("verdict"))


@query("step_grid", f"""
select conv_id as lead_id, cast(i as bigint) as step_number, ({items(T.STEP_STRATEGIES)})[i] as step_strategy, case when i < 4 then 'has not replied' else 'no reply after previous follow-ups' end as reply_status
from (select conv_id, count(*) as turns from conversations group by 1), (select unnest([1, 2, 3, 4]) as i) where least(1.0, turns * 0.2) >= 0.6""")
def step_grid(spark, sf_dir):
    turns = V.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("lead_id")).agg(F.count(F.lit(1)).alias("n"))
    rows = turns.withColumns({
        "send_confidence": F.lit("send"), "research_depth": F.round(F.least(F.lit(1.0), F.col("n") * 0.2), 2)})
    return sequences.step_grid(sequences.eligible(rows)).select("lead_id", F.col("step_number").cast("bigint").alias("step_number"), "step_strategy", "reply_status")


@query("unused_evidence", with_(V.LINES, select="""
select row_idx, array_to_string(list_filter([surface_checked, conversion_outcome, friction_type, status, lang_run], lambda x: x not in (surface_checked, status))[1:3], ' | ') as remaining
from (select *, run_id as lang_run from lines)"""))
def unused_evidence(spark, sf_dir):
    rest = sequences.unused_evidence(F.array("surface_checked", "conversion_outcome", "friction_type", "status", "run_id"), F.array("surface_checked", "status"))
    return V.lines(spark, sf_dir).select("row_idx", X.join_list(rest).alias("remaining"))


@query("follow_up_ids", "select conv_id * 1000000 + turn as call_key, (select count(*) from events) + row_number() over (order by conv_id, turn) || '' as row_id from conversations")
def follow_up_ids(spark, sf_dir):
    main = V.sends(spark, sf_dir).select("row_id")
    extra = V.prompts(spark, sf_dir).select("call_key")
    return append_with_ids(main, extra, "call_key").filter(F.col("call_key").isNotNull()).select("call_key", "row_id")


# --- prompts -----------------------------------------------------------------------------------------------
_PRICE = lambda i: "case model_name " + " ".join(f"when {q(k)} then {v[i]}::double" for k, v in T.MODEL_PRICES.items()) + f" else {T.DEFAULT_PRICE[i]}::double end"
_TOK = lambda c: f"greatest(1, cast(round_even(length({c}) / 4.0::double, 0) as int))"
_CALLS = V.PROMPTS + f""",
calls as (select *, {_TOK('system_prompt')} + {_TOK('user_payload')} as input_tokens, {_TOK('system_prompt')} as output_tokens from prompts)"""


def _calls(spark, sf_dir):
    return prompts.with_tokens(V.prompts(spark, sf_dir)).withColumn("output_tokens", X.token_estimate("system_prompt"))


@query("prompt_cost", with_(_CALLS, select=f"""
select call_key, cast(input_tokens as bigint) as input_tokens, {_PRICE(0)} as input_price, round(input_tokens / 1000000.0::double * {_PRICE(0)} + output_tokens / 1000000.0::double * {_PRICE(1)}, 12) as cost_usd from calls"""))
def prompt_cost(spark, sf_dir):
    return prompts.with_cost(_calls(spark, sf_dir)).select("call_key", F.col("input_tokens").cast("bigint").alias("input_tokens"), "input_price", F.round("cost_usd", 12).alias("cost_usd"))


@query("call_usage", with_(_CALLS, select="select count(*) as llm_calls, cast(sum(input_tokens) as bigint) as estimated_input_tokens, cast(sum(output_tokens) as bigint) as estimated_output_tokens from calls"))
def call_usage(spark, sf_dir):
    return prompts.usage(_calls(spark, sf_dir))


@query("budget_admit", with_(_CALLS, select="""
select call_key, round(proj, 10) as projected_cost from (
  select *, min(case when proj > 0.006 then ord end) over () as stop from (
    select *, call_key as ord, sum(input_tokens) over w / 1000000.0::double * 0.1::double + (sum(output_tokens) over w - output_tokens + 1200) / 1000000.0::double * 0.4::double as proj
    from calls window w as (order by call_key rows between unbounded preceding and current row))) where stop is null or ord < stop"""))
def budget_admit(spark, sf_dir):
    return prompts.admit(_calls(spark, sf_dir), max_cost=0.006, order="call_key").select("call_key", F.round("projected_cost", 10).alias("projected_cost"))


@query("call_limit_admit", with_(_CALLS, select="""
select call_key from (select call_key, row_number() over (order by call_key) as n from calls) where n <= 100"""))
def call_limit_admit(spark, sf_dir):
    return prompts.admit(_calls(spark, sf_dir), max_calls=100, order="call_key").select("call_key")


@query("running_tokens", with_(_CALLS, select="select call_key, cast(sum(input_tokens) over (order by call_key) as bigint) as running from calls"))
def running_tokens(spark, sf_dir):
    return running(_calls(spark, sf_dir), "call_key", sums={"running": "input_tokens"}).select("call_key", "running")


def _cache(spark, sf_dir):
    p = V.prompts(spark, sf_dir).withColumn("cache_key", prompts.response_key())
    rows = p.filter(F.col("system_prompt") != "user").groupBy("cache_key").agg(F.min("call_key").alias("k"))
    return rows.select(
        "cache_key", F.when(F.col("k") % 7 != 0, F.lit(1000000.0) - F.col("k") % 5 * 40000.0).alias("cached_at"), F.concat(F.lit("reply "), F.col("k").cast("string")).alias("reply"))


_CACHE = V.PROMPTS + """,
keyed as (select *, sha256('openrouter:' || model_name || ':0.4:' || system_prompt || ':' || user_payload) as cache_key from prompts),
cache as (select cache_key, case when k % 7 <> 0 then 1000000.0::double - k % 5 * 40000.0::double end as cached_at, 'reply ' || k as reply
  from (select cache_key, min(call_key) as k from keyed where system_prompt <> 'user' group by 1))"""


@query("cache_misses", with_(_CACHE, select="""
select call_key, cache_key from keyed where cache_key not in (select cache_key from cache where cached_at is null or 1000000.0 - cached_at <= 86400)"""))
def cache_misses(spark, sf_dir):
    calls = V.prompts(spark, sf_dir).withColumn("cache_key", prompts.response_key())
    return prompts.cache_split(calls, _cache(spark, sf_dir), 1000000.0)[1].select("call_key", "cache_key")


@query("cache_hits", with_(_CACHE, select="""
select call_key, reply from keyed join cache using (cache_key) where cached_at is null or 1000000.0 - cached_at <= 86400"""))
def cache_hits(spark, sf_dir):
    calls = V.prompts(spark, sf_dir).withColumn("cache_key", prompts.response_key())
    return prompts.cache_split(calls, _cache(spark, sf_dir), 1000000.0)[0].select("call_key", "reply")


@query("cache_purge", with_(_CACHE, select="select count(*) filter (cached_at is not null and 1000000.0 - cached_at > 86400) as removed, count(*) as rows from cache"))
def cache_purge(spark, sf_dir):
    return prompts.expired_count(_cache(spark, sf_dir), 1000000.0)


@query("resume_rows", with_(V.PROMPTS, select="select call_key, system_prompt <> 'user' as was_open from prompts"))
def resume_rows(spark, sf_dir):
    todo = V.prompts(spark, sf_dir).select("call_key", "system_prompt")
    finished, rest = resume_split(todo, todo.filter(F.col("system_prompt") == "user"), "call_key")
    return finished.withColumn("was_open", F.lit(False)).unionByName(rest.withColumn("was_open", F.lit(True))).select("call_key", "was_open")


@query("batch_cost", with_(_CALLS, select="""
select count(*) as rows, count(*) as llm_calls, cast(max(input_tokens) as bigint) as input_tokens, cast(max(output_tokens) as bigint) as output_tokens,
  round(max(input_tokens) / 1000000.0::double * 0.1::double + max(output_tokens) / 1000000.0::double * 0.4::double, 12) as estimated_cost_usd from calls"""))
def batch_cost(spark, sf_dir):
    rows = _calls(spark, sf_dir)
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = rows.select(n.cast("string").alias("llm_calls"), F.col("input_tokens").cast("string").alias("estimated_input_tokens"), F.col("output_tokens").cast("string").alias("estimated_output_tokens"))
    return reports.batch_cost(rows, 0.1, 0.4).select("rows", "llm_calls", "input_tokens", "output_tokens", F.round("estimated_cost_usd", 12).alias("estimated_cost_usd"))


@query("parse_drafts", with_(V.PROMPTS, select=f"""
select call_key, case when call_key % 5 = 0 then '' else {V.strip_sql('user_payload')} end as opening_line, call_key % 5 = 0 as reply_failed,
  case when call_key % 5 = 0 then '' else system_prompt end as used from prompts"""))
def parse_drafts(spark, sf_dir):
    k = F.col("call_key")
    body = F.to_json(F.struct(F.col("user_payload").alias("opening_line"), F.array("system_prompt", F.lit(" ")).alias("evidence_used_for_copy")))
    reply = F.when(k % 5 == 0, F.lit("none")).when(k % 3 == 0, F.concat(F.lit("Here: "), body)).otherwise(body)
    df = V.prompts(spark, sf_dir).withColumn("reply", reply)
    return prompts.parse_drafts(df, keep=["call_key"]).select("call_key", "opening_line", "reply_failed", X.join_list("evidence_used_for_copy").alias("used"))


@query("parse_judgements", with_(V.PROMPTS, select="""
select call_key, case when call_key % 4 = 0 then 'error' when call_key % 3 = 0 then 'send' else 'unknown' end as judge_decision, case when call_key % 4 = 0 then '' else 'a | b' end as judge_reasons from prompts"""))
def parse_judgements(spark, sf_dir):
    k = F.col("call_key")
    body = F.to_json(F.struct(F.when(k % 3 == 0, " Send ").otherwise("maybe").alias("decision"), F.array(F.lit("a"), F.lit(""), F.lit("b")).alias("reasons"), F.col("user_payload").alias("preferred_rewrite")))
    df = V.prompts(spark, sf_dir).withColumn("reply", F.when(k % 4 == 0, F.lit("?")).otherwise(body))
    return prompts.parse_judgements(df, keep=["call_key"]).select("call_key", "judge_decision", "judge_reasons")


@query("format_evidence", with_(V.LINES, select=f"""
select row_idx, {V.strip_sql('evidence_found')} || ' (strong, specific, ' || friction_type || ', source: ' || website || ') | second (weak, generic, ' || friction_type || ', source: ' || website || ')' as evidence_points from lines
where friction_type <> '' and {V.strip_sql('evidence_found')} <> ''"""))
def format_evidence(spark, sf_dir):
    def fact(text, strength, generic):
        return F.struct(text.alias("fact"), F.lit(strength).alias("strength"), F.lit(generic).alias("too_generic_to_use"), F.col("friction_type"),
                        F.lit("").alias("surface_checked"), F.lit("").alias("conversion_outcome"), F.col("website").alias("source_url"))

    rows = V.lines(spark, sf_dir).filter((F.col("friction_type") != "") & (X.clean("evidence_found") != ""))
    rows = rows.select("row_idx", F.array(fact(X.clean("evidence_found"), "strong", False), fact(F.lit("second"), "weak", True)).alias("facts"))
    return E.format_evidence(rows).select("row_idx", "evidence_points")


@query("send_hour_opened_only", with_(V.SENDS, select="""
select cast(substr(sent_at, 12, 2) as bigint) as hour, 1.0::double as open_rate from sends where was_opened group by 1 having count(*) >= 3"""))
def send_hour_opened_only(spark, sf_dir):
    from quillgate.operators.sendtime import hour_pattern

    return hour_pattern(V.sends(spark, sf_dir), opened_only=True).select(F.col("hour").cast("bigint").alias("hour"), "open_rate")


@query("sequence_minimum", with_(_SEQ, select="select lead_id, cast(step_number as bigint) as step_number from scored where greatest(0.0, least(10.0, raw)) >= 6"))
def sequence_minimum(spark, sf_dir):
    return sequences.minimum_score(sequences.check_steps(V.steps(spark, sf_dir)), 6).select("lead_id", F.col("step_number").cast("bigint").alias("step_number"))


# --- payloads ----------------------------------------------------------------------------------------------
def _quoted_sql(x, ascii_only=True):
    """JSON string of a text; the texts hold no control characters but line ends and tabs."""
    expr = x
    for char, escape in [("chr(92)", "chr(92) || chr(92)"), ("chr(34)", "chr(92) || chr(34)"), ("chr(10)", "chr(92) || 'n'"), ("chr(13)", "chr(92) || 'r'"),
                         ("chr(9)", "chr(92) || 't'")]:
        expr = f"replace({expr}, {char}, {escape})"
    if ascii_only:
        expr = (f"list_transform([{expr}], lambda t: list_reduce(list_distinct(regexp_extract_all(t, '[^\\x00-\\x7f]')), "
                f"lambda a, c: replace(a, c, chr(92) || 'u' || printf('%04x', unicode(c))), t))[1]")
    return f"(chr(34) || {expr} || chr(34))"


def _object_sql(members):
    parts = [f"'{', ' if i else ''}\"{n}\": ' || {v}" for i, (n, v) in enumerate(members.items())]
    return "('{' || " + " || ".join(parts) + " || '}')"


_FACT_SQL = _object_sql({
    c: {"text": _quoted_sql(c), "truth": f"case when {c} then 'true' else 'false' end", "number": f"{c}::varchar"}[kind]
    for c, kind in prompts._FACT_MEMBERS.items()})


@query("evidence_payload", with_(V.FACTS, select=f"""
select lead_id, '[' || string_agg({_FACT_SQL}, ', ' order by fact_pos) || ']' as evidence_json from facts group by lead_id"""))
def evidence_payload(spark, sf_dir):
    return prompts.evidence_json(V.facts(spark, sf_dir))


def _profiles(spark, sf_dir):
    """Tone profiles in the shape of customers: names, segments and lists of both."""
    words = F.split("c_name", "#")
    return V.table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.concat(F.lit('Für "'), "c_mktsegment", F.lit('" \\ ünï')).alias("description"),
        F.col("c_mktsegment").alias("opening_style"), F.lit("").alias("custom_prompt"), words.alias("angle_priorities"),
        F.array("c_mktsegment", F.lit("é\n2")).alias("preferred_phrases"), F.array().cast("array<string>").alias("banned_phrases"),
        F.array(F.lit("a")).alias("qc_focus"), F.array("c_name").alias("example_good_lines"), F.array().cast("array<string>").alias("example_bad_lines"))


def _profile_sql(ascii_only, order):
    quoted = lambda x: _quoted_sql(x, ascii_only)
    listed = lambda x: f"('[' || array_to_string(list_transform({x}, lambda y: {quoted('y')}), ', ') || ']')"
    members = {
        "name": quoted("c_name"), "description": quoted("'Für \"' || c_mktsegment || '\" ' || chr(92) || ' ünï'"), "opening_style": quoted("c_mktsegment"),
        "custom_prompt": "chr(34) || chr(34)", "angle_priorities": listed("string_split(c_name, '#')"),
        "preferred_phrases": listed("[c_mktsegment, 'é' || chr(10) || '2']"), "banned_phrases": "'[]'", "qc_focus": listed("['a']"),
        "example_good_lines": listed("[c_name]"), "example_bad_lines": "'[]'"}
    return _object_sql({k: members[k] for k in order(members)})


@query("profile_payload", f"""
select c_custkey, {_profile_sql(True, list)} as tone_profile_json, sha256({_profile_sql(False, sorted)}) as tone_profile_hash from customer""")
def profile_payload(spark, sf_dir):
    return _profiles(spark, sf_dir).select("c_custkey", prompts.profile_json().alias("tone_profile_json"), prompts.profile_hash().alias("tone_profile_hash"))


@query("prompt_payload", with_(V.FACTS, f"evidence as (select lead_id, '[' || string_agg({_FACT_SQL}, ', ' order by fact_pos) || ']' as e from facts group by lead_id)", select=f"""
select lead_id, 'Tone: ' || p || chr(10) || 'Evidence: ' || e || chr(10) || 'Keep {{unknown}}' as prompt from evidence
join (select c_custkey, {_profile_sql(True, list)} as p from customer) c on c_custkey = lead_id % 100 + 1"""))
def prompt_payload(spark, sf_dir):
    """The whole user prompt of every lead: evidence and tone as JSON in the template's places."""
    tones = _profiles(spark, sf_dir).select((F.col("c_custkey") - 1).alias("tone"), prompts.profile_json().alias("tone_profile_json"))
    rows = prompts.evidence_json(V.facts(spark, sf_dir)).withColumn("tone", F.col("lead_id") % 100)
    rows = rows.join(tones, "tone").withColumn("template", F.lit("Tone: {tone_profile_json}\nEvidence: {evidence_json}\nKeep {unknown}"))
    return rows.select("lead_id", prompts.render("template", ["tone_profile_json", "evidence_json"]).alias("prompt"))
