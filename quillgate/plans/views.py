"""Outreach-shaped input views over the given tables.

The given tables hold no leads, lines or sends, so each view derives those columns from a
whole table.  Attributes the tables lack (surface, flags, roles) are picked from small value
lists by arithmetic on the row's own key.  Every view exists twice with the same meaning:
as a DataFrame and as the SQL text of a common table expression for the check engine.
"""

from pyspark.sql import functions as F

from quillgate.functions import html, urls

OPENERS = [
    "I was checking the", "I opened the app and", "I tried the", "Saw the", "I was on the website,",
    "I had a look at the landing page:", "Your homepage", "I clicked the CTA button on the page,",
]
TAILS = [
    ", which could cost activation.", ", which could hurt signup conversion.", ".",
    " before the paywall, could that cause churn?", " — act now", " on <b>mobile</b>.",
    ", I bet that is costing bookings.", " and it helps users find what they need.",
    ". I downloaded the demo from github and the tap target is tiny.",
]
SURFACES = [
    "app_first_product", "marketplace_booking_flow", "commerce_product_page", "b2b_service",
    "website_first_leadgen", "hardware", "",
]
CHECKED = [
    "app onboarding", "landing page proof", "checkout flow", "signup form", "booking calendar",
    "app listing", "blog", "homepage",
]
PRIORITIES = ["App Store listing > screenshots", "Homepage > proof", "availability", ""]
OUTCOMES = ["activation", "conversion", "booking", "", "trust"]
FLAGS = [
    "", "weak_evidence", "unsupported_claims", "generic; too_generic", "technical_audit_language",
    "research_only", "hallucination|thin_content", "spam_trigger_language, wrong_surface", "manual_review",
]
CONFIDENCE = ["high", "medium", "low", "none", ""]
SHOTS = ["", "shots/mobile_1.png", "shots/desktop_1.png | shots/mobile_2.png", ""]
TRACES = ["", "", "", "C:\\Users\\ava\\trace_1.zip", "/home/ava/run.trace.zip"]
VALIDATORS = ["", "mobile: button easy to miss", "cookie header found", "", "desktop layout broken", ""]
ROLES = ["Founder", "CEO", "Head of Growth", ""]
PEOPLE = ["Ava Reed", "Sam  Cole", "Mina van der Vos", "Ben", ""]
REASONS = ["good_as_is", "tone", "weak_evidence", "too_long", "not_reviewed", "other"]
FRICTIONS = [
    "broken_formatting", "low_visibility_cta", "onboarding_friction", "signup_friction",
    "weak_or_missing_proof", "broad_positioning", "app_store_signal", "other_specific_friction",
    "blog_low_priority", "unknown_kind", "checkout_friction",
]
STRENGTHS = ["strong", "medium", "weak", "strong", ""]
MARKS = [
    "", "the signup is hidden", "visual confidence: low", "small tap targets", "case study without quote",
    "too many audiences", "impressive mission", "visual confidence: high screenshot", "app store review complaint",
    "checkout button below the fold",
]
CONTEXTS = ["", "cold email outreach", "mobile retention study", "enterprise onboarding", "a lead list"]
NOTES = ["", "raised series a", "ava@acme.example", "demo booking flow", "the app store page", "subscription pricing"]
FOLLOW_UPS = ["value", "social_proof", "direct_ask", "breakup", "Other"]
ANGLES = ["CTA: hidden button", "Proof: no quotes", "cta", "Onboarding: too long", ""]
MODELS = ["gpt-4o-mini", "deepseek-chat", "local-model"]
DECISIONS = ["Send as is", "Rewrite", "reject", "", "later"]
LABEL_REASONS = ["Good as is", "Tone wrong", "Too long", "Something else"]
TONES = ["friction_first", "proof_led", ""]


# --- paired expressions -------------------------------------------------------------------
def pick(values, key):
    """values[key modulo length] as a Column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int") + 1)


def pick_sql(values, key):
    items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{items}])[({key}) % {len(values)} + 1]"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ws_strip(c):
    from quillgate.functions.text import strip

    return strip(c)


# white space for the check engine, written as one trim set
WS_SQL = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||" + "||".join(
    f"chr({c})" for c in [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
WS_CLASS_SQL = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def strip_sql(expr):
    return f"trim({expr}, {WS_SQL})"


# --- lines: documents with labels -----------------------------------------------------------
def lines(spark, sf_dir):
    """One line per document, with its whole text."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    k = F.col("doc_id")
    df = d.join(lab, "doc_id", "left").withColumn("said", ws_strip("text"))
    human = (
        F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "send")
        .when(F.col("quality") == 0, "edit").otherwise("unreviewed")
    )
    line = F.when(k % 11 == 0, F.lit("")).when(k % 23 == 1, F.lit("[AI generation unavailable]")).otherwise(
        F.concat(pick(OPENERS, k), F.lit(" "), "said", pick(TAILS, k)))
    df = df.withColumns({"personalized_line": line, "human_decision": human})
    site = F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), "lang")
    return df.select(
        k.alias("row_idx"), k.cast("string").alias("row_id"), F.concat(F.lit("run_"), "lang").alias("run_id"),
        F.concat("source", F.lit(" labs")).alias("company"), pick(PEOPLE, k).alias("person"),
        pick(ROLES, k).alias("role"), site.alias("website"), "personalized_line",
        F.col("said").alias("model_opening_line"), "human_decision",
        F.when(F.col("human_decision") == "edit", F.concat(F.lit("I checked "), "said")).otherwise("").alias("edited_line"),
        F.when(F.col("human_decision") == "unreviewed", "not_reviewed").otherwise(pick(REASONS, k)).alias("edit_reason_category"),
        F.when(k % 13 == 0, "").otherwise(F.col("text")).alias("evidence_found"),
        F.when(k % 5 == 0, "").otherwise(F.concat(
            site, F.lit("/"), k.cast("string"), F.when(k % 6 == 0, "?token=abc&x=1").otherwise(""))).alias("source_urls"),
        pick(FLAGS, k).alias("quality_flags"), F.when(k % 4 == 0, "yes").otherwise("no").alias("needs_manual_review"),
        pick(CONFIDENCE, k).alias("visual_confidence"), pick(SHOTS, k).alias("shareable_screenshots"),
        pick(TRACES, k).alias("trace_files"), pick(VALIDATORS, k).alias("ux_validator_findings"),
        pick(SURFACES, k).alias("product_surface_type"), pick(CHECKED, k).alias("surface_checked"),
        pick(PRIORITIES, k).alias("research_priority"), pick(OUTCOMES, k).alias("conversion_outcome"),
        F.when(k % 17 == 0, "Research only").otherwise("Ready").alias("status"),
        pick(FRICTIONS, k).alias("friction_type"), pick(TONES, k).alias("tone_profile"), pick(MODELS, k).alias("model_name"),
        F.col("text"),
    )


LINES = f"""
lines as (
  select *, case when human_decision = 'edit' then 'I checked ' || said else '' end as edited_line,
    case when human_decision = 'unreviewed' then 'not_reviewed' else {pick_sql(REASONS, 'row_idx')} end as edit_reason_category
  from (
    select d.doc_id as row_idx, cast(d.doc_id as varchar) as row_id, 'run_' || lang as run_id,
      source || ' labs' as company, {pick_sql(PEOPLE, 'd.doc_id')} as person, {pick_sql(ROLES, 'd.doc_id')} as role,
      'https://www.' || source || '.example.com/' || lang as website,
      {strip_sql("d.text")} as said,
      case when d.doc_id % 11 = 0 then '' when d.doc_id % 23 = 1 then '[AI generation unavailable]'
        else {pick_sql(OPENERS, 'd.doc_id')} || ' ' || {strip_sql("d.text")} || {pick_sql(TAILS, 'd.doc_id')} end as personalized_line,
      {strip_sql("d.text")} as model_opening_line,
      case when l.toxic = 1 then 'reject' when l.quality = 1 then 'send' when l.quality = 0 then 'edit' else 'unreviewed' end as human_decision,
      case when d.doc_id % 13 = 0 then '' else d.text end as evidence_found,
      case when d.doc_id % 5 = 0 then '' else 'https://www.' || source || '.example.com/' || lang || '/' || d.doc_id
        || case when d.doc_id % 6 = 0 then '?token=abc&x=1' else '' end end as source_urls,
      {pick_sql(FLAGS, 'd.doc_id')} as quality_flags,
      case when d.doc_id % 4 = 0 then 'yes' else 'no' end as needs_manual_review,
      {pick_sql(CONFIDENCE, 'd.doc_id')} as visual_confidence, {pick_sql(SHOTS, 'd.doc_id')} as shareable_screenshots,
      {pick_sql(TRACES, 'd.doc_id')} as trace_files, {pick_sql(VALIDATORS, 'd.doc_id')} as ux_validator_findings,
      {pick_sql(SURFACES, 'd.doc_id')} as product_surface_type, {pick_sql(CHECKED, 'd.doc_id')} as surface_checked,
      {pick_sql(PRIORITIES, 'd.doc_id')} as research_priority, {pick_sql(OUTCOMES, 'd.doc_id')} as conversion_outcome,
      case when d.doc_id % 17 = 0 then 'Research only' else 'Ready' end as status,
      {pick_sql(FRICTIONS, 'd.doc_id')} as friction_type, {pick_sql(TONES, 'd.doc_id')} as tone_profile,
      {pick_sql(MODELS, 'd.doc_id')} as model_name, d.text
    from documents d left join labels l on d.doc_id = l.doc_id
  )
)"""


# --- leads: one per stored page -------------------------------------------------------------
def raw_leads(spark, sf_dir):
    """Raw lead sheet in the client layout; blanks where a contact row continues a company."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    return p.select(
        k.alias("row_idx"),
        F.when(k % 3 == 1, "").when(k % 3 == 2, F.lit(" Acme\rCo ")).otherwise(
            F.concat(F.lit("Company "), (k % 97).cast("string"))).alias("Company Name"),
        F.when(k % 7 == 3, "").otherwise(F.concat(F.regexp_replace("url", "^http://", ""), F.lit(" "))).alias("Website"),
        F.when(k % 2 == 0, F.concat(F.lit("https://linkedin.example/in/"), k.cast("string"))).otherwise("").alias("Linkedin"),
        pick(PEOPLE, k).alias("First Name"), pick(ROLES, k).alias("Job Title"), pick(NOTES, k).alias("Email"),
        pick(CONTEXTS, k).alias("campaign_context"),
        F.when(k % 9 == 4, F.concat(F.lit("https://apps.apple.com/nl/app/x/id"), (k + 1000).cast("string"))).otherwise("").alias("App Store"),
        F.when(k % 6 == 5, "first screen asks for a login").otherwise("").alias("app_flow_observation"),
        F.when(k % 8 == 2, "rival has a shorter form").otherwise("").alias("competitor_context"),
    )


RAW_LEADS = f"""
raw_leads as (
  select page_id as row_idx,
    case when page_id % 3 = 1 then '' when page_id % 3 = 2 then 'Acme Co' else 'Company ' || (page_id % 97) end as company_cell,
    case when page_id % 7 = 3 then '' else regexp_replace(url, '^http://', '') end as website_cell,
    case when page_id % 2 = 0 then 'https://linkedin.example/in/' || page_id else '' end as linkedin_cell,
    array_to_string(list_filter(regexp_split_to_array({pick_sql(PEOPLE, 'page_id')}, ' +'), lambda x: x <> ''), ' ') as recipient_name,
    {pick_sql(ROLES, 'page_id')} as recipient_role, {pick_sql(NOTES, 'page_id')} as optional_notes,
    {pick_sql(CONTEXTS, 'page_id')} as campaign_context,
    case when page_id % 9 = 4 then 'https://apps.apple.com/nl/app/x/id' || (page_id + 1000) else '' end as app_store_url,
    case when page_id % 6 = 5 then 'first screen asks for a login' else '' end as app_flow_observation,
    case when page_id % 8 = 2 then 'rival has a shorter form' else '' end as competitor_context
  from pages
)"""
FILLED_LEADS = RAW_LEADS + """,
filled as (
  select * exclude (company_cell, website_cell, linkedin_cell),
    coalesce(last_value(nullif(company_cell, '') ignore nulls) over w, '') as company_cell,
    coalesce(last_value(nullif(website_cell, '') ignore nulls) over w, '') as website_cell,
    coalesce(last_value(nullif(linkedin_cell, '') ignore nulls) over w, '') as linkedin_url
  from raw_leads window w as (order by row_idx rows between unbounded preceding and current row)
)"""
_PARTS = r"^(https?)://([^/?#]*)([^?#]*)"
LEADS = FILLED_LEADS + rf""",
leads as (
  select *, case when raw_url = '' then 'website_url is required'
      when regexp_extract(raw_url, '{_PARTS}', 2) = '' then 'website_url must be a valid http(s) URL' end as url_error,
    case when raw_url = '' then '' when regexp_extract(raw_url, '{_PARTS}', 2) = '' then raw_url else
      regexp_extract(raw_url, '{_PARTS}', 1) || '://' || regexp_replace(lower(regexp_extract(raw_url, '{_PARTS}', 2)), '^www\.', '')
      || regexp_replace(regexp_extract(raw_url, '{_PARTS}', 3), '/+$', '') end as website_url,
    company_cell as company_name
  from (select *, case when website_cell = '' then '' when website_cell like 'http://%' or website_cell like 'https://%' then website_cell
      else 'https://' || website_cell end as raw_url from filled)
)"""


# --- facts: sentences of documents ------------------------------------------------------------
def facts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", "source", "lang", F.posexplode(F.split("text", r"\.")).alias("fact_pos", "sentence"))
    rows = rows.withColumn("sentence", ws_strip("sentence")).filter(F.col("sentence") != "")
    i = F.col("doc_id") * 3 + F.col("fact_pos")
    return rows.select(
        F.col("doc_id").alias("lead_id"), "fact_pos",
        F.concat("sentence", F.lit(" "), pick(MARKS, i)).alias("fact"),
        F.lit("it may cost users").alias("why_it_matters"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com")).alias("source_url"),
        pick(STRENGTHS, i).alias("strength"), pick(FRICTIONS, i).alias("friction_type"),
        pick(CHECKED, i).alias("surface_checked"), pick(OUTCOMES, i).alias("conversion_outcome"),
        (i % 4 == 0).alias("too_generic_to_use"), (i % 19 == 0).alias("blog_used"),
        (i % 5).cast("int").alias("angle_priority"), F.lit("").alias("why_this_angle"),
    )


FACTS = f"""
facts as (
  select doc_id as lead_id, fact_pos, sentence || ' ' || {pick_sql(MARKS, 'i')} as fact, 'it may cost users' as why_it_matters,
    'https://' || source || '.example.com' as source_url, {pick_sql(STRENGTHS, 'i')} as strength,
    {pick_sql(FRICTIONS, 'i')} as friction_type, {pick_sql(CHECKED, 'i')} as surface_checked,
    {pick_sql(OUTCOMES, 'i')} as conversion_outcome, i % 4 = 0 as too_generic_to_use, i % 19 = 0 as blog_used,
    i % 5 as angle_priority, '' as why_this_angle
  from (
    select *, doc_id * 3 + fact_pos as i, {strip_sql('part')} as sentence from (
      select doc_id, source, unnest(string_split(text, '.')) as part,
        generate_subscripts(string_split(text, '.'), 1) - 1 as fact_pos from documents)
  ) where sentence <> ''
)"""


# --- sends: events ------------------------------------------------------------------------------
def sends(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.get_json_object("props", "$.k").cast("int")
    df = e.withColumn("k", n)
    kind = F.col("event_type")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return df.select(
        F.concat(F.lit("run_"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"),
        F.col("event_id").cast("string").alias("row_id"), F.col("user_id").cast("string").alias("lead_id"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("ex_"), F.col("event_id").cast("string"))).otherwise("").alias("example_id"),
        kind.isin("click", "view", "signup", "purchase").alias("was_opened"),
        kind.isin("signup", "purchase").alias("got_reply"), (kind == "purchase").alias("converted"),
        F.when(kind.isin("signup", "purchase"), F.floor(F.col("value")).cast("int")).otherwise(0).alias("time_to_reply_minutes"),
        pick(FRICTIONS[:6] + [""], F.col("k")).alias("friction_type"),
        F.when(F.col("k") % 13 == 0, "").when(F.col("k") % 5 == 0, pick(CHECKED, F.col("k"))).otherwise(
            F.concat(pick(FRICTIONS, F.col("k")), F.lit(": "), pick(MARKS, F.col("k")))).alias("chosen_angle"),
        pick(CHECKED, F.col("user_id")).alias("surface_checked"), pick(OUTCOMES, F.col("k")).alias("conversion_outcome"),
        F.concat(F.lit("Line for "), F.col("user_id").cast("string"), F.lit(" / "), F.col("k").cast("string")).alias("opening_line"),
        stamp.alias("sent_at"), stamp.alias("created_at"), stamp.alias("updated_at"), F.col("event_id"), F.col("k"),
    )


SENDS = f"""
ev as (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k, strftime(ts, '%Y-%m-%d %H:%M:%S') as stamp from events),
sends as (
  select 'run_' || strftime(ts, '%Y-%m-%d') as run_id, cast(event_id as varchar) as row_id, cast(user_id as varchar) as lead_id,
    case when event_id % 3 = 0 then 'ex_' || event_id else '' end as example_id,
    event_type in ('click', 'view', 'signup', 'purchase') as was_opened, event_type in ('signup', 'purchase') as got_reply,
    event_type = 'purchase' as converted,
    case when event_type in ('signup', 'purchase') then cast(floor(value) as int) else 0 end as time_to_reply_minutes,
    {pick_sql(FRICTIONS[:6] + [""], 'k')} as friction_type,
    case when k % 13 = 0 then '' when k % 5 = 0 then {pick_sql(CHECKED, 'k')}
      else {pick_sql(FRICTIONS, 'k')} || ': ' || {pick_sql(MARKS, 'k')} end as chosen_angle,
    {pick_sql(CHECKED, 'user_id')} as surface_checked, {pick_sql(OUTCOMES, 'k')} as conversion_outcome,
    'Line for ' || user_id || ' / ' || k as opening_line, stamp as sent_at, stamp as created_at, stamp as updated_at, event_id, k
  from ev
)"""


# --- experiments: leads of sends over three experiments ----------------------------------------
VARIANTS = ["a_control", "b_proof", "c_short"]


def experiment_sends(spark, sf_dir):
    df = sends(spark, sf_dir).withColumn(
        "experiment_id", F.concat(F.lit("exp_"), (F.col("event_id") % 3).cast("string")))
    from quillgate.operators.experiments import assign_hash

    return assign_hash(df, VARIANTS)


EXPERIMENT_SENDS = SENDS + """,
esends as (
  select *, (['a_control', 'b_proof', 'c_short'])[cast(('0x' || substr(lead_hash, 1, 8)) as bigint) % 3 + 1] as variant_id
  from (select *, md5(experiment_id || ':' || lead_id) as lead_hash
    from (select *, 'exp_' || (event_id % 3) as experiment_id from sends))
),
results as (
  select experiment_id, variant_id, lead_id, arg_max(was_opened, event_id) as was_opened, arg_max(got_reply, event_id) as got_reply,
    arg_max(converted, event_id) as converted from esends group by all
),
variants as (
  select experiment_id, variant_id, count(*) as total, count(*) filter (was_opened) as opened,
    count(*) filter (got_reply) as replied, count(*) filter (converted) as converted from results group by all
)"""


def experiment_results(spark, sf_dir):
    from quillgate.operators.rows import last_per_key

    df = experiment_sends(spark, sf_dir)
    return last_per_key(
        df.select("experiment_id", "variant_id", "lead_id", "was_opened", "got_reply", "converted", "event_id"),
        ["experiment_id", "variant_id", "lead_id"], "event_id")


# --- attempts and steps: conversations -----------------------------------------------------------
def attempts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = F.length("text")
    return c.select(
        F.col("conv_id").alias("lead_id"), (F.col("turn") % 3 + 1).cast("int").alias("variant"),
        (F.floor(F.col("turn") / 3) + 1).cast("int").alias("iteration"),
        (n % 12).cast("int").alias("score"), (n % 3 != 0).alias("passed"), (n % 5 == 0).alias("serious"),
        (n % 4 == 0).alias("needs_review"), F.col("text").alias("opening_line"))


ATTEMPTS = """
attempts as (
  select conv_id as lead_id, cast(turn % 3 + 1 as int) as variant, cast(turn // 3 + 1 as int) as iteration,
    cast(length(text) % 12 as int) as score, length(text) % 3 <> 0 as passed, length(text) % 5 = 0 as serious,
    length(text) % 4 = 0 as needs_review, text as opening_line from conversations
)"""


def steps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    i = F.col("conv_id") + F.col("turn") * 2
    return c.select(
        F.col("conv_id").alias("lead_id"), (F.col("turn") + 1).cast("int").alias("step_number"),
        pick(FOLLOW_UPS, i).alias("follow_up_type"), pick(ANGLES, i + F.col("conv_id") % 3).alias("chosen_angle"),
        ws_strip("text").alias("opening_line"),
        F.when(i % 6 == 5, F.lit("just checking in")).when(i % 9 == 7, "").otherwise(F.col("text")).alias("body_text"),
        F.when(i % 7 == 3, "").otherwise("Worth a call?").alias("cta_text"),
        F.array("role").alias("evidence_used_for_copy"))


STEPS = f"""
raw_steps as (
  select conv_id as lead_id, cast(turn + 1 as int) as step_number, {pick_sql(FOLLOW_UPS, '(conv_id + turn * 2)')} as kind,
    {pick_sql(ANGLES, '(conv_id + turn * 2 + conv_id % 3)')} as chosen_angle,
    {strip_sql("text")} as opening_line,
    case when (conv_id + turn * 2) % 6 = 5 then 'just checking in' when (conv_id + turn * 2) % 9 = 7 then ''
      else {strip_sql('text')} end as body_text,
    case when (conv_id + turn * 2) % 7 = 3 then '' else 'Worth a call?' end as cta_text
  from conversations
),
steps as (
  select * exclude (kind), case when kind in ('value', 'social_proof', 'direct_ask', 'breakup') then kind else 'value' end as follow_up_type
  from raw_steps where step_number <= 4
),
kept as (
  select * from (select *, min(case when follow_up_type = 'breakup' then step_number end) over (partition by lead_id) as stop from steps)
  where stop is null or step_number <= stop
)"""


# --- prompts: conversation turns -----------------------------------------------------------------
def prompts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("call_key"), F.col("conv_id"), F.col("turn"),
        F.col("role").alias("system_prompt"), F.col("text").alias("user_payload"),
        pick(MODELS, F.col("conv_id")).alias("model_name"), F.lit("openrouter").alias("provider"),
        F.lit("0.4").alias("temperature"))


PROMPTS = f"""
prompts as (
  select conv_id * 1000000 + turn as call_key, conv_id, turn, role as system_prompt, text as user_payload,
    {pick_sql(MODELS, 'conv_id')} as model_name from conversations
)"""


# --- page metrics: line items as measured viewports --------------------------------------------
def page_metrics(spark, sf_dir, as_text=True):
    """Measured viewports; the metrics as the JSON text that a browser reports, or as the struct of a parsed table."""
    li = table(spark, sf_dir, "lineitem")
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    part = F.col("l_partkey")
    metrics = F.struct(
        F.lit(800.0).alias("viewportHeight"), F.floor("l_extendedprice").cast("double").alias("bodyTextLength"),
        (q * 2).alias("horizontalOverflowPx"), (n - 2).alias("offscreenElementCount"), (q + n).alias("maxRightOverflowPx"),
        (part % 9).cast("double").alias("ctaCount"), (part % 9 * (part % 2)).cast("double").alias("ctaAboveFoldCount"),
        (part % 4).cast("double").alias("hiddenSignupLoginCount"), (part % 3).cast("double").alias("smallTapTargetCount"),
        F.struct(
            F.when(part % 5 == 0, "").otherwise("Get started").alias("text"), (q * 30).alias("top"),
            F.round(q / 10.0, 1).alias("contrastRatio"), (part % 2 == 0).alias("backgroundReliable")).alias("primaryCta"),
    )
    metrics = F.to_json(metrics) if as_text else metrics
    return li.select(
        F.col("l_orderkey").alias("page_key"), F.col("l_linenumber"), part.alias("part_key"), F.col("l_suppkey").alias("supp_key"),
        F.when(F.col("l_linenumber") % 2 == 0, "mobile").otherwise("desktop").alias("viewport"), metrics.alias("metrics"))


PAGE_METRICS = """
pm as (
  select l_orderkey as page_key, l_linenumber, l_partkey as part_key, l_suppkey as supp_key,
    case when l_linenumber % 2 = 0 then 'mobile' else 'desktop' end as viewport,
    floor(l_extendedprice) as chars, l_quantity * 2 as over_px, l_linenumber - 2 as offscreen, l_quantity + l_linenumber as right_px,
    l_partkey % 9 as cta, l_partkey % 9 * (l_partkey % 2) as above, l_partkey % 4 as hidden, l_partkey % 3 as taps,
    case when l_partkey % 5 = 0 then '' else 'Get started' end as ptext, l_quantity * 30 as top_px,
    round(l_quantity / 10.0, 1) as contrast, l_partkey % 2 = 0 as sure from lineitem
)"""


# --- pages ---------------------------------------------------------------------------------------
def site_pages(spark, sf_dir):
    """Stored pages with company key (host), position, title and visible text."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id", "url", urls.host("url").alias("company_key"), F.col("page_id").alias("page_pos"),
        html.title(F.col("html")).alias("title"), html.visible_text(F.col("html")).alias("text"))


SITE_PAGES = rf"""
site_pages as (
  select page_id, url, regexp_replace(lower(regexp_extract(url, '{_PARTS}', 2)), '^www\.', '') as company_key, page_id as page_pos,
    {html.title_sql()} as title, {html.visible_sql()} as text from pages
)"""


# --- reviews: documents ----------------------------------------------------------------------------
REVIEW_TALK = [
    "", "the app crashed at login", "subscription price too high", "spam reminder daily", "great support",
    "tutorial is confusing", "stuck on error", "refund please",
]


def reviews(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        F.col("source").alias("app_key"), k.alias("pos"),
        F.concat(pick(REVIEW_TALK, k), F.lit(": "), "text").alias("text"),
        pick(["1", "2", "3", "4", "5", ""], k).alias("rating"))


REVIEWS = f"""
reviews as (
  select source as app_key, doc_id as pos, {pick_sql(REVIEW_TALK, 'doc_id')} || ': ' || text as text,
    {pick_sql(["1", "2", "3", "4", "5", ""], 'doc_id')} as rating from documents
)"""
