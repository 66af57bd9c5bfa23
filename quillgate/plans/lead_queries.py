"""Queries over leads and stored pages."""

import re

from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import html, urls
from quillgate.functions import text as X
from quillgate.operators import leads, outreach, sendtime, web
from quillgate.operators.order import stored
from quillgate.operators.rows import first_per_key, ensure_columns, top_k, with_generated_ids
from quillgate.plans import views as V
from quillgate.plans.registry import SQL, any_sql, dedupe_sql, flags_sql, items, join_sql, q, query, with_

_P = V._PARTS
_HOST = rf"regexp_replace(lower(regexp_extract(%s, '{_P}', 2)), '^www\.', '')"


def built(spark, sf_dir):
    return leads.build_leads(leads.prepare(V.raw_leads(spark, sf_dir)))


@query("lead_fill_down", with_(V.FILLED_LEADS, select="select row_idx, company_cell, website_cell, linkedin_url from filled"))
def lead_fill_down(spark, sf_dir):
    df = leads.prepare(V.raw_leads(spark, sf_dir))
    return df.select("row_idx", F.col("Company Name").alias("company_cell"), F.col("Website").alias("website_cell"), "linkedin_url")


@query("lead_normalize_url", with_(V.LEADS, select="""
select row_idx, company_name, website_url, case when url_error is null then '' else url_error end as error from leads"""))
def lead_normalize_url(spark, sf_dir):
    return built(spark, sf_dir).select("row_idx", "company_name", "website_url", F.array_join("validation_errors", "; ").alias("error"))


_DEPTH = f"""least(1.0, greatest(0.0, round_even(0.3::double + (case when linkedin_url <> '' then 0.1::double else 0 end) + 0
  + (case when recipient_role <> '' then 0.05::double else 0 end) + (case when app_store_url <> '' then 0.075::double else 0 end)
  + (case when app_flow_observation <> '' then 0.05::double else 0 end)
  + (case when campaign_context = '' then 0 when {any_sql('lower(campaign_context)', T.GENERIC_CONTEXT_TERMS)} then 0.04::double else 0.1::double end)
  + (case when competitor_context <> '' then 0.075::double else 0 end) + (case when optional_notes <> '' then 0.05::double else 0 end)
  + (case when {any_sql("lower(company_name || ' ' || optional_notes || ' ' || campaign_context)", T.ENTERPRISE_TERMS)} then 0.1::double else 0 end), 2)))"""


@query("lead_depth", with_(V.LEADS, select=f"""
select row_idx, depth as research_depth, cast(greatest(1, round_even(depth * 5.0, 0)) as bigint) as page_budget, depth >= 0.6 and url_error is null as deep
from (select *, {_DEPTH} as depth from leads)"""))
def lead_depth(spark, sf_dir):
    return built(spark, sf_dir).select(
        "row_idx", "research_depth", leads.page_budget(5).cast("bigint").alias("page_budget"), leads.deep_research_eligible().alias("deep"))


@query("lead_defaults", with_(V.LEADS, select=f"""
select row_idx, campaign_context, {_DEPTH} as research_depth
from (select * replace (case when campaign_context = '' then 'enterprise pilot' else campaign_context end as campaign_context) from leads)"""))
def lead_defaults(spark, sf_dir):
    """Leads of a batch that brings a campaign context of its own."""
    df = leads.build_leads(leads.prepare(V.raw_leads(spark, sf_dir)), "enterprise pilot")
    return df.select("row_idx", "campaign_context", "research_depth")


@query("lead_dedupe", with_(V.LEADS, select=f"""
select row_idx, url_error is null and rn = 1 as is_valid, url_error is null and rn > 1 as is_duplicate,
  case when url_error is null and rn > 1 then 'Duplicate row by website/company' else coalesce(url_error, '') end as errors
from (select *, row_number() over (partition by {_HOST % 'website_url'}, url_error is null order by row_idx) as rn from leads)"""))
def lead_dedupe(spark, sf_dir):
    return leads.mark_duplicates(built(spark, sf_dir)).select(
        "row_idx", "is_valid", "is_duplicate", F.array_join("validation_errors", "; ").alias("errors"))


@query("lead_company_from_host", rf"""
select page_id, url as website_url, array_to_string(list_transform(list_filter(string_split(replace(replace(split_part({_HOST % 'url'}, '.', 1), '-', ' '), '_', ' '), ' '),
  lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ') as company from pages""")
def lead_company_from_host(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("website_url"), urls.company_from_host("url").alias("company"))


#: The raw columns and what they hold once they are filled down.
_ORIGINAL = {
    "Company Name": "company_cell", "Website": "website_cell", "Linkedin": "linkedin_url", "First Name": "recipient_name",
    "Job Title": "recipient_role", "Email": "optional_notes", "campaign_context": "campaign_context", "App Store": "app_store_url",
    "app_flow_observation": "app_flow_observation", "competitor_context": "competitor_context"}


@query("lead_original_columns", with_(V.FILLED_LEADS, select=f"""
select row_idx, {", ".join(f'{v} as "input__{k}"' for k, v in _ORIGINAL.items())} from filled"""))
def lead_original_columns(spark, sf_dir):
    df = leads.expand_original(built(spark, sf_dir), list(_ORIGINAL))
    return df.select("row_idx", *[f"input__{k}" for k in _ORIGINAL])


#: Rows with an open tail: every page keeps those of its cells that hold something; some keep none at all.
_TAILS = V.FILLED_LEADS + f""",
tails as (
  select row_idx, unnest([{", ".join(f"{{'key': {q(k)}, 'value': {v}}}" for k, v in _ORIGINAL.items())}], recursive := true) from filled where row_idx % 5 <> 0),
kept as (select * from tails where value <> '')"""


def _tails(spark, sf_dir):
    filled = built(spark, sf_dir).select("row_idx", F.when(F.col("row_idx") % 5 != 0, F.col("original_columns")).alias("original_columns"))
    return leads.keep_filled(filled)


@query("lead_column_tail", with_(_TAILS, select="select distinct key from kept"))
def lead_column_tail(spark, sf_dir):
    return leads.original_keys(_tails(spark, sf_dir))


@query("lead_tail_prefix", with_(_TAILS, select="""
select row_idx, count(*) as cells, string_agg(key || '=' || value, '; ' order by lower(key), key) as tail from kept where starts_with(lower(key), 'app') group by row_idx"""))
def lead_tail_prefix(spark, sf_dir):
    """The part of the open tail whose names begin alike, in the order of the sorted names."""
    rows = leads.tail_rows(_tails(spark, sf_dir), prefix="app")
    return rows.groupBy("row_idx").agg(
        F.count(F.lit(1)).alias("cells"),
        F.array_join(F.sort_array(F.collect_list(F.struct(F.lower("key").alias("k"), "key", F.concat("key", F.lit("="), "value").alias("shown"))))["shown"], "; ").alias("tail"))


_TEXT = "lower(concat_ws(' ', website_url, optional_notes, app_store_url, app_flow_observation))"
_SURFACE = f"""case when regexp_extract(website_url, '{_P}', 2) like '%.app' or app_store_url <> '' or {any_sql(_TEXT, T.CLASSIFY_APP)} then 'app_first_product'
  when {any_sql(_TEXT, T.CLASSIFY_BOOKING)} then 'marketplace_booking_flow' when {any_sql(_TEXT, T.CLASSIFY_COMMERCE)} then 'commerce_product_page'
  when {any_sql(_TEXT, T.CLASSIFY_B2B)} then 'b2b_service' else 'website_first_leadgen' end"""


@query("lead_surface", with_(V.LEADS, select=f"""
select row_idx, s as product_surface_type, case s {" ".join(f"when {q(k)} then {q(v)}" for k, v in T.RESEARCH_PRIORITY.items())} else {q(T.RESEARCH_PRIORITY_DEFAULT)} end as research_priority,
  s = 'app_first_product' as app_first from (select *, {_SURFACE} as s from leads)"""))
def lead_surface(spark, sf_dir):
    df = outreach.classify_surface(built(spark, sf_dir))
    return df.select("row_idx", "product_surface_type", outreach.research_priority().alias("research_priority"), outreach.is_app_first().alias("app_first"))


_NOTES = "lower(concat_ws(' ', optional_notes, '', app_flow_observation, '', competitor_context, ''))"


@query("lead_checklist", with_(V.LEADS, select=f"""
select row_idx, case when len(c) = 0 then {q(T.CHECKLIST_EMPTY)} else array_to_string(c, ' | ') end as friction_checklist,
  case when app_flow_observation <> '' then 'Manual app/onboarding observation supplied by reviewer: ' || app_flow_observation || chr(10) else '' end
  || case when competitor_context <> '' then 'Competitor/context note supplied by reviewer: ' || competitor_context || chr(10) else '' end
  || 'Friction checklist: ' || case when len(c) = 0 then {q(T.CHECKLIST_EMPTY)} else array_to_string(c, ' | ') end as research_context
from (select *, {flags_sql(("app_flow_observation <> ''", 'manual app/onboarding observation provided'),
   *[(f"regexp_matches({_NOTES}, '{p}')", label) for label, p in T.CHECKLIST_PATTERNS])} as c from leads)"""))
def lead_checklist(spark, sf_dir):
    df = outreach.context_text(outreach.friction_checklist(built(spark, sf_dir)))
    return df.select("row_idx", X.join_list("friction_checklist").alias("friction_checklist"), "research_context")


@query("lead_routing", with_(V.LEADS, select=f"""
select row_idx, case when url_error is null and rn = 1 then 'processed' else 'placeholder' end as row_kind,
  case when url_error is null and rn = 1 then '' else 'manual_review' end as quality_flags,
  case when url_error is null and rn = 1 then '' else coalesce(url_error, 'Duplicate row by website/company') || ' | Skipped invalid row' end as reviewer_notes
from (select *, row_number() over (partition by {_HOST % 'website_url'}, url_error is null order by row_idx) as rn from leads)"""))
def lead_routing(spark, sf_dir):
    df = leads.mark_duplicates(built(spark, sf_dir))
    done = df.filter("is_valid").withColumns({"quality_flags": F.lit(""), "reviewer_notes": F.lit("")})
    return outreach.route_rows(df, done, "Skipped invalid row").select("row_idx", "row_kind", "quality_flags", "reviewer_notes")


@query("contact_reuse", with_(V.LEADS, select=f"""
select l.row_idx, l.recipient_name, f.surface as surface_text, 'note | Reused personalization from duplicate company row' as reviewer_notes
from leads l join (select {_HOST % 'website_url'} as h, arg_min(optional_notes, row_idx) as surface from leads where url_error is null group by 1) f
  on {_HOST % 'l.website_url'} = f.h where l.url_error is null"""))
def contact_reuse(spark, sf_dir):
    df = built(spark, sf_dir).filter("is_valid")
    processed = first_per_key(
        df.select(leads.dedupe_key().alias("k"), "row_idx", "website_url", "company_name", F.col("optional_notes").alias("surface_text")),
        ["k"], "row_idx").drop("k", "row_idx").withColumn("reviewer_notes", F.lit("note"))
    return leads.reuse_for_contacts(df, processed).select("row_idx", "recipient_name", "surface_text", "reviewer_notes")


@query("workspace_defaults", with_(V.LEADS, select="""
select row_idx, case when recipient_role <> '' then recipient_role else 'friction_first' end as tone_profile,
  case when campaign_context <> '' then campaign_context else 'default for ' || row_idx % 5 end as campaign_context from leads"""))
def workspace_defaults(spark, sf_dir):
    df = built(spark, sf_dir)
    args = df.select("row_idx", (F.col("row_idx") % 5).cast("string").alias("client_id"), F.col("recipient_role").alias("tone_profile"),
                     "campaign_context", F.lit("").alias("research_region"), F.lit("").alias("export_preset"))
    from quillgate.sources.dims import workspace_defaults as defaults

    spaces = df.groupBy((F.col("row_idx") % 5).cast("string").alias("client_id")).agg(F.max(F.lit("")).alias("display_name"))
    spaces = ensure_columns(spaces, ["tone_profile", "default_research_region", "default_export_preset", "notes", "created_at", "updated_at"]).withColumn(
        "default_campaign_context", F.concat(F.lit("default for "), "client_id"))
    return leads.attach_workspace(args, defaults(spaces)).select("row_idx", "tone_profile", "campaign_context")


@query("slug_names", "select c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_') as slug from customer")
def slug_names(spark, sf_dir):
    return V.table(spark, sf_dir, "customer").select("c_custkey", X.slug("c_name").alias("slug"))


@query("row_ids", "select c_custkey, case when c_custkey % 3 = 0 then c_mktsegment else cast(c_custkey + 1 as varchar) end as row_id from customer")
def row_ids(spark, sf_dir):
    df = V.table(spark, sf_dir, "customer").withColumn("row_id", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(" "))
    return with_generated_ids(df, "row_id", "c_custkey").select("c_custkey", "row_id")


# --- send-time over leads ---------------------------------------------------------------------------
AS_OF = "2024-01-31 13:30:00"
_REGION = ("case " + " ".join(f"when {any_sql('lower(website_url)', n)} then {q(r)}" for n, r in T.URL_REGIONS) + " else 'us' end")
_ZONE = "case " + " ".join(f"when contains(region, {q(k)}) then {q(v)}" for k, v in T.REGION_LABELS) + " else 'generic' end"
_HOURS = "case " + " ".join(f"when zone = {q(z)} then {h}" for z, h in T.BEST_HOURS.items() if z != "generic") + f" else {T.BEST_HOURS['generic']} end"
_W = "([0.65::double, 0.95::double, 0.90::double, 0.80::double, 0.55::double, 0.25::double, 0.15::double])"
_PATTERN = """pattern as (
  select hour, count(*) as sends, count(*) filter (was_opened) as opens, count(*) filter (was_opened)::double / count(*) as open_rate
  from (select *, cast(substr(sent_at, 12, 2) as int) as hour from sends) group by hour having count(*) >= 3 and (select count(*) from sends) >= 50)"""
_ADVICE = f"""zones as (select *, {_HOURS} as hours from (select *, {_ZONE} as zone from (select *, {_REGION} as region from leads))),
cand as (select z.row_idx, z.zone, d.ahead, c.i, z.hours[c.i] as hour from zones z, (select unnest([0, 1, 2, 3]) as ahead) d, (select unnest([1, 2, 3, 4]) as i) c where c.i <= len(z.hours)),
picked as (
  select row_idx, zone, ahead, arg_max(hour, [r, -i]) as hour, max(r) as rate from (
    select c.*, coalesce(p.open_rate, 0.0) as r from cand c left join pattern p on c.hour = p.hour) group by all),
advice as (
  select *, least(rate * {_W}[(isodow(timestamp '{AS_OF}') - 1 + ahead) % 7 + 1] * 1.1::double, 1.0) as hour_score,
    case when slot <= timestamp '{AS_OF}' + interval 1 hour and ahead = 0 then slot + interval 1 day else slot end as send_at
  from (select *, date_trunc('day', timestamp '{AS_OF}') + to_days(cast(ahead as int)) + to_hours(hour) as slot from picked))"""


@query("send_hour_pattern", with_(V.SENDS, _PATTERN, select="select cast(hour as bigint) as hour, sends, opens, round(open_rate, 6) as open_rate from pattern"))
def send_hour_pattern(spark, sf_dir):
    return sendtime.hour_pattern(V.sends(spark, sf_dir)).select(
        F.col("hour").cast("bigint").alias("hour"), "sends", "opens", F.round("open_rate", 6).alias("open_rate"))


@query("send_time_advice", with_(V.LEADS, V.SENDS, _PATTERN, _ADVICE, select=f"""
select row_idx, zone as timezone_label, strftime(send_at, '%Y-%m-%d %H:%M:%S') as send_at_utc, round_even(hour_score, 2) as confidence, 'historical' as source,
  {_W}[isodow(send_at)] as weekday_factor from advice where ahead = 0"""))
def send_time_advice(spark, sf_dir):
    out = sendtime.advise(built(spark, sf_dir), sendtime.hour_pattern(V.sends(spark, sf_dir)), AS_OF)
    return out.select("row_idx", "timezone_label", F.date_format("send_at_utc", "yyyy-MM-dd HH:mm:ss").alias("send_at_utc"), "confidence", "source", "weekday_factor")


@query("send_time_top3", with_(V.LEADS, V.SENDS, _PATTERN, _ADVICE, select="""
select row_idx, option_rank, cast(ahead as bigint) as days_ahead, strftime(send_at, '%Y-%m-%d %H:%M:%S') as send_at_utc, conf as confidence from (
  select *, row_number() over (partition by row_idx order by conf desc, ahead) as option_rank from (select *, round_even(hour_score, 2) as conf from advice)) where option_rank <= 3"""))
def send_time_top3(spark, sf_dir):
    out = sendtime.top_days(built(spark, sf_dir), sendtime.hour_pattern(V.sends(spark, sf_dir)), AS_OF, "row_idx")
    return out.select("row_idx", F.col("option_rank").cast("bigint").alias("option_rank"), F.col("days_ahead").cast("bigint").alias("days_ahead"),
                      F.date_format("send_at_utc", "yyyy-MM-dd HH:mm:ss").alias("send_at_utc"), "confidence")


@query("send_time_rows", with_(V.LEADS, V.SENDS, _PATTERN, _ADVICE, select="""
, firsts as (select company_name, min(row_idx) as row_idx from leads group by 1)
select l.row_idx, case when a.row_idx is null then '' else strftime(a.send_at, '%Y-%m-%dT%H:%M:%S+00:00') end as suggested_send_time_utc, a.zone as suggested_send_timezone,
  strftime(a.send_at, '%Y-%m-%d %H:%M') || ' UTC (' || replace(a.zone, '_', ' ') || ') — confidence: '
    || cast(round_even(round_even(a.hour_score, 2) * 100, 0) as int) || '%' as shown
from leads l join firsts f on l.company_name = f.company_name join advice a on a.row_idx = f.row_idx and a.ahead = 0"""))
def send_time_rows(spark, sf_dir):
    df = stored(built(spark, sf_dir).select("row_idx", "company_name", "website_url"))  # read twice: per company, and for every row
    per_company = first_per_key(df, ["company_name"], "row_idx", ["row_idx", "website_url"])
    advice = sendtime.advise(per_company, sendtime.hour_pattern(V.sends(spark, sf_dir)), AS_OF)
    shown = sendtime.attach_advice(df.select("row_idx", "company_name"), advice)
    return shown.select("row_idx", "suggested_send_time_utc", "suggested_send_timezone", F.col("send_time_shown").alias("shown"))


_HOURS_TEXT = "'[' || array_to_string(hours, ', ') || ']'"
_PLAIN = f"""plain as (
  select *, {_W}[isodow(send_at)] as factor from (
    select *, case when slot <= timestamp '{AS_OF}' + interval 1 hour then slot + interval 1 day else slot end as send_at from (
      select row_idx, zone, hours, date_trunc('day', timestamp '{AS_OF}') + to_hours(hours[1]) as slot
      from (select *, {_HOURS} as hours from (select *, {_ZONE} as zone from (select *, {_REGION} as region from leads))))))"""


@query("send_time_default", with_(V.LEADS, _PLAIN, select=f"""
select row_idx, strftime(send_at, '%Y-%m-%d %H:%M:%S') as send_at_utc, round_even(0.6::double * factor, 2) as confidence, 'regional_default' as source,
  'Tijdzone: ' || zone || ' | Geen historische data → standaard patroon | Regio-standaard beste uren: ' || {_HOURS_TEXT} || ' | Weekdag: '
    || (['ma', 'di', 'wo', 'do', 'vr', 'za', 'zo'])[isodow(send_at)] || ' (factor ' || printf('%.2f', factor) || ')' as reasoning,
  strftime(send_at, '%Y-%m-%d %H:%M') || ' UTC (' || replace(zone, '_', ' ') || ') — confidence: ' || cast(round_even(round_even(0.6::double * factor, 2) * 100, 0) as int) || '%' as shown
from plain"""))
def send_time_default(spark, sf_dir):
    """Advice before there is any history, with its reasoning and the text that is shown."""
    out = sendtime.advise(built(spark, sf_dir), sendtime.hour_pattern(V.sends(spark, sf_dir).filter("false")), AS_OF)
    return out.select("row_idx", F.date_format("send_at_utc", "yyyy-MM-dd HH:mm:ss").alias("send_at_utc"), "confidence", "source", "reasoning",
                      sendtime.format_advice().alias("shown"))


@query("send_time_mean", with_(V.LEADS, V.SENDS, _PATTERN, _ADVICE, select="""
select count(*) as timed_rows, round(avg(round_even(hour_score, 2)), 4) as mean_confidence from advice where ahead = 0"""))
def send_time_mean(spark, sf_dir):
    out = sendtime.advise(built(spark, sf_dir), sendtime.hour_pattern(V.sends(spark, sf_dir)), AS_OF)
    return sendtime.mean_confidence(out.select(
        F.date_format("send_at_utc", "yyyy").alias("suggested_send_time_utc"), F.col("confidence").alias("send_time_confidence")))


# --- pages --------------------------------------------------------------------------------------------
@query("html_text", f"""
select page_id, url, {html.title_sql()} as title, {html.visible_sql()} as text, cast(len({html.links_sql()}) as bigint) as links from pages""")
def html_text(spark, sf_dir):
    parsed = web.parse_pages(V.table(spark, sf_dir, "pages"))
    return parsed.select("page_id", "url", "title", "text", F.size("links").cast("bigint").alias("links"))


# hrefs resolved against the page: absolute, of the page's scheme, of its host, or beside it
_FOUND = rf"""
found as (
  select page_id, url, i - 1 as link_pos, links[i].href as href, links[i].label as label
  from (select *, unnest(range(1, len(links) + 1)) as i from (select page_id, url, {html.links_sql()} as links from pages))
),
page_links as (
  select * from (
    select page_id, url, link_pos, label,
      case when regexp_matches(href, '^https?://') then href
        when starts_with(href, '//') then regexp_extract(url, '^(https?:)', 1) || href
        when starts_with(href, '/') then regexp_extract(url, '^(https?://[^/?#]*)', 1) || href
        else regexp_extract(url, '^(https?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*(/(?:[^?#]*/)?)', 1), ''), '/') || href end as link_url
    from found where {" and ".join(f"not starts_with(href, {q(x)})" for x in ["#", "mailto:", "tel:", "javascript:"])})
  where regexp_extract(link_url, '{_P}', 2) <> ''
),
site as (
  select *, regexp_replace(regexp_replace(link_url, '[?#].*$', ''), '/+$', '') as clean_url from page_links
  where {_HOST % 'url'} = {_HOST % 'link_url'}
)"""
_MATCHES = " + ".join(f"contains(lower(regexp_extract(clean_url, '{_P}', 3) || ' ' || label), {q(t)})::int" for t in T.PRIORITY_PATH_TERMS)


@query("page_links", with_(_FOUND, select="select page_id, link_pos, link_url, label from page_links"))
def page_links(spark, sf_dir):
    links = web.page_links(web.parse_pages(V.table(spark, sf_dir, "pages")))
    return links.select("page_id", F.col("link_pos").cast("bigint").alias("link_pos"), "link_url", "label")


@query("site_link_counts", with_(_FOUND, select="select page_id, count(*) as links from site group by page_id"))
def site_link_counts(spark, sf_dir):
    links = web.same_site_links(web.page_links(web.parse_pages(V.table(spark, sf_dir, "pages"))))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


@query("priority_links", with_(_FOUND, select=f"""
select page_id, link_url, matches, cast(row_number() over (partition by page_id order by matches desc, link_url desc) as bigint) as rank from (
  select page_id, clean_url as link_url, cast(max({_MATCHES}) as bigint) as matches from site
  where {_MATCHES} > 0 and clean_url <> url group by 1, 2)"""))
def priority_links(spark, sf_dir):
    out = web.priority_links(web.page_links(web.parse_pages(V.table(spark, sf_dir, "pages"))))
    return out.select("page_id", "link_url", F.col("matches").cast("bigint").alias("matches"), F.col("rank").cast("bigint").alias("rank"))


# link rows derived from the stored URLs: every page links to topic paths of its own site
TOPICS = ["/about", "/pricing/case", "/news?x=1", "/shop", "/solution/customer/", "/blog#top", "/contact"]


def _links(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    hops = F.array(*[F.lit(i) for i in range(7)])
    df = p.select("page_id", "url", F.explode(hops).alias("link_pos"))
    return df.withColumns({
        "link_url": urls.join("url", V.pick(TOPICS, F.col("page_id") + F.col("link_pos") * F.col("link_pos"))),
        "label": V.pick(["Careers", "", "Case study", "Services"], F.col("page_id") + F.col("link_pos")),
    })


_LINKS = rf"""
links as (
  select page_id, url, link_pos, regexp_extract(url, '^(https?://[^/?#]*)', 1) || {V.pick_sql(TOPICS, '(page_id + link_pos * link_pos)')} as link_url,
    {V.pick_sql(["Careers", "", "Case study", "Services"], '(page_id + link_pos)')} as label
  from pages, (select unnest([0, 1, 2, 3, 4, 5, 6]) as link_pos)
),
site as (select *, regexp_replace(regexp_replace(link_url, '[?#].*$', ''), '/+$', '') as clean_url from links)"""


@query("priority_link_ranks_whole", with_(_LINKS, select=rf"""
select *, row_number() over (partition by page_id order by matches desc, link_url desc) as rank from (
  select page_id, clean_url as link_url, cast(max(m) as bigint) as matches from (
    select *, {" + ".join(f"contains(lower(regexp_extract(clean_url, '{_P}', 3) || ' ' || label), {q(t)})::int" for t in T.PRIORITY_PATH_TERMS)} as m from site)
  where m > 0 and clean_url <> url group by page_id, clean_url)"""))
def priority_link_ranks_whole(spark, sf_dir):
    return _ranked(web.priority_links(_links(spark, sf_dir)))


#: The name under which four links a page were shown; all of them are, now.
query("priority_link_ranks", SQL["priority_link_ranks_whole"])(priority_link_ranks_whole)


def _ranked(found):
    return found.select("page_id", "link_url", F.col("matches").cast("bigint").alias("matches"), F.col("rank").cast("bigint").alias("rank"))


def _stores(spark, sf_dir):
    df = built(spark, sf_dir).filter("is_valid")
    extra = df.select(F.col("row_idx").alias("page_id"), F.explode(F.array(
        F.lit("https://play.google.com/store/apps/x"), F.concat(F.lit("https://apps.apple.com/"), F.lit("de/app/id"), F.col("row_idx").cast("string")))).alias("link_url"))
    return web.app_store_links(extra, df.withColumn("page_id", F.col("row_idx")))


_STORES = r"""
stores as (
  select row_idx as page_id, link_url, row_number() over (partition by row_idx order by case when contains(link_url, 'apps.apple.com') then 0 else 1 end, lower(link_url)) as rank
  from (select row_idx, 'https://play.google.com/store/apps/x' as link_url from leads where url_error is null
    union select row_idx, 'https://apps.apple.com/de/app/id' || row_idx from leads where url_error is null
    union select row_idx, app_store_url from leads where url_error is null and app_store_url <> '')
)"""


@query("app_store_links", with_(V.LEADS, _STORES, select=r"""
select page_id, link_url, cast(rank as bigint) as rank, regexp_extract(link_url, '/id([0-9]+)', 1) as app_id,
  case when regexp_matches(link_url, 'apps\.apple\.com/[a-z]{2}/') then regexp_extract(link_url, 'apps\.apple\.com/([a-z]{2})/', 1) else 'us' end as country from stores where rank <= 3"""))
def app_store_links(spark, sf_dir):
    app_id, country = web.app_identity("link_url")
    return _stores(spark, sf_dir).select("page_id", "link_url", F.col("rank").cast("bigint").alias("rank"), app_id.alias("app_id"), country.alias("country"))


@query("page_summary", with_(V.SITE_PAGES, select=r"""
select company_key, count(*) as pages, string_agg('Source: ' || url || chr(10) || 'Title: ' || case when title = '' then url else title end || chr(10) || 'Text: ' || text, chr(10) || chr(10) order by page_pos) as summary,
  string_agg(url, ' | ' order by page_pos) as source_urls, sum(length(text)) + count(*) - 1 < 500 as thin_content from site_pages group by company_key"""))
def page_summary(spark, sf_dir):
    """All pages of a company as one text; page_excerpts has the same as rows."""
    return web.company_summary(V.site_pages(spark, sf_dir)).select("company_key", "pages", "summary", "source_urls", "thin_content")


@query("page_totals", with_(V.SITE_PAGES, select="""
select company_key, count(*) as pages, cast(sum(length(text)) + count(*) - 1 as bigint) as text_chars,
  sum(length(text)) + count(*) - 1 < 500 as thin_content from site_pages group by company_key"""))
def page_totals(spark, sf_dir):
    return web.company_totals(V.site_pages(spark, sf_dir))


@query("page_excerpts", with_(V.SITE_PAGES, select=r"""
select company_key, page_id, row_number() over (partition by company_key order by page_pos) as page_rank,
  'Source: ' || url || chr(10) || 'Title: ' || case when title = '' then url else title end || chr(10) || 'Text: ' || text as excerpt from site_pages"""))
def page_excerpts(spark, sf_dir):
    return web.company_excerpts(V.site_pages(spark, sf_dir)).select("company_key", "page_id", "page_rank", "excerpt")


@query("page_acceptance", with_(V.SITE_PAGES, select="""
select page_id, page_id % 2 = 0 and length(text) >= 500 as usable_home from site_pages where page_id % 2 = 0 or length(text) > 120"""))
def page_acceptance(spark, sf_dir):
    df = V.site_pages(spark, sf_dir).withColumn("is_home", F.col("page_id") % 2 == 0)
    return web.accepted_pages(df).select("page_id", "usable_home")


@query("page_versions", with_(V.SITE_PAGES, select="""
select url, arg_max(kind, [len_, -prio]) as version_kind, max(len_) as chars from (
  select url, 'static' as kind, 0 as prio, length(text) as len_ from site_pages union all
  select url, 'rendered', 1, length(title) * 40 from site_pages) group by url"""))
def page_versions(spark, sf_dir):
    p = V.site_pages(spark, sf_dir)
    static = p.select("url", "text", F.lit("static").alias("version_kind"), F.lit(0).alias("version_priority"))
    other = p.select("url", F.repeat("title", F.lit(40)).alias("text"), F.lit("rendered").alias("version_kind"), F.lit(1).alias("version_priority"))
    return web.longer_version(static.unionByName(other)).select("url", "version_kind", F.length("text").cast("bigint").alias("chars"))


@query("company_rows", with_(V.LEADS, V.SITE_PAGES, select=f"""
select l.row_idx, case when p.company_key is null then 'research_failed' when l.row_idx % 5 = 0 then 'evidence_failed' else 'ready' end as row_state,
  case when p.company_key is null then 'research_failed' when l.row_idx % 5 = 0 then 'evidence_failed' else '' end as quality_flags
from leads l left join (select distinct company_key from site_pages) p on {_HOST % 'l.website_url'} = p.company_key"""))
def company_rows(spark, sf_dir):
    df = built(spark, sf_dir).withColumn("company_key", urls.host("website_url"))
    fact = F.when(F.col("row_idx") % 5 != 0, F.struct(
        F.lit("signup_friction").alias("friction_type"), F.lit("app").alias("surface_checked"), F.lit("activation").alias("conversion_outcome"), F.lit(False).alias("blog_used")))
    summaries = web.company_summary(V.site_pages(spark, sf_dir)).select("company_key", "summary", "source_urls")
    joined = outreach.attach_research(df.withColumn("selected", fact), summaries)
    return joined.select("row_idx", "row_state", "quality_flags")


# --- reviews -------------------------------------------------------------------------------------------
_COMPLAINTS = V.REVIEWS + f""",
complaints as (
  select *, 'Apple review (' || case when rating = '' then 'unknown' else rating end || ' stars): ' || text as complaint
  from reviews where rating in ('1', '2', '3') or {any_sql('lower(text)', T.COMPLAINT_TERMS)}
)"""


def _complaints(spark, sf_dir):
    r = V.reviews(spark, sf_dir)
    r = r.filter(web.is_complaint(F.col("text"), F.col("rating")))
    return r.withColumn("complaint", web.format_complaint(F.col("text"), F.col("rating")))


@query("review_complaints", with_(_COMPLAINTS, select="select app_key, pos, complaint from complaints"))
def review_complaints(spark, sf_dir):
    return _complaints(spark, sf_dir).select("app_key", "pos", "complaint")


@query("review_themes", with_(_COMPLAINTS, select=f"""
select app_key, theme, n as signals, theme || ': ' || n || ' public review signal(s), e.g. ' || ex as theme_text from (
    select app_key, theme, count(*) as n, arg_min(complaint, pos) as ex from (
      select *, unnest({flags_sql(*[(any_sql('lower(complaint)', t), n) for n, t in T.REVIEW_THEMES.items()])}) as theme from complaints)
    group by 1, 2)"""))
def review_themes(spark, sf_dir):
    return web.review_themes(_complaints(spark, sf_dir)).select("app_key", "theme", "signals", "theme_text")


@query("review_feed", with_(V.REVIEWS, select=f"""
select pos as app_key, 'Apple review (' || case when rating = '' then 'unknown' else rating end || ' stars): ' || t as complaint
from (select pos, rating, trim('Title: ' || text, ': ') as t from reviews) where rating in ('1', '2', '3') or {any_sql('lower(t)', T.COMPLAINT_TERMS)}"""))
def review_feed(spark, sf_dir):
    label = lambda c: F.struct(c.alias("label"))
    entry = F.struct(label(F.lit("Title")).alias("title"), label(F.col("text")).alias("content"), label(F.col("rating")).alias("im:rating"))
    many = F.to_json(F.struct(F.struct(F.array(entry).alias("entry")).alias("feed")))
    single = F.to_json(F.struct(F.struct(entry.alias("entry")).alias("feed")))
    feeds = V.reviews(spark, sf_dir).select(
        F.col("pos").alias("app_key"), F.when(F.col("pos") % 2 == 0, many).otherwise(single).alias("feed_json"))
    return web.feed_complaints(feeds).select("app_key", "complaint")


# --- page metrics -----------------------------------------------------------------------------------------
_RULES = [
    ("over_px > 32 and (offscreen > 0 or right_px > 24)", "case when offscreen >= 2 or right_px > 64 then 90 else 82 end"),
    ("cta = 0 and chars > 500", "62"), ("cta > 0 and above = 0 and top_px > 800 * 1.05::double", "72"),
    ("ptext <> '' and sure and contrast > 0 and contrast < 3", "case when contrast < 2.5 then 72 else 60 end"),
    ("ptext <> '' and top_px > 800 * 1.05::double", "72"), ("hidden <> 0", "68"), ("viewport = 'mobile' and taps >= 2", "48"), ("above > 6", "62"),
]
_OBS = V.PAGE_METRICS + f""",
obs as (select *, {flags_sql(*[(r, n) for (r, _), n in zip(_RULES, web.VISUAL_FLAGS)])} as vf,
  greatest({", ".join(f"case when {r} then {s} else 0 end" for r, s in _RULES)}) as score from pm)"""


@query("visual_flags", with_(_OBS, select=f"select page_key, part_key, supp_key, viewport, {join_sql('vf')} as flags, cast(score as bigint) as viewport_score from obs"))
def visual_flags(spark, sf_dir):
    return web.visual_observations(V.page_metrics(spark, sf_dir)).select(
        "page_key", "part_key", "supp_key", "viewport", X.join_list("visual_quality_flags").alias("flags"), F.col("viewport_score").cast("bigint").alias("viewport_score"))


_SHOWN = {
    "px": "cast(floor(over_px) as bigint)", "off": "offscreen", "cta": "ptext", "contrast": "printf('%.1f', contrast)", "hidden": "hidden", "taps": "taps", "above": "above"}
_SAID = {
    **dict(zip(["overflow", "no_cta", "no_fold", "low_contrast", "below", "hidden", "taps", "crowded"], [r for r, _ in _RULES])),
    "quiet": "ptext <> '' and not (" + " or ".join(f"({r})" for r, _ in _RULES) + ")",
    "weak_overflow": f"over_px > 32 and not ({_RULES[0][0]})", "weak_cta": "cta = 0 and not chars > 500",
    "weak_contrast": "ptext <> '' and contrast > 0 and contrast < 3 and not sure"}


def _said_sql(sentences):
    def filled(text):
        parts = re.split(r"\{(\w+)\}", text)
        return " || ".join([q(": " + parts[0]), *[_SHOWN[x] if i % 2 else q(x) for i, x in enumerate(parts[1:], 1)]])

    cases = ", ".join(f"case when {_SAID[n]} then viewport || {filled(s)} end" for n, s in sentences.items())
    return f"array_to_string(list_filter([{cases}], lambda x: x is not null), chr(10))"


@query("visual_text", with_(V.PAGE_METRICS, select=f"""
select page_key, part_key, supp_key, l_linenumber, {_said_sql(T.VISUAL_NOTES)} as notes, {_said_sql(T.VISUAL_REASONS)} as reasons from pm"""))
def visual_text(spark, sf_dir):
    """Every sentence that the page metrics give rise to."""
    df = web.visual_observations(V.page_metrics(spark, sf_dir))
    return df.select("page_key", "part_key", "supp_key", "l_linenumber", F.array_join("observations", "\n").alias("notes"), F.array_join("confidence_reasons", "\n").alias("reasons"))


@query("visual_confidence", with_(_OBS, select="""
select page_key, cast(score as bigint) as visual_confidence_score, case when score >= 80 then 'high' when score >= 60 then 'medium' when score > 0 then 'low' else 'none' end as visual_confidence,
  coalesce(flags, '') as visual_quality_flags from (select page_key, max(score) as score from obs group by 1) left join (
  select page_key, string_agg(f, ' | ' order by p) as flags from (
    select page_key, f, min((case when viewport = 'desktop' then 0 else 10 end) + list_position(%s, f)) as p from (select *, unnest(vf) as f from obs) group by 1, 2) group by 1) using (page_key)""" % items(web.VISUAL_FLAGS)))
def visual_confidence(spark, sf_dir):
    out = web.merge_viewports(web.visual_observations(V.page_metrics(spark, sf_dir, as_text=False)))
    return out.select("page_key", F.col("visual_confidence_score").cast("bigint").alias("visual_confidence_score"), "visual_confidence",
                      X.join_list("visual_quality_flags").alias("visual_quality_flags"))


def _checks(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("page_key"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("link_pos"),
        F.concat(F.lit("https://x.example/"), F.col("l_partkey").cast("string")).alias("link_url"), F.col("l_returnflag").alias("label"),
        F.when(F.col("l_partkey") % 7 == 0, F.lit(None)).otherwise(F.lit(200) + F.col("l_partkey") % 4 * 100).cast("int").alias("status"))


_CHECKS = """
checks as (select l_suppkey as page_key, l_orderkey * 1000000 + l_partkey * 8 + l_linenumber as link_pos, 'https://x.example/' || l_partkey as link_url, l_returnflag as label,
  case when l_partkey % 7 = 0 then null else 200 + l_partkey % 4 * 100 end as status from lineitem)"""


@query("failed_links", with_(_CHECKS, select="""
select page_key, link_pos, case when status is null then 'dead_link_check_failed: ' else 'dead_link_candidate: ' || status || ' ' end || link_url || ' (' || label || ')' as note
from checks where status is null or status >= 400"""))
def failed_links(spark, sf_dir):
    return web.failed_links(_checks(spark, sf_dir)).select("page_key", "link_pos", "note")


@query("failed_responses", with_(_CHECKS, select="""
select page_key, link_pos, status || ' ' || link_url as note from checks where status >= 400"""))
def failed_responses(spark, sf_dir):
    return web.failed_responses(_checks(spark, sf_dir)).select("page_key", "link_pos", "note")


@query("element_findings", with_(V.PAGE_METRICS, select=f"""
select page_key, part_key, supp_key, {join_sql(flags_sql(("over_px > 32", "A"), ("cta > 0 and above = 0", "B"), ("cta = 0 and chars > 500", "C"), ("right_px < 44 or top_px < 36", "D")))} as kinds from pm"""))
def element_findings(spark, sf_dir):
    m = F.from_json("metrics", web.METRICS_SCHEMA)
    df = V.page_metrics(spark, sf_dir).withColumn("m", m).withColumns({
        "horizontal_overflow": F.col("m.horizontalOverflowPx"), "cta_count": F.col("m.ctaCount"), "cta_above_fold": F.col("m.ctaAboveFoldCount"),
        "page_text": F.col("m.bodyTextLength"), "first_cta_width": F.col("m.maxRightOverflowPx"), "first_cta_height": F.col("m.primaryCta.top")})
    out = web.element_findings(df)
    all_text = F.array_join("findings", " ")
    return out.select("page_key", "part_key", "supp_key", X.join_list(X.flags(
        (all_text.contains("broken formatting"), "A"), (all_text.contains("CTA exists"), "B"), (all_text.contains("content-rich"), "C"),
        (all_text.contains("first CTA-like"), "D"))).alias("kinds"))


def _axe(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    k = F.col("page_id")
    v = lambda i: F.struct(
        V.pick(["critical", "minor", "serious", "moderate", ""], k + i).alias("impact"), V.pick(["color-contrast", "region", "label", "tabindex"], k + i * i).alias("id"),
        F.lit("Fix it").alias("help"), F.array(F.lit("a"), F.lit("b")).alias("nodes"))
    return p.select(k.alias("page_key"), F.lit("mobile").alias("viewport"), F.to_json(F.struct(F.array(*[v(i) for i in range(10)]).alias("violations"))).alias("report_json"))


@query("axe_findings", f"""
select page_key, 'axe_' || id as flag, 'mobile: axe-core ' || case when impact = '' then 'unknown' else impact end || ' issue, Fix it (2 node(s)).' as finding, pos from (
  select page_id as page_key, i as pos, {V.pick_sql(["critical", "minor", "serious", "moderate", ""], '(page_id + i)')} as impact, {V.pick_sql(["color-contrast", "region", "label", "tabindex"], '(page_id + i * i)')} as id
  from pages, (select unnest(range(10)) as i)) where impact in ('critical', 'serious') or id in ('color-contrast', 'label')""")
def axe_findings(spark, sf_dir):
    return web.axe_findings(_axe(spark, sf_dir)).select("page_key", "flag", "finding", F.col("pos").cast("bigint").alias("pos"))


@query("audit_findings", """
select page_key, flag, finding from (
  select page_id as page_key, case when round_even(s * 100, 0) < 70 then 'lighthouse_low_performance' else '' end as flag, 'Lighthouse mobile performance score: ' || cast(round_even(s * 100, 0) as int) || '/100.' as finding from (select *, page_id % 101 / 100.0::double as s from pages)
  union all select page_id, '', 'Lighthouse mobile seo score: 50/100.' from pages
  union all select page_id, 'lighthouse_tap-targets', 'Lighthouse issue: Tap targets.' from pages where page_id % 2 = 0)""")
def audit_findings(spark, sf_dir):
    k = F.col("page_id")
    score = lambda c: F.struct(c.alias("score"))
    report = F.to_json(F.struct(
        F.struct(score(k % 101 / F.lit(100.0)).alias("performance"), score(F.lit(0.5)).alias("seo")).alias("categories"),
        F.struct(F.struct((k % 2).cast("double").alias("score"), F.lit("Tap targets").alias("title")).alias("tap-targets")).alias("audits")))
    return web.audit_findings(V.table(spark, sf_dir, "pages").select(k.alias("page_key"), report.alias("report_json"))).select("page_key", "flag", "finding")


@query("detector_merge", f"""
select page_key, kind, value, min(pos) as first_pos, count(*) as times from (
  select l_orderkey as page_key, l_linenumber as pos, unnest([{{'kind': 'flag', 'value': case when l_partkey % 4 = 0 then '' else 'flag_' || l_partkey % 6 end}},
    {{'kind': 'finding', 'value': l_returnflag || ' ' || l_partkey % 3}}], recursive := true) from lineitem)
where value <> '' group by 1, 2, 3""")
def detector_merge(spark, sf_dir):
    """Findings of several detectors per measured page, distinct in first-seen order."""
    li = V.table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.col("l_orderkey").alias("page_key"), F.col("l_linenumber").cast("bigint").alias("pos"),
        F.when(F.col("l_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("flag_"), (F.col("l_partkey") % 6).cast("string"))).alias("flag"),
        F.concat("l_returnflag", F.lit(" "), (F.col("l_partkey") % 3).cast("string")).alias("finding"))
    return web.merge_detectors(rows).select("page_key", "kind", "value", "first_pos", "times")


@query("deep_research")
def deep_research(spark, sf_dir):
    df = built(spark, sf_dir).withColumn("page_id", F.col("row_idx")).drop("app_store_url")
    pages = V.table(spark, sf_dir, "pages")
    store_pages = pages.select(
        F.concat(F.lit("https://apps.apple.com/de/app/id"), F.col("page_id").cast("string")).alias("url"), F.lit("").alias("title"), html.visible_text(F.col("html")).alias("text"))
    talk = _complaints(spark, sf_dir).withColumn("page_id", F.col("pos"))
    themes = web.review_themes(talk, "page_id")
    out = web.deep_research(df, _stores(spark, sf_dir), store_pages, talk, themes)
    return out.select("page_id", "app_store_url", "app_store_summary", "app_review_themes", "app_review_complaints", "deep_source_urls", "deep_notes")


@query("deep_links", with_(V.LEADS, _STORES, f"store_pages as (select 'https://apps.apple.com/de/app/id' || page_id as link_url, {html.visible_sql()} as text from pages)", select="""
select s.page_id, s.link_url, cast(s.rank as bigint) as rank, p.text is not null as found, 'Source: ' || s.link_url || chr(10) || 'Title: ' || chr(10) || 'Text: ' || p.text as excerpt
from stores s left join store_pages p using (link_url)"""))
def deep_links(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("https://apps.apple.com/de/app/id"), F.col("page_id").cast("string")).alias("url"), F.lit("").alias("title"), html.visible_text(F.col("html")).alias("text"))
    return web.deep_links(_stores(spark, sf_dir), pages).select("page_id", "link_url", F.col("rank").cast("bigint").alias("rank"), "found", "excerpt")


@query("deep_complaints", with_(_COMPLAINTS, select="""
select app_key, pos, complaint, row_number() over (partition by app_key order by pos) as complaint_rank from complaints"""))
def deep_complaints(spark, sf_dir):
    return web.deep_complaints(_complaints(spark, sf_dir), "app_key").select("app_key", "pos", "complaint", F.col("complaint_rank").cast("bigint").alias("complaint_rank"))


@query("research_only_rows", with_(V.LEADS, select=f"""
select row_idx, case when s = 'app_first_product' then 'Research priority: ' || p || ' | ' else '' end || rtrim('Source: ' || website_url) as evidence_points,
  'offline_research_only | ai_generation_unavailable | visual_no_clear_cta' as quality_flags
from (select *, case s {" ".join(f"when {q(k)} then {q(v)}" for k, v in T.RESEARCH_PRIORITY.items())} else {q(T.RESEARCH_PRIORITY_DEFAULT)} end as p from (select *, {_SURFACE} as s from leads))"""))
def research_only_rows(spark, sf_dir):
    df = outreach.classify_surface(built(spark, sf_dir)).withColumns({
        "research_priority": outreach.research_priority(), "first_pages_text": X.strip(F.concat(F.lit("Source: "), "website_url")),
        "visual_quality_flags": F.lit("visual_no_clear_cta")})
    return outreach.research_only_rows(df).select("row_idx", "evidence_points", "quality_flags")
