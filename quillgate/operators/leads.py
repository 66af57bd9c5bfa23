"""Lead files: header aliases, cell cleaning, fill-down, validation, dedupe, depth score."""

from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import text as X
from quillgate.functions import urls
from quillgate.functions.stats import clamp
from quillgate.operators.rows import fill_down, lookup_join, settle


def _cell(c):
    return X.strip(F.regexp_replace(X.text(c), "[\r\n]", " "))


def prepare(df, order="row_idx"):
    """Trim headers, clean cells, apply header aliases and carry company columns down.

    When several headers mean the same column, the first non-blank one wins.
    """
    renamed = {c: c.strip() for c in df.columns}
    df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in renamed.items()])
    values = [c for c in df.columns if c != order]
    df = df.select(order, *[_cell(F.col(f"`{c}`")).alias(c) for c in values])
    original = F.create_map(*[
        p for c in values for p in (F.lit(c), X.collapse(F.col(f"`{c}`")))
    ])
    df = fill_down(df, [c for c in T.FILL_DOWN_COLUMNS if c in values], order)
    df = df.withColumn("original_columns", original)
    targets = {}
    for header, target in T.HEADER_ALIASES:
        if header in values and target not in values:
            targets.setdefault(target, []).append(header)
    return df.withColumns({
        target: X.first_present(*[F.col(f"`{h}`") for h in headers])
        for target, headers in targets.items()
    })


def check_layout(columns):
    """Raise when none of the accepted layouts fits the header row."""
    names = {c.strip() for c in columns}
    aliases = {t for h, t in T.HEADER_ALIASES if h in names} | names
    standard = {"company_name", "website_url"} <= aliases
    client = {"Organization Name", "Website"} <= names
    if not (standard or client):
        raise ValueError(
            "Lead file needs company_name/website_url, Organization Name/Website or "
            "Company Name/Website columns."
        )


def _pick(df, headers):
    present = [F.col(f"`{h}`") for h in headers if h in df.columns]
    return X.collapse(X.first_present(*present, skip=["—"])) if present else F.lit("")


def url_error(raw):
    """Error text of a URL that already has its scheme, null when it is fine."""
    return F.when(X.col(raw) == "", F.lit(T.ERR_URL_MISSING)).when(
        ~X.col(raw).rlike(r"^https?://[^/?#]"), F.lit(T.ERR_URL_INVALID)
    )


def depth_score(df_cols=None):
    """0..1 research depth from the lead's own fields."""
    def has(name, weight):
        return F.when(X.clean(name) != "", F.lit(weight)).otherwise(F.lit(0.0))

    context = F.lower(X.clean("campaign_context"))
    generic = X.has_any(context, T.GENERIC_CONTEXT_TERMS)
    combined = F.lower(F.concat_ws(
        " ", X.text("company_name"), X.text("optional_notes"), X.text("campaign_context")
    ))
    score = (
        F.lit(0.3)
        + has("linkedin_url", 0.1)
        + has("linkedin_observation", 0.075)
        + has("recipient_role", 0.05)
        + has("app_store_url", 0.075)
        + has("app_flow_observation", 0.05)
        + F.when(context == "", F.lit(0.0)).when(generic, F.lit(0.04)).otherwise(F.lit(0.1))
        + has("competitor_context", 0.075)
        + has("optional_notes", 0.05)
        + F.when(X.has_any(combined, T.ENTERPRISE_TERMS), F.lit(0.1)).otherwise(F.lit(0.0))
    )
    return clamp(F.bround(score, 2), 0.0, 1.0)


def build_leads(prepared, default_context="", order="row_idx"):
    """Canonical lead rows with validation errors, depth and the original cells."""
    df = prepared
    raw_url = _pick(df, ["website_url", "Website"])
    df = df.withColumn("__url", raw_url).withColumn("__raw", urls.with_scheme("__url"))
    df = df.withColumns({"__norm": urls.normalize("__raw"), "__url_error": url_error("__raw")})
    df = settle(df, ["__norm", "__url_error"])
    company = X.first_present(
        _pick(df, ["company_name", "Organization Name", "Organization Name.1"]),
        F.when(F.col("__url_error").isNull(), urls.company_from_host("__norm")).otherwise(F.lit("")),
    )
    context = X.first_present(_pick(df, ["campaign_context"]), F.lit(default_context))
    out = df.select(
        order,
        company.alias("company_name"),
        F.col("__norm").alias("website_url"),
        context.alias("campaign_context"),
        *[_pick(df, headers).alias(name) for name, headers in T.LEAD_FIELD_SOURCES.items()],
        (F.col("original_columns") if "original_columns" in df.columns
         else F.create_map().cast("map<string,string>")).alias("original_columns"),
        F.col("__url_error"),
    )
    errors = X.array_of(
        F.col("__url_error"),
        F.when(F.col("company_name") == "", F.lit(T.ERR_COMPANY_MISSING)),
    )
    out = out.withColumn("validation_errors", errors).drop("__url_error")
    out = out.withColumn("is_valid", F.size("validation_errors") == 0)
    out = settle(out, ["company_name", "website_url", "validation_errors", "is_valid"])
    return out.withColumn("research_depth", depth_score())


def dedupe_key():
    host = urls.host("website_url")
    return F.when(host != "", F.concat(F.lit("site:"), host)).otherwise(
        F.concat(F.lit("name:"), F.lower(X.clean("company_name")))
    )


def mark_duplicates(leads, order="row_idx"):
    """The first valid row of a website (or company) stays; later ones become invalid.

    The first position per key is a partial aggregate, and it is joined back on the unique
    row number, so one key with a third of all rows never meets in one task.
    """
    valid = leads.filter("is_valid").select(dedupe_key().alias("__key"), order)
    firsts = valid.groupBy("__key").agg(F.min(order).alias(order)).select(
        order, F.lit(True).alias("__first")
    )
    marked = leads.join(firsts, order, "left")
    duplicate = F.col("is_valid") & F.col("__first").isNull()
    return marked.withColumns({
        "is_duplicate": duplicate,
        "validation_errors": F.when(
            duplicate, F.concat("validation_errors", F.array(F.lit(T.ERR_DUPLICATE)))
        ).otherwise(F.col("validation_errors")),
        "is_valid": F.col("is_valid") & ~duplicate,
    }).drop("__first")


def load_leads(df, default_context="", deduplicate=True, order="row_idx"):
    """Whole lead step on a raw table that carries a row number."""
    check_layout(df.columns)
    leads = build_leads(prepare(df, order), default_context, order)
    if deduplicate:
        return mark_duplicates(leads, order)
    return leads.withColumn("is_duplicate", F.lit(False))


def page_budget(max_pages):
    """Number of pages to read for a lead, by depth."""
    return F.greatest(F.lit(1), F.bround(F.col("research_depth") * F.lit(float(max_pages)), 0).cast("int"))


def deep_research_eligible():
    return F.col("is_valid") & (F.col("research_depth") >= 0.6)


def expand_original(df, keys, source="original_columns"):
    """Open tail: one ``input__<name>`` column per key of the original-row map."""
    return df.withColumns({
        f"input__{k}": F.coalesce(F.col(source)[k], F.lit("")) for k in keys
    })


def keep_filled(df, source="original_columns"):
    """The open tail without blank cells; rows without a tail have an empty one."""
    empty = F.create_map().cast("map<string,string>")
    return df.withColumn(source, F.coalesce(F.map_filter(source, lambda k, v: X.clean(v) != ""), empty))


def tail_rows(df, prefix="", order="row_idx", source="original_columns"):
    """(order, key, value) of the open-tail cells whose name begins with ``prefix`` in any case."""
    picked = F.map_filter(source, lambda k, v: F.startswith(F.lower(k), F.lit(prefix.lower())))
    return df.select(order, F.explode(picked).alias("key", "value"))


def original_keys(df, source="original_columns"):
    """Distinct original headers, case-insensitive order (a schema-sized list)."""
    keys = df.select(F.explode(F.map_keys(source)).alias("key")).distinct()
    return keys.orderBy(F.lower("key"), "key")


def attach_workspace(args, workspaces, key="client_id"):
    """Workspace defaults fill only the blank arguments."""
    fields = {
        "tone_profile": "tone_profile",
        "campaign_context": "default_campaign_context",
        "research_region": "default_research_region",
        "export_preset": "default_export_preset",
    }
    dim = workspaces.select(key, *[F.col(d).alias(f"__{f}") for f, d in fields.items()])
    joined = lookup_join(args, dim, [key])
    return joined.withColumns({
        f: X.first_present(F.col(f), F.col(f"__{f}")) for f in fields
    }).drop(*[f"__{f}" for f in fields])


def reuse_for_contacts(contacts, processed, order="row_idx"):
    """One company's finished row serves all its contacts; contact columns win.

    ``processed`` holds one row per website.
    """
    contact_columns = [c for c in [
        "company_name", "website_url", "linkedin_url", "recipient_name", "recipient_role",
        "campaign_context", "linkedin_observation", "linkedin_source_note", "app_store_url",
        "app_flow_observation", "app_flow_source_note", "screenshot_url", "recent_news_url",
        "recent_news_note", "competitor_context", "original_columns",
    ] if c in contacts.columns]
    left = contacts.select(order, *contact_columns, dedupe_key().alias("__key"))
    right = processed.withColumn("__key", dedupe_key())
    right = right.select("__key", *[c for c in right.columns if c not in left.columns])
    joined = lookup_join(left, right, ["__key"], how="inner").drop("__key")
    return joined.withColumn(
        "reviewer_notes",
        X.join_present(F.col("reviewer_notes"), F.lit(T.NOTE_REUSED)),
    )
