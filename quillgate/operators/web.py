"""Stored pages, links, reviews, page metrics and audit reports."""

from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import html as H
from quillgate.functions import text as X
from quillgate.functions import urls
from quillgate.operators.rows import lookup_join, rank_in_order, top_k


def parse_pages(pages, html="html", keep=("page_id", "url")):
    """Title, visible text and raw links of each page."""
    c = F.col(html)
    return pages.select(*keep, H.title(c).alias("title"), H.visible_text(c).alias("text"), H.links(c).alias("links"))


def cut_text(c, limit):
    return F.left(c, F.lit(limit))


def page_links(parsed, url="url", links="links"):
    """Absolute http(s) links with label; anchors, mail, phone and script links are skipped."""
    rows = parsed.select("page_id", url, F.posexplode(links).alias("link_pos", "l"))
    rows = rows.select("page_id", url, "link_pos", F.col("l.href").alias("href"), X.collapse("l.label").alias("label"))
    skip = X.starts_any("href", ["#", "mailto:", "tel:", "javascript:"])
    rows = rows.filter(~skip).withColumn("link_url", urls.join(url, "href"))
    return rows.filter(urls.netloc("link_url") != "")


def same_site_links(links, url="url"):
    """Links on the page's own site, as URL without query, fragment and trailing slash."""
    return links.filter(urls.same_host(url, "link_url")).withColumn("link_url", urls.strip_query("link_url"))


def priority_links(links, url="url", max_pages=None):
    """Links whose path or label names a priority topic: most matches first, URL descending
    on ties, each URL once; all of them, or at most max_pages-1 per page where that is given."""
    site = same_site_links(links, url)
    hay = F.lower(F.concat_ws(" ", urls.path("link_url"), "label"))
    score = sum((hay.contains(t).cast("int") for t in T.PRIORITY_PATH_TERMS), F.lit(0))
    scored = site.withColumn("matches", score).filter((F.col("matches") > 0) & (F.col("link_url") != F.col(url)))
    unique = scored.groupBy("page_id", "link_url").agg(F.max("matches").alias("matches"))
    return top_k(unique, ["page_id"], [F.desc("matches"), F.desc("link_url")], None if max_pages is None else max_pages - 1)


def app_store_links(links, leads=None, k=None):
    """All app-store links per page, best store first, or the first k."""
    hit = X.any_of([F.col("link_url").contains(d) for d in T.APP_STORE_DOMAINS])
    rows = links.filter(hit).select("page_id", "link_url")
    if leads is not None:
        rows = rows.unionByName(
            leads.filter(X.clean("app_store_url") != "").select("page_id", F.col("app_store_url").alias("link_url")))
    low = F.lower("link_url")
    rank = F.when(low.contains("apps.apple.com"), 0).when(low.contains("play.google.com"), 1).otherwise(9)
    unique = rows.distinct().withColumn("store_rank", rank)
    return top_k(unique, ["page_id"], [F.col("store_rank"), F.lower("link_url"), F.col("link_url")], k)


def app_identity(url, configured=""):
    """(app id, store country) of an app-store URL."""
    app_id = F.regexp_extract(X.text(url), "/id([0-9]+)", 1)
    found = F.regexp_extract(X.text(url), r"apps\.apple\.com/([a-z]{2})/", 1)
    wanted = (configured or "").strip().lower()
    country = F.lit(wanted) if wanted and wanted != "auto" else F.when(found == "", "us").otherwise(found)
    return app_id, country


def accepted_pages(pages, is_home="is_home", text="text"):
    """The home page always counts; other pages need more than 120 characters."""
    return pages.filter(F.col(is_home) | (F.length(text) > 120)).withColumn(
        "usable_home", F.col(is_home) & (F.length(text) >= T.MIN_USEFUL_TEXT_CHARS))


def longer_version(versions, key="url"):
    """Of several stored versions of a page the longest text; the earlier namespace wins ties."""
    columns = [c for c in versions.columns if c != key]
    best = F.max_by(F.struct(*columns), F.struct(F.length("text"), -F.col("version_priority")))
    out = versions.groupBy(key).agg(best.alias("b")).select(key, *[F.col(f"b.{c}").alias(c) for c in columns])
    return out.withColumn("reviewer_note", F.when(
        F.col("version_kind") == "rendered",
        F.concat(F.lit("Browser-rendered fallback used for "), key)).otherwise(""))


def page_excerpt(url="url", title="title", text="text", n=None, url_as_title=True):
    """Source, title and text of a page; the whole text unless ``n`` characters are asked for."""
    label = X.text(title)
    if url_as_title:
        label = F.when(label == "", F.col(url)).otherwise(label)
    body = F.col(text) if n is None else F.left(text, F.lit(n))
    return F.concat(F.lit("Source: "), url, F.lit("\nTitle: "), label, F.lit("\nText: "), body)


def company_totals(pages, key="company_key"):
    """Pages, characters and thin-content flag per company over all its pages."""
    chars = F.sum(F.length("text")) + F.count(F.lit(1)) - 1
    return pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), chars.alias("text_chars")).withColumn(
        "thin_content", F.col("text_chars") < T.MIN_USEFUL_TEXT_CHARS)


def company_excerpts(pages, key="company_key", n=None):
    """One row per page with its rank in the company; the excerpt has the whole text unless ``n`` is given."""
    return rank_in_order(pages, key, "page_pos", "page_rank").withColumn("excerpt", page_excerpt(n=n))


def first_pages(pages, k, key="company_key"):
    """Display step: the first k pages of each company in page order."""
    return top_k(pages, [key], [F.col("page_pos")], k, "page_rank").drop("page_rank")


def company_summary(pages, key="company_key", n=None):
    """Totals and the excerpts of all given pages per company, in page order, as one text.

    Nothing is left out; ``first_pages`` beforehand and ``n`` shorten it for display.  The text of a company is
    one cell: ``company_excerpts`` has the same as rows.
    """
    item = F.struct("page_pos", "url", page_excerpt(n=n).alias("excerpt"))
    gathered = pages.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("__p"))
    return company_totals(pages, key).join(gathered, key).select(
        key, "pages", "text_chars",
        F.array_join("__p.excerpt", "\n\n").alias("summary"),
        X.join_list(F.col("__p.url")).alias("source_urls"), "thin_content")


# --- reviews --------------------------------------------------------------------------
FEED_SCHEMA = (
    "feed struct<entry:array<struct<`im:name`:struct<label:string>,title:struct<label:string>,"
    "content:struct<label:string>,`im:rating`:struct<label:string>>>>"
)
FEED_SINGLE = FEED_SCHEMA.replace("entry:array<", "entry:", 1)[:-1]


def is_complaint(text, rating):
    return rating.isin("1", "2", "3") | X.has_any(F.lower(text), T.COMPLAINT_TERMS)


def format_complaint(text, rating):
    stars = F.when(rating == "", "unknown").otherwise(rating)
    return F.concat(F.lit("Apple review ("), stars, F.lit(" stars): "), text)


def feed_complaints(feeds, key="app_key", feed="feed_json"):
    """All complaints of each review feed with their position, from the feed document itself."""
    many = F.from_json(feed, FEED_SCHEMA)["feed"]["entry"]
    one = F.from_json(feed, FEED_SINGLE)["feed"]["entry"]
    entries = F.coalesce(many, F.when(one.isNotNull(), F.array(one)))
    rows = feeds.select(key, F.posexplode(entries).alias("pos", "e"))
    rows = rows.filter(F.col("e").isNotNull() & F.col("e.`im:name`").isNull())
    joined = F.concat(X.text("e.title.label"), F.lit(": "), X.text("e.content.label"))
    rows = rows.select(
        key, "pos",
        F.trim(joined, F.lit(": ")).alias("text"),
        X.text("e.`im:rating`.label").alias("rating"),
    )
    rows = rows.filter((F.col("text") != "") & is_complaint(F.col("text"), F.col("rating")))
    return rows.withColumn("complaint", format_complaint(F.col("text"), F.col("rating")))


def review_themes(complaints, key="app_key", text="complaint", pos="pos"):
    """Counts of all themes with the first example, ranked by count within each app.

    Themes are matched row by row, so a complaint never meets the term list in a join.
    """
    low = F.lower(text)
    matched = X.flags(*[(X.has_any(low, terms), name) for name, terms in T.REVIEW_THEMES.items()])
    rows = complaints.select(key, F.col(pos).alias("__pos"), F.col(text).alias("__ex"), F.explode(matched).alias("theme"))
    counts = rows.groupBy(key, "theme").agg(
        F.count(F.lit(1)).alias("signals"), F.min_by("__ex", "__pos").alias("example"))
    # a row per theme: no more rows per app than the list has themes
    ranked = top_k(counts, [key], [F.desc("signals"), F.col("theme")], len(T.REVIEW_THEMES), "theme_rank")
    return ranked.withColumn("theme_text", F.concat(
        "theme", F.lit(": "), F.col("signals"), F.lit(" public review signal(s), e.g. "), "example"))


# --- page metrics ---------------------------------------------------------------------
METRICS_SCHEMA = (
    "viewportHeight double, bodyTextLength double, horizontalOverflowPx double, "
    "offscreenElementCount double, maxRightOverflowPx double, ctaCount double, "
    "ctaAboveFoldCount double, hiddenSignupLoginCount double, smallTapTargetCount double, "
    "primaryCta struct<text:string,top:double,contrastRatio:double,backgroundReliable:boolean>"
)
VISUAL_FLAGS = [
    "visual_horizontal_overflow", "visual_no_clear_cta", "visual_no_cta_above_fold",
    "visual_low_contrast_cta", "visual_primary_cta_below_fold", "visual_signup_login_below_fold",
    "visual_small_mobile_tap_targets", "visual_too_many_ctas_above_fold",
]


def _one_digit(x):
    # exact quarter values round to the even digit, everything else to the nearest
    tie = x * 4 == F.floor(x * 4)
    return F.format_string("%.1f", F.when(tie, F.bround(x, 1)).otherwise(x))


def visual_observations(rows, metrics="metrics", viewport="viewport"):
    """Observations, flags, reasons and scores of one page in one viewport.

    Text slots of the same rule line up across the arrays: a rule that only explains why a
    weak signal was ignored adds a reason but no flag.  Metrics are JSON text, or a struct of these fields.
    """
    is_text = dict(rows.dtypes).get(metrics) == "string"
    df = rows.withColumn("m", F.from_json(metrics, METRICS_SCHEMA) if is_text else F.col(metrics))

    def num(name):
        return F.coalesce(F.col(f"m.{name}"), F.lit(0.0))

    def whole(name):
        return num(name).cast("bigint")

    df = df.withColumns({
        "_over": num("horizontalOverflowPx"), "_off": whole("offscreenElementCount"),
        "_right": num("maxRightOverflowPx"), "_cta": whole("ctaCount"),
        "_above": whole("ctaAboveFoldCount"), "_hidden": whole("hiddenSignupLoginCount"),
        "_tap": whole("smallTapTargetCount"), "_chars": whole("bodyTextLength"),
        "_ptext": X.clean("m.primaryCta.text"), "_contrast": num("primaryCta.contrastRatio"),
        "_top": num("primaryCta.top"), "_height": num("viewportHeight"),
        "_sure": F.coalesce("m.primaryCta.backgroundReliable", F.lit(False)),
    }).drop("m")
    c = F.col
    wide = c("_over") > 32
    overflow = wide & ((c("_off") > 0) | (c("_right") > 24))
    no_cta, rich = c("_cta") == 0, c("_chars") > 500
    low_down = c("_top") > c("_height") * 1.05
    no_fold = ~no_cta & (c("_above") == 0) & low_down
    dim = (c("_ptext") != "") & (c("_contrast") > 0) & (c("_contrast") < 3)
    low_contrast = dim & c("_sure")
    below = (c("_ptext") != "") & low_down
    hidden = c("_hidden") != 0
    taps = (c(viewport) == "mobile") & (c("_tap") >= 2)
    crowded = c("_above") > 6
    px, contrast = c("_over").cast("bigint").cast("string"), _one_digit(c("_contrast"))
    vp = c(viewport)

    shown = {
        "px": px, "off": c("_off"), "cta": c("_ptext"), "contrast": contrast, "hidden": c("_hidden"), "taps": c("_tap"), "above": c("_above")}

    def say(cond, sentence):
        return F.when(cond, F.concat(vp, F.lit(": "), X.filled(sentence, shown)))

    names = ["overflow", "no_cta", "no_fold", "low_contrast", "below", "hidden", "taps", "crowded"]
    rules = [overflow, no_cta & rich, no_fold, low_contrast, below, hidden, taps, crowded]
    scores = [
        F.when((c("_off") >= 2) | (c("_right") > 64), 90).otherwise(82), F.lit(62), F.lit(72),
        F.when(c("_contrast") < 2.5, 72).otherwise(60), F.lit(72), F.lit(68), F.lit(48), F.lit(62),
    ]
    quiet = ~X.any_of(rules) & (c("_ptext") != "")
    notes = [say(rule, T.VISUAL_NOTES[name]) for name, rule in zip([*names, "quiet"], [*rules, quiet])]
    # a weak signal is explained although it raises no flag
    explained = {
        **dict(zip(names, rules)), "weak_overflow": wide & ~overflow, "weak_cta": no_cta & ~rich, "weak_contrast": dim & ~c("_sure")}
    reasons = [say(explained[name], sentence) for name, sentence in T.VISUAL_REASONS.items()]
    best = F.greatest(*[F.when(r, s).otherwise(0) for r, s in zip(rules, scores)])
    # sentences are no part of one generated method with everything else, which would be too long to be compiled
    out = df.withColumns({
        "observations": F.array_compact(F.array(*notes)),
        "visual_quality_flags": X.flags(*zip(rules, VISUAL_FLAGS)),
        "confidence_reasons": F.array_compact(F.array(*reasons)),
        "viewport_score": best,
    })
    return out.drop(*[n for n in out.columns if n.startswith("_")])


def confidence_label(score, failed=None):
    label = (
        F.when(score >= 80, "high").when(score >= 60, "medium").when(score > 0, "low").otherwise("none")
    )
    return label if failed is None else F.when(failed & (score <= 0), "failed").otherwise(label)


def merge_viewports(observed, key="page_key", viewport="viewport"):
    """One row per page: best score, label and the distinct flags in first-seen order.

    Flags and scores are conditional min/max aggregates, so any number of rows per page is
    combined before the shuffle.
    """
    order = F.when(F.col(viewport) == "desktop", 0).otherwise(1) * 10
    firsts = [
        F.min(F.when(F.array_contains("visual_quality_flags", f), order + i)).alias(f"__f{i}")
        for i, f in enumerate(VISUAL_FLAGS)
    ]
    agg = observed.groupBy(key).agg(F.max("viewport_score").alias("visual_confidence_score"), *firsts)
    ordered = F.array_sort(F.array_compact(F.array(*[
        F.when(F.col(f"__f{i}").isNotNull(), F.struct(F.col(f"__f{i}").alias("p"), F.lit(f).alias("f")))
        for i, f in enumerate(VISUAL_FLAGS)
    ])))
    return agg.select(
        key, "visual_confidence_score",
        confidence_label(F.col("visual_confidence_score")).alias("visual_confidence"),
        F.transform(ordered, lambda x: x["f"]).alias("visual_quality_flags"),
    )


def element_findings(rows, label="viewport"):
    """Four element-level findings of a rendered page."""
    say = lambda text: F.concat(F.col(label), F.lit(": " + text))
    first = F.col("first_cta_width").isNotNull()
    return rows.withColumn("findings", X.array_of(
        F.when(F.col("horizontal_overflow") > 32, say("page has visible horizontal overflow, possible broken formatting on this viewport.")),
        F.when((F.col("cta_count") > 0) & (F.col("cta_above_fold") == 0), say("CTA exists but no CTA appears above the fold, possible conversion friction.")),
        F.when((F.col("cta_count") == 0) & (F.col("page_text") > 500), say("content-rich page with no CTA-like action detected.")),
        F.when(first & ((F.col("first_cta_width") < 44) | (F.col("first_cta_height") < 36)),
               say("first CTA-like element looks small for touch interaction, use as manual-review signal.")),
    ))


AXE_SCHEMA = "violations array<struct<impact:string,id:string,help:string,nodes:array<string>>>"


def axe_findings(rows, report="report_json", key="page_key", label="viewport"):
    """All critical, serious or listed violations."""
    parsed = rows.select(key, label, F.posexplode(F.from_json(report, AXE_SCHEMA)["violations"]).alias("pos", "v"))
    parsed = parsed.select(
        key, label, "pos",
        X.first_present("v.impact", F.lit("unknown")).alias("impact"),
        X.first_present("v.id", F.lit("axe")).alias("rule"),
        F.coalesce(F.size("v.nodes"), F.lit(0)).alias("nodes"),
        F.col("v.help").alias("help"),
    )
    keep = F.col("impact").isin("critical", "serious") | F.col("rule").isin(T.AXE_RULES)
    return parsed.filter(keep).select(
        key, label, "pos", F.concat(F.lit("axe_"), "rule").alias("flag"),
        F.concat(label, F.lit(": axe-core "), "impact", F.lit(" issue, "), X.first_present("help", "rule"),
                 F.lit(" ("), F.greatest(F.col("nodes"), F.lit(0)), F.lit(" node(s)).")).alias("finding"))


AUDIT_SCHEMA = (
    "categories map<string,struct<score:double>>, audits map<string,struct<score:double,title:string>>"
)
_CATEGORIES = ["performance", "accessibility", "best-practices", "seo"]


def audit_findings(rows, report="report_json", key="page_key"):
    """Category scores below 70 and listed audits with score zero."""
    r = rows.withColumn("r", F.from_json(report, AUDIT_SCHEMA))
    pairs = []
    for i, name in enumerate(_CATEGORIES):
        pct = F.bround(F.col("r.categories")[name]["score"] * 100, 0).cast("int")
        low = pct.isNotNull() & (pct < 70) if name in ("accessibility", "performance") else F.lit(False)
        pairs.append(F.when(pct.isNotNull(), F.struct(
            F.lit(i).alias("pos"), F.when(low, F.lit(f"lighthouse_low_{name}")).otherwise("").alias("flag"),
            F.concat(F.lit(f"Lighthouse mobile {name} score: "), pct, F.lit("/100.")).alias("finding"))))
    for i, audit in enumerate(T.LIGHTHOUSE_AUDITS):
        a = F.col("r.audits")[audit]
        title = F.coalesce(a["title"], F.lit(audit))
        pairs.append(F.when(a["score"] == 0, F.struct(
            F.lit(10 + i).alias("pos"), F.lit(f"lighthouse_{audit}").alias("flag"),
            F.concat(F.lit("Lighthouse issue: "), title, F.lit(".")).alias("finding"))))
    return r.select(key, F.explode(F.array_compact(F.array(*pairs))).alias("f")).select(key, "f.*")


def failed_links(checks):
    """All checked links that failed or could not be reached."""
    label = F.concat(F.lit(" ("), "label", F.lit(")"))
    note = F.when(F.col("status").isNull(), F.concat(F.lit("dead_link_check_failed: "), "link_url", label)).otherwise(
        F.concat(F.lit("dead_link_candidate: "), F.col("status"), F.lit(" "), F.col("link_url"), label))
    return checks.filter(F.col("status").isNull() | (F.col("status") >= 400)).withColumn("note", note)


def failed_responses(checks):
    """All failed network responses of a page load."""
    return checks.filter(F.col("status") >= 400).withColumn(
        "note", F.concat(F.col("status"), F.lit(" "), F.col("link_url")))


def merge_detectors(findings, key="page_key", columns=("flag", "finding")):
    """Distinct non-blank detector values per company in first-seen order, as rows.

    The values stay rows, so a company with very many findings is never gathered whole.
    """
    long = findings.select(
        key, "pos",
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("kind"), X.text(c).alias("value")) for c in columns
        ])).alias("x"),
    ).select(key, "pos", "x.*").filter(X.clean("value") != "")
    return long.groupBy(key, "kind", "value").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("times"))


def deep_links(store_links, store_pages, n=None):
    """One row per store link: its rank, whether its page is stored, and the excerpt with the whole text or n characters."""
    pages = store_pages.select(F.col("url").alias("link_url"), "title", "text")
    return lookup_join(store_links, pages, ["link_url"]).withColumns({
        "found": F.col("text").isNotNull(), "excerpt": page_excerpt("link_url", "title", "text", n, False)}).drop("title", "text")


def deep_complaints(complaints, key="page_id", shown=None):
    """One row per complaint with its rank in the company; all of them, or the first ``shown``."""
    if shown is None:
        return rank_in_order(complaints, key, "pos", "complaint_rank")
    return top_k(complaints, [key], [F.col("pos")], shown, "complaint_rank")


def deep_research(leads, store_links, store_pages, complaints, themes, key="page_id", shown=None, n=None):
    """Per company: best app link, store page texts, complaints, all themes and notes.

    Texts and complaints are whole; ``n`` characters of a page and ``shown`` complaints are limits for display.
    ``deep_links`` and ``deep_complaints`` hold the same as rows.
    """
    joined = deep_links(store_links, store_pages, n)
    item = F.struct("rank", "link_url", "found", "excerpt")
    links = joined.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("l"))
    links = links.select(
        key, F.element_at("l", 1)["link_url"].alias("app_store_url"),
        F.filter("l", lambda x: x["found"]).alias("hit"), F.filter("l", lambda x: ~x["found"]).alias("miss"))
    talk = deep_complaints(complaints, key, shown).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("complaint_rank", "complaint"))).alias("c"))
    theme = themes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("theme_rank", "theme_text"))).alias("t"))
    out = leads.join(links, key, "left").join(talk, key, "left").join(theme, key, "left")
    bullet = lambda arr: F.concat(F.lit("- "), F.array_join(arr, "\n- "))
    summary = F.concat_ws(
        "\n\n",
        F.nullif(F.array_join("hit.excerpt", "\n\n"), F.lit("")),
        F.when(F.col("c").isNotNull(), F.concat(F.lit("Public review complaint signals:\n"), bullet(F.col("c.complaint")))),
        F.when(F.col("t").isNotNull(), F.concat(F.lit("Public review theme clusters:\n"), bullet(F.col("t.theme_text")))),
    )
    missing = F.transform("miss", lambda x: F.concat(F.lit("Could not fetch public app-store page: "), x["link_url"]))
    return out.withColumns({
        "app_store_summary": summary,
        "app_review_themes": X.text(X.join_list(F.col("t.theme_text"))),
        "app_review_complaints": X.text(X.join_list(F.col("c.complaint"))),
        "deep_source_urls": X.text(X.join_list(F.col("hit.link_url"))),
        "deep_notes": X.text(X.join_list(missing)),
    }).drop("hit", "miss", "c", "t")
