import math

from pyspark.sql import functions as F

from quillgate.functions.json import object_text
from quillgate.operators import evidence, experiments, sendtime, sequences, web


def test_html_parse(spark):
    pages = [
        "<html><head><title> A &amp; B </title><script>x</script></head><body><nav><a href='/about'>About <b>us</b></a></nav>"
        "<p>One<br>two<!-- no -->three</p><form>hidden</form><a name='x'>plain</a><a href=' #top '>Top</a> end</body>",
        "", None, "<p>a &lt;b&gt; &#233;&#x4e2d;&#0; &amp;lt; &copy 1 < 2</p><script>var s = '<p>no</p>';", "<a class=x href=/bare data-y=1>bare</a><style>p{}</style><a hre"]
    df = spark.createDataFrame([(i, "https://x.example/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r for r in web.parse_pages(df).collect()}
    assert got[0].title == "A & B" and got[0].text == "A & B One two three plain Top end"
    assert [tuple(x) for x in got[0].links] == [("/about", "About us"), ("#top", "Top")]
    assert got[1].text == got[2].text == "" and got[1].links == []
    assert got[3].text == "a <b> \u00e9\u4e2d&#0; &lt; \u00a9 1 < 2"
    assert got[4].text == "bare" and [tuple(x) for x in got[4].links] == [("/bare", "bare")]


def test_links_and_priority(spark):
    page = ("<a href='/about/customers'>Case studies</a><a href='news?x=1#y'>News</a><a href='https://other.example/pricing'>P</a>"
            "<a href='mailto:a@b.c'>m</a><a href='//www.x.example/pricing/'>Pricing</a><a href='/zzz'>none</a>")
    df = spark.createDataFrame([(1, "https://x.example/home/start", page)], "page_id long, url string, html string")
    links = web.page_links(web.parse_pages(df))
    got = {r.link_url for r in links.collect()}
    assert got == {"https://x.example/about/customers", "https://x.example/home/news?x=1#y", "https://other.example/pricing",
                   "https://www.x.example/pricing/", "https://x.example/zzz"}
    best = [(r.link_url, r.matches) for r in web.priority_links(links).orderBy("rank").collect()]
    assert best == [("https://x.example/about/customers", 3), ("https://x.example/home/news", 1), ("https://www.x.example/pricing", 1)]


def test_company_pages_are_whole(spark):
    rows = [(i, f"https://x.example/{i}", "x.example", i, f"t{i}", "a" * 900 + str(i)) for i in range(12)] + [
        (20 + i, f"https://y.example/{i}", "y.example", i, "", "b" * 70) for i in range(7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, company_key string, page_pos long, title string, text string")
    chars = {"x.example": sum(len(r[5]) for r in rows[:12]) + 11, "y.example": 7 * 70 + 6}
    for found in (web.company_totals(pages), web.company_summary(pages)):
        got = {r.company_key: r for r in found.collect()}
        assert {k: (r.pages, r.text_chars, r.thin_content) for k, r in got.items()} == {
            "x.example": (12, chars["x.example"], False), "y.example": (7, chars["y.example"], True)}
    summary = web.company_summary(pages).where("company_key = 'x.example'").collect()[0]
    assert summary.source_urls == " | ".join(r[1] for r in rows[:12]) and all(r[5] in summary.summary for r in rows[:12])
    got = {r.page_id: r for r in web.company_excerpts(pages).collect()}
    assert {i: r.page_rank for i, r in got.items()} == {i: pos + 1 for i, _, _, pos, _, _ in rows}
    assert all(got[r[0]].excerpt.endswith("Text: " + r[5]) for r in rows)


def test_deep_research_is_whole(spark):
    leads = spark.createDataFrame([(1,)], "page_id long")
    urls = [f"https://apps.apple.com/de/app/id{i}" for i in range(6)]
    links = spark.createDataFrame([(1, u) for u in urls], "page_id long, link_url string")
    stores = web.app_store_links(links)
    assert [r.link_url for r in stores.orderBy("rank").collect()] == urls and web.app_store_links(links, k=3).count() == 3
    pages = spark.createDataFrame([(u, "", "a" * 4000 + f" end{i}") for i, u in enumerate(urls)], "url string, title string, text string")
    talk = spark.createDataFrame([(1, i, f"complaint {i}") for i in range(9)], "page_id long, pos long, complaint string")
    themes = spark.createDataFrame([(1, 1, "theme")], "page_id long, theme_rank int, theme_text string")
    row = web.deep_research(leads, stores, pages, talk, themes).collect()[0]
    assert all(f" end{i}" in row.app_store_summary for i in range(6)) and row.deep_source_urls == " | ".join(urls)
    assert row.app_review_complaints == " | ".join(f"complaint {i}" for i in range(9))
    row = web.deep_research(leads, stores, pages, talk, themes, shown=4, n=1000).collect()[0]
    assert " end0" not in row.app_store_summary and row.app_review_complaints.endswith("complaint 3")
    topics = "".join(f"<a href='/pricing/{i}'>Pricing</a>" for i in range(8))
    page = spark.createDataFrame([(1, "https://x.example/", topics)], "page_id long, url string, html string")
    assert web.priority_links(web.page_links(web.parse_pages(page))).count() == 8


def test_themes(spark):
    rows = [("a", 1, "Apple review (1 stars): Paywall before trial"), ("a", 2, "Apple review (2 stars): login code never arrives, crash"),
            ("a", 3, "Apple review (1 stars): crash on signup")]
    df = spark.createDataFrame(rows, "app_key string, pos long, complaint string")
    out = {r.theme: r.signals for r in web.review_themes(df).collect()}
    assert out == {"bugs/crashes/stability": 2, "login/signup/access friction": 2, "pricing/paywall friction": 1}


def test_metric_rules(spark):
    metrics = ('{"horizontalOverflowPx": 40, "offscreenElementCount": 1, "maxRightOverflowPx": 70, "ctaCount": 2, "ctaAboveFoldCount": 0,'
               '"bodyTextLength": 900, "viewportHeight": 800, "primaryCta": {"text": "Go", "top": 900, "contrastRatio": 2.25, "backgroundReliable": true}}')
    df = spark.createDataFrame([("p", "desktop", metrics), ("p", "mobile", '{"ctaCount": 0, "bodyTextLength": 10, "smallTapTargetCount": 2}')],
                               "page_key string, viewport string, metrics string")
    obs = web.visual_observations(df)
    rows = {r.viewport: r for r in obs.collect()}
    assert rows["desktop"].visual_quality_flags == ["visual_horizontal_overflow", "visual_no_cta_above_fold", "visual_low_contrast_cta", "visual_primary_cta_below_fold"]
    assert rows["desktop"].viewport_score == 90 and any("2.2:1" in o for o in rows["desktop"].observations)
    assert rows["mobile"].visual_quality_flags == ["visual_small_mobile_tap_targets"] and rows["mobile"].viewport_score == 48
    merged = web.merge_viewports(obs).collect()[0]
    assert merged.visual_confidence == "high" and merged.visual_quality_flags[-1] == "visual_small_mobile_tap_targets"


def test_json_fallback(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('text {"a": {"b": 2}} tail',), ("[1]",), ("none",)], "t string")
    assert [r[0] for r in df.select(object_text("t")).collect()] == ['{"a": 1}', '{"a": {"b": 2}}', "", ""]


def test_attempts_against_brute_force(spark):
    import itertools
    import random

    rnd = random.Random(3)
    rows = [(lead, v, i + 1, rnd.randint(0, 11), rnd.random() < 0.5) for lead, v in itertools.product(range(40), (1, 2, 3)) for i in range(rnd.randint(1, 4))]
    want = {}
    for lead, v in itertools.product(range(40), (1, 2, 3)):
        best = None
        for r in [r for r in rows if r[:2] == (lead, v)]:
            if best is None or (r[4] and not best[4]) or (r[3] > best[3] and r[4] == best[4]):
                best = r
            if r[4] and r[3] >= 8:
                break
        want[(lead, v)] = best[2]
    df = spark.createDataFrame(rows, "lead_id long, variant int, iteration int, score int, passed boolean").repartition(5)
    assert {(r.lead_id, r.variant): r.iteration for r in evidence.best_attempt(df).collect()} == want


def test_sequence_stops_after_breakup(spark):
    rows = [(1, 1, "value", "CTA: x", "A long enough opening line", "b" * 40, "ok", []), (1, 2, "Breakup", "cta hidden", "short", "b" * 40, "", []),
            (1, 3, "value", "other", "A long enough opening line", "b" * 40, "ok", [])]
    df = spark.createDataFrame(rows, "lead_id long, step_number int, follow_up_type string, chosen_angle string, opening_line string, body_text string, cta_text string, evidence_used_for_copy array<string>")
    out = {r.step_number: r for r in sequences.check_steps(df).collect()}
    assert set(out) == {1, 2} and out[1].quality_score == 8.0
    assert out[2].quality_flags == ["repeated_angle", "opening_too_short"] and out[2].quality_score == 4.0


def test_send_time_defaults_without_history(spark):
    df = spark.createDataFrame([(1, "https://x.co.uk"), (2, "https://x.de"), (3, "https://x.example")], "row_idx long, website_url string")
    none = spark.createDataFrame([], "hour int, open_rate double")
    out = {r.row_idx: r for r in sendtime.advise(df, none, "2024-01-31 13:30:00").collect()}
    assert (out[1].timezone_label, str(out[1].send_at_utc), out[1].confidence) == ("Europe_London", "2024-02-01 08:00:00", 0.48)
    assert out[3].source == "regional_default" and str(out[3].send_at_utc) == "2024-02-01 14:00:00" or out[3].send_at_utc.hour == 14
    assert "Regio-standaard beste uren: [8, 9, 10]" in out[1].reasoning
    zones = spark.createDataFrame([("us-west",), ("australia",), ("nowhere",)], "r string")
    assert [r[0] for r in zones.select(sendtime.zone_label("r")).collect()] == ["US_Eastern", "US_Eastern", "generic"]
    assert [r[0] for r in zones.select(sendtime.zone_label("r", "longest")).collect()] == ["US_Pacific", "Australia_Sydney", "generic"]


def test_significance_values(spark):
    df = spark.createDataFrame([("e", "a", 100, 50, 20, 10), ("e", "b", 100, 60, 30, 25)],
                               "experiment_id string, variant_id string, total long, opened long, replied long, converted long").withColumn(
        "conversion_rate", F.col("converted").cast("double"))
    row = {r.variant_id: r for r in experiments.significance(df).collect()}["b"]
    chi2 = sum(max(abs(o - e) - 0.5, 0) ** 2 / e for o, e in [(10, 17.5), (25, 17.5), (90, 82.5), (75, 82.5)])
    assert abs(row.p_value_two_sided - math.erfc(math.sqrt(chi2 / 2))) < 1e-3 and row.significant_winner


def test_thompson_prefers_the_better_variant_and_repeats(spark):
    leads = spark.range(3000).select(F.lit("e").alias("experiment_id"), F.col("id").cast("string").alias("lead_id"))
    res = spark.createDataFrame([("e", "a", 200, 10), ("e", "b", 200, 60)], "experiment_id string, variant_id string, total long, converted long")
    first = experiments.assign_thompson(leads, res, ["a", "b"], seed=1)
    again = experiments.assign_thompson(leads.repartition(9), res, ["a", "b"], seed=1)
    assert first.select("lead_id", "variant_id").exceptAll(again.select("lead_id", "variant_id")).count() == 0
    assert first.filter("variant_id = 'b'").count() > 2900
    flat = experiments.assign_thompson(leads, res.limit(0), ["a", "b"], seed=1).filter("variant_id = 'a'").count()
    assert 1350 < flat < 1650
    shares = experiments.assign_fixed(leads, {"a": 3, "b": 1}).filter("variant_id = 'a'").count()
    assert 2150 < shares < 2350
