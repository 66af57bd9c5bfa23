from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.operators import copyguard, delivery, evals, gates
from quillgate.operators.rows import ensure_columns

LINE_A = ("I was checking the Demo app and the signup asks for an invite code before users see the "
          "first exercise, which could cost activation.")
LINE_B = ("I was checking the Proofly landing page and the case studies link out before showing customer "
          "quotes, which could hurt demo conversion.")
LINE_C = "[AI generation unavailable: no strong evidence found]"
COLUMNS = ("company person role website personalized_line model_opening_line human_decision "
           "edit_reason_category evidence_found source_urls quality_flags needs_manual_review "
           "product_surface_type surface_checked research_priority conversion_outcome "
           "visual_confidence shareable_screenshots").split()
ROWS = [
    ("Demo App", "Ava Reed", "Founder", "https://demo-app.example", LINE_A, LINE_A, "send", "good_as_is",
     "Demo App evidence: public app listing and onboarding notes say signup asks for an invite code before "
     "users can reach the first exercise.", "https://demo-app.example/app-store", "", "no", "app_first_product",
     "app onboarding", "App Store listing > screenshots > onboarding", "activation", "high", ""),
    ("Proofly", "Sam Cole", "CEO", "https://proofly.example", LINE_B, LINE_B, "edit", "proof",
     "Proofly evidence: landing page has case study links but no direct customer quote visible on the page.",
     "https://proofly.example/case-studies", "weak_evidence", "yes", "b2b_service", "landing page proof",
     "Homepage > proof > case studies", "conversion", "medium", ""),
    ("ThinSite", "Mina Vos", "Founder", "https://thinsite.example", LINE_C, LINE_C, "reject", "evidence", "",
     "https://thinsite.example"[:0], "research_only", "yes", "website_first_leadgen", "website", "Homepage",
     "conversion", "low", ""),
]


def frozen(spark):
    rows = [(i, *r) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "row_idx long, " + ", ".join(f"{c} string" for c in COLUMNS))


def test_golden_rows(spark):
    out = {r["company"]: r for r in gates.apply_sendability(evals.normalize_goldset(frozen(spark))).collect()}
    a, b, c = out["Demo App"], out["Proofly"], out["ThinSite"]
    assert (a.sendability_decision, a.sendability_score, a.sendability_reasons) == ("Send", 94, "")
    assert (b.sendability_decision, b.sendability_score) == ("Edit", 84)
    assert b.soft_edit_reasons == ("marked_for_manual_review | weak_evidence | visual_claim_without_shareable_screenshot"
                                   " | visual_claim_without_viewport_scope")
    assert (c.sendability_decision, c.sendability_score) == ("Reject", 43)
    assert c.hard_fail_reasons == "research_only | missing_evidence | no_sendable_personalized_line"
    assert c.soft_edit_reasons == "marked_for_manual_review | missing_conversational_opening | missing_line"
    assert a.sendability_dimensions == (
        "evidence=85; copy=100; outcome=100; template=100; surface=95; visual=80; viewport=80")


def test_golden_metrics_and_gate(spark):
    scored = gates.apply_sendability(evals.normalize_goldset(frozen(spark)))
    m = {r.metric: r.value for r in evals.metrics(scored).collect()}
    assert m["exact_gate_human_agreement_pct"] == m["send_precision_pct"] == m["reject_recall_pct"] == 100.0
    assert (m["false_send_rows"], m["avg_evidence_score"], m["avg_template_fit_score"]) == (0.0, 49.3, 66.7)
    assert evals.release_gate(evals.metrics(scored)).count() == 0
    base = evals.metrics(scored).withColumn("value", F.when(F.col("metric") == "reject_recall_pct", 101.0).otherwise(F.col("value")))
    broken = evals.release_gate(evals.metrics(scored), baseline=base).collect()
    assert [(r.metric, r.rule) for r in broken] == [("reject_recall_pct", "no_regression")]


def test_row_order_does_not_matter(spark, sf_dir):
    from quillgate.plans import views as V

    df = V.lines(spark, sf_dir)
    pick = ["row_idx", "sendability_decision", "sendability_reasons", "sendability_score"]
    one = gates.apply_sendability(df).select(*pick)
    two = gates.apply_sendability(df.repartition(7, "company")).select(*pick)
    assert one.exceptAll(two).count() == 0


def test_plan_has_no_python_and_no_cross_join(spark, sf_dir):
    from quillgate.plans import catalog

    for name in ["gate_sendability", "eval_metrics", "delivery_filter", "rank_facts", "funnel_totals", "lead_dedupe"]:
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan, name
    assert "WindowGroupLimit" in catalog.QUERIES["rank_facts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_delivery_has_no_secrets(spark):
    row = [(0, "Ready", "send", "Acme", "Ava", "CEO", "https://acme.example?token=abc123", "I was checking the app, activation",
            "I checked the app, activation", "mail me@acme.example or sk-abcdefghijklmnopqrstuvwx", "https://x.example?a=1&api_key=zzz", "Send")]
    df = spark.createDataFrame(row, "row_idx long, status string, human_decision string, company string, person string, role string, "
                               "website string, personalized_line string, edited_line string, evidence_found string, source_urls string, sendability_decision string")
    safe = delivery.client_safe(df).collect()[0]
    blob = " ".join(str(v) for v in safe)
    for secret in ("me@acme.example", "sk-abcdefghijklmnopqrstuvwx", "abc123", "zzz"):
        assert secret not in blob
    assert "[redacted" in blob and safe.personalized_line == "I checked the app, activation"
    assert safe.privacy_scan_flags == "api_key_like | email_address | secret_query_parameter"
    assert delivery.hard_leaks(delivery.client_safe(df)).collect()[0].leaks == []


def test_redaction_matches_plain_regex(spark):
    import re

    from quillgate.functions import redact

    texts = ["call +31 20 123 45 67 now", "é1234567890", "x 12345678901 y", "id_1234567890", "C:\\Users\\ava\\a.txt; ok",
             "/home/ava/x|y", "a" * 40, "é" + "a" * 40, "run trace_1.zip", "www.x.example/?sig=1&b=2", "naïve@x.example", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    out = redact.sanitize_columns(df, "t", "r", "f").orderBy("i").collect()
    steps = [
        ("local_windows_path", r"[A-Za-z]:\\Users\\[^|;\n\r\t]+", re.I, "[redacted]"),
        ("local_unix_user_path", r"/Users/[^|;\n\r\t]+|/home/[^|;\n\r\t]+", re.I, "[redacted]"),
        ("email_address", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", re.I, "[redacted email]"),
        ("phone_number", r"(?<!\w)(?:\+?\d[\d\s().-]{7,}\d)(?!\w)", 0, "[redacted]"),
        ("api_key_like", r"\b(?:sk-[A-Za-z0-9_-]{16,}|AIza[0-9A-Za-z_-]{20,}|[A-Za-z0-9_-]{32,})\b", 0, "[redacted]"),
    ]
    for text, row in zip(texts, out):
        want = text
        for _, pattern, how, replacement in steps:
            want = re.sub(pattern, replacement, want, flags=how)
        want = re.sub(r"([?&](?:sig)=)[^&\s|]+", r"\1[redacted]", want)
        assert row.r == want, text


def test_sending_tool(spark):
    df = spark.createDataFrame([("Acme", "Ava van Reed", "CEO", "https://a.example", "old", "send", "new")],
                               "company string, person string, role string, website string, personalized_line string, human_decision string, edited_line string")
    row = delivery.sending_tool(df, "lemlist").collect()[0]
    assert (row.firstName, row.lastName, row.icebreaker) == ("Ava", "van Reed", "new")
    assert "full_name" in delivery.sending_tool(df, "nonsense").columns


def test_review_row_keeps_three_options(spark):
    base = {"row_idx": 0, "company_name": "Acme", "recipient_name": "Ava", "website_url": "https://a.example", "opening_line": "I checked"}
    for k in (1, 2, 3):
        base |= {f"opening_line_option_{k}": f"line {k}", f"confidence_score_option_{k}": 7 + k,
                 f"quality_flags_option_{k}": "a | b", f"needs_manual_review_option_{k}": k == 2}
    df = spark.createDataFrame([base])
    row = delivery.review_rows(df).collect()[0]
    assert [row[f"option_{k}_line"] for k in (1, 2, 3)] == ["line 1", "line 2", "line 3"]
    assert [row[f"option_{k}_needs_review"] for k in (1, 2, 3)] == ["no", "yes", "no"]
    assert row.option_1_quality_flags == "a\nb" and row.option_3_qc_score == "10"


def test_review_rows_are_gated_before_they_are_shortened(spark):
    severe = " | ".join(T.SEVERE_FLAGS)
    mild = " | ".join(f"some_flag_{i}" for i in range(40))
    base = {"company_name": "Acme", "recipient_name": "Ava", "website_url": "https://a.example", "opening_line": LINE_A, "evidence_used_for_copy": LINE_A}
    df = spark.createDataFrame([{"row_idx": i, "quality_flags": f, **base} for i, f in enumerate([f"{severe} | {mild}", f"{mild} | {severe}", mild])])
    rows = {r.row_idx: r for r in delivery.review_rows(df, shortened=True).collect()}
    assert len(rows[1].quality_flags) <= 240 and T.SEVERE_FLAGS[0] not in rows[1].quality_flags
    assert rows[0].sendability_score == rows[1].sendability_score and rows[0].sendability_decision == rows[1].sendability_decision
    assert rows[2].sendability_reasons != rows[1].sendability_reasons == rows[0].sendability_reasons


def test_gate_judges_whole_texts(spark, tmp_path):
    from quillgate.plans import catalog

    text = "The signup hides the plan. " + T.SPAM_PHRASES[0] + " is the second sentence."
    spark.createDataFrame([(2, text, "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("gate_sendability", "gate_sendability_whole"):
        assert "spam_trigger_language" in catalog.QUERIES[name](spark, str(tmp_path)).collect()[0].soft_edit_reasons


def test_research_and_review_texts_are_whole(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    df = spark.createDataFrame([{
        "row_idx": 0, "company_name": "Acme", "opening_line": LINE_A, "evidence_used_for_copy": long, "reviewer_notes": long,
        "visual_quality_flags": long, "quality_flags": long, "template_preview": long, "quality_flags_option_1": long}])
    row = delivery.research_rows(df).collect()[0]
    assert row["evidence found"] == row["raw reviewer notes"] == row["visual flags"] == row["template preview"] == long
    row = delivery.research_rows(df, shortened=True).collect()[0]
    assert len(row["evidence found"]) <= 900 and len(row["raw reviewer notes"]) <= 520 and len(row["visual flags"]) <= 500
    row = delivery.review_rows(df).collect()[0]
    assert row.quality_flags == row.template_preview == row.option_1_quality_flags == row.reviewer_notes == long


def test_copy_guards(spark):
    df = spark.createDataFrame([
        ("I downloaded the acme app and ACME asks for a login", "x", ["", " Acme page "], "Acme", "https://www.acmeapp.io/x"),
    ], "opening_line string, tailored_insight string, evidence_used_for_copy array<string>, company_name string, website_url string")
    df = df.withColumn("chosen_angle", F.lit("acme"))
    row = copyguard.sanitize_draft(df).collect()[0]
    assert row.opening_line == "I opened the Acme app and Acme asks for a login"
    assert row.evidence_used_for_copy == ["Acme page"] and row.chosen_angle == "Acme"
    low = copyguard.sanitize_draft(df, lower=True).collect()[0]
    assert low.opening_line == "I opened the acme app and acme asks for a login"
    flags = copyguard.copy_flags(df.withColumn("used_text", F.lit("")), has_evidence=False).collect()[0].copy_flags
    assert flags == ["missing_evidence_used_for_copy", "download_claim", "company_name_not_lowercase",
                     "missing_conversational_template_open", "missing_specific_dropoff_hypothesis"]


def test_grounding(spark):
    df = spark.createDataFrame([
        ("The checkout hides shipping", "", "The checkout page hides shipping costs"),
        ("Totally unrelated wording here", "nothing shared anywhere", "The checkout page hides shipping costs"),
        ("anything", "", ""),
    ], "opening_line string, used_text string, evidence_text string")
    out = [r.grounding_flags for r in copyguard.grounding(df).collect()]
    assert out == [[], ["evidence_used_not_in_extracted_facts", "line_not_grounded_in_evidence"], ["missing_grounding_evidence"]]


def test_review_edits_rescore(spark):
    base = gates.apply_sendability(frozen(spark))
    edits = spark.createDataFrame([("2", "I was checking the page and the demo form is hidden, conversion suffers.")], "row_id string, personalized_line string")
    again = gates.rescore_edits(ensure_columns(base, {}), edits, ["row_id"], ["personalized_line"])
    row = {r.row_id: r for r in again.collect()}["2"]
    assert row.personalized_line.startswith("I was checking the page") and row.copy_quality_score == 100
