"""Redaction and its ledger, change logs, partition merges, baselines, rescored edits, draws and JSON against plain Python."""

import datetime
import json
import os
import random
import re
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgate.functions import html, redact
from quillgate.functions import json as J
from quillgate.operators import evals, experiments, feedback, gates
from quillgate.plans import catalog
from quillgate.sources import files, tables
from quillgate.streaming import ingest

# the same classes as plain regular expressions
PLAIN = [
    ("local_windows_path", r"[A-Za-z]:\\Users\\[^|;\n\r\t]+", re.I, "[redacted]"),
    ("local_unix_user_path", r"/Users/[^|;\n\r\t]+|/home/[^|;\n\r\t]+", re.I, "[redacted]"),
    ("email_address", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", re.I, "[redacted email]"),
    ("phone_number", r"(?<!\w)(?:\+?\d[\d\s().-]{7,}\d)(?!\w)", 0, "[redacted]"),
    ("api_key_like", r"\b(?:sk-[A-Za-z0-9_-]{16,}|AIza[0-9A-Za-z_-]{20,}|[A-Za-z0-9_-]{32,})\b", 0, "[redacted]"),
    ("secret_query_parameter",
     r"([?&](?:api[_-]?key|key|token|access[_-]?token|auth|authorization|signature|sig|secret|expires|x-amz-[^=\s&|]+)=)[^&\s|]+",
     re.I, r"\1[redacted]"),
]
TRACE = ("trace_file", r"\.trace\.zip\b|trace_[^|;\n\r\t]+\.zip\b|\.zip\b", re.I)


def plain_sanitize(text):
    flags = []
    for name, pattern, how, by in PLAIN:
        if re.search(pattern, text, how):
            flags.append(name)
            text = re.sub(pattern, by, text, flags=how)
    return text, sorted(flags)


def plain_spans(text):
    return [(name, m.start() + 1, m.end() - m.start()) for name, pattern, how in [*[(n, p, h) for n, p, h, _ in PLAIN], TRACE]
            for m in re.finditer(pattern, text, how)]


def sensitive_texts():
    rng = random.Random(4)
    parts = [
        "é", "-", "--", " ", " ", ";", "|", "\n", ".", "+", "(", ")", "_", "²", "٣", "ab", "Zz9", "x.y", "@", "me@x.example", ".a+b@c-d.co", "n@ïve.org",
        "+31 20 123 45 67", "1234567890", "12.34-56 78)90", "sk-", "AIza", "a" * 16, "B_" * 10, "0-" * 18, "C:\\Users\\ava\\x", "/home/ava", "/Users/b c",
        "?token=", "&sig=1", "?x=1&Api-Key=q", "x-amz-date=2", ".zip", "trace_1", ".trace.zip", "run.ZIP", "\u00a0", "\u2003", "中文", "[redacted]"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += ["", "a@b.co;c@d.co;e@f.co", "1234567890;+1234567890;(12) 3456789012", "x" * 40 + " " + "y" * 40, "éab.cd@x.com", "--" + "k" * 40 + "-é"]
    return texts


def test_redaction_and_ledger_equal_plain_regex(spark):
    texts = sensitive_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)
    out = {r.i: (r.r, r.f) for r in redact.sanitize_columns(df, "t", "r", "f").collect()}
    want = [plain_sanitize(t) for t in texts]
    assert all(out[i] == want[i] for i in range(len(texts))), [(texts[i], out[i], want[i]) for i in out if out[i] != want[i]][:3]
    column = {r.i: (r.s[0], r.s[1]) for r in df.select("i", F.struct(*[c.alias(n) for c, n in zip(redact.sanitize(F.col("t")), "rf")]).alias("s")).collect()}
    assert column == out
    spans = {}
    for r in redact.span_rows(df, "i", "t").collect():
        spans.setdefault(r.i, []).append((r["class"], r.start, r.length))
    for i, t in enumerate(texts):
        assert sorted(spans.get(i, [])) == sorted(plain_spans(t)), t
    scans = {r.i: r.f for r in df.select("i", redact.scan("t", ignore_redacted=False).alias("f")).collect()}
    assert scans == {i: sorted({n for n, _, _ in spans.get(i, [])}) for i in range(len(texts))}


def test_merged_spans_are_the_covered_places(spark):
    texts = sensitive_texts()[:400]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {}
    for r in redact.merged_spans(redact.span_rows(df, "i", "t"), "i").collect():
        got.setdefault(r.i, []).append((r.start, r.length, tuple(r.classes)))
    for i, t in enumerate(texts):
        spans, want = sorted(plain_spans(t), key=lambda s: (s[1], s[2], s[0])), []
        for name, start, length in spans:
            if want and start < want[-1][0] + want[-1][1]:
                first, size, names = want[-1]
                want[-1] = (first, max(size, start + length - first), names | {name})
            else:
                want.append((start, length, {name}))
        assert sorted(got.get(i, [])) == [(a, b, tuple(sorted(c))) for a, b, c in want], t


def test_redaction_equals_its_sql_form():
    con = duckdb.connect()
    con.execute("create table texts (i bigint, x varchar)")
    texts = sensitive_texts()
    con.executemany("insert into texts values (?, ?)", list(enumerate(texts)))
    rows = con.execute("with " + redact.sanitize_sql("texts", "x") + " select i, x, found from redacted order by i").fetchall()
    assert [(x, f) for _, x, f in rows] == [plain_sanitize(t) for t in texts]
    found = {}
    for i, name, start, length in con.execute(redact.span_rows_sql("texts", "i", "x")).fetchall():
        found.setdefault(i, []).append((name, start, length))
    assert all(sorted(found.get(i, [])) == sorted(plain_spans(t)) for i, t in enumerate(texts))


# ---- change logs


SENDS = [("r", str(i), f"ex{i}" if i % 2 else "", False, False, None) for i in range(6)]
RESULTS = [
    [("r", "0", "", True, None, "2024-01-01"), ("r", "", "ex1", None, True, "2024-01-02"), ("r", "", "none", True, True, "2024-01-02")],
    [("r", "0", "", False, True, "2024-01-03"), ("r", "1", "", True, None, "2024-01-01"), ("r", "2", "", True, None, None)],
    [("r", "0", "", True, False, "2024-01-02"), ("r", "2", "", False, None, "2024-01-01")],
    [("r", "", "ex3", True, True, "2024-02-01")],
]


def _batch(spark, rows):
    full = [(a, b, c, o, g, None, None, None, None, None, at) for a, b, c, o, g, at in rows]
    from quillgate import schemas
    return spark.createDataFrame(full, schemas.SEND_RESULTS)


def _state(df):
    return sorted((r.run_id, r.row_id, r.was_opened, r.got_reply, r.was_updated) for r in df.collect())


def test_snapshots_between_batches_and_retries_change_nothing(spark, tmp_path):
    log, base = str(tmp_path / "log"), str(tmp_path / "base")
    sends = spark.createDataFrame(SENDS, "run_id string, row_id string, example_id string, was_opened boolean, got_reply boolean, reply_text string")
    whole = feedback.ingest_results(sends, _batch(spark, [r for b in RESULTS for r in b]))
    assert ingest.compact_sends(spark, log, base) is None
    for i, rows in enumerate(RESULTS):
        tables.write_change(_batch(spark, rows), log, i)
        if i in (1, 2):
            assert ingest.compact_sends(spark, log, base) == i
            assert ingest.compact_sends(spark, log, base) == i  # nothing new
            tables.write_change(_batch(spark, rows), log, i)  # a retry of a batch that the snapshot contains
    assert _state(ingest.current_sends(sends, spark, log, base)) == _state(ingest.current_sends(sends, spark, log)) == _state(whole)
    # a half-written snapshot is not read
    os.makedirs(f"{base}/through=3")
    assert _state(ingest.current_sends(sends, spark, log, base)) == _state(whole)


def test_old_batches_cost_nothing_and_can_be_dropped(spark, tmp_path):
    log, base = str(tmp_path / "log"), str(tmp_path / "base")
    sends = spark.createDataFrame(SENDS, "run_id string, row_id string, example_id string, was_opened boolean, got_reply boolean, reply_text string")
    for i, rows in enumerate(RESULTS[:3]):
        tables.write_change(_batch(spark, rows), log, i)
        ingest.compact_sends(spark, log, base)
    tables.write_change(_batch(spark, RESULTS[3]), log, 3)
    want = _state(ingest.current_sends(sends, spark, log))
    read = [f for f in ingest.current_sends(sends, spark, log, base).inputFiles() if "batch_id=" in f]
    assert read and all("batch_id=3" in f for f in read)
    assert tables.trim_log(spark, log, base) > 0
    assert sorted(n for n in os.listdir(log) if n.startswith("batch_id=")) == ["batch_id=2", "batch_id=3"]
    assert _state(ingest.current_sends(sends, spark, log, base)) == want
    assert tables.trim_log(spark, log, base) == 0


def test_experiment_snapshots(spark, tmp_path):
    log, base = str(tmp_path / "log"), str(tmp_path / "base")
    from quillgate import schemas
    rng = random.Random(1)
    rows = [[("x", rng.choice("ab"), str(rng.randint(0, 9)), True, rng.random() < 0.5, rng.random() < 0.3, f"2024-01-0{rng.randint(1, 9)}") for _ in range(20)] for _ in range(4)]
    for i, part in enumerate(rows):
        tables.write_change(spark.createDataFrame(part, schemas.EXPERIMENT_RESULTS).dropDuplicates(["variant_id", "lead_id"]), log, i)
        if i == 2:
            assert ingest.compact_experiment_results(spark, log, base) == 2
    a, b = (sorted(map(tuple, ingest.current_experiment_results(spark, log, p).collect())) for p in (base, None))
    assert a == b and ingest.experiment_report(spark, log, 1, base).collect() == ingest.experiment_report(spark, log, 1).collect()


# ---- partition merges


def _stamps(root):
    return {d: sorted((f, os.stat(os.path.join(root, d, f)).st_mtime_ns) for f in os.listdir(os.path.join(root, d))) for d in os.listdir(root) if "=" in d}


def test_results_are_recorded_by_partition(spark, tmp_path):
    root = str(tmp_path / "results")
    schema = "experiment_id string, variant_id string, lead_id string, converted boolean, recorded_at string"
    first = spark.createDataFrame([("e1", "a", "1", False, "1"), ("e1", "a", "2", True, "1"), ("e2", "a", "1", False, "1"), ("e1", "a", "1", True, "2")], schema)
    assert files.record_experiment_results(spark, root, first) == ["e1", "e2"]
    before = _stamps(root)
    again = spark.createDataFrame([("e1", "a", "2", False, "3"), ("e1", "b", "9", True, "3")], schema)
    for _ in range(2):  # a repeat changes nothing
        assert files.record_experiment_results(spark, root, again) == ["e1"]
        got = sorted((r.experiment_id, r.variant_id, r.lead_id, r.converted, r.recorded_at) for r in spark.read.parquet(root).collect())
        assert got == [("e1", "a", "1", True, "2"), ("e1", "a", "2", False, "3"), ("e1", "b", "9", True, "3"), ("e2", "a", "1", False, "1")]
    after = _stamps(root)
    assert after["experiment_id=e2"] == before["experiment_id=e2"] and after["experiment_id=e1"] != before["experiment_id=e1"]


def test_campaign_results_are_appended_by_bucket(spark, tmp_path):
    root = str(tmp_path / "campaign")
    rows = lambda values: evals.normalize_campaign(spark.createDataFrame(
        values, "campaign_name string, company string, person string, delivered_line string, replied string"), "2024-01-01")
    files.append_campaign(spark, root, rows([("c", f"co{i}", "p", "l", "yes") for i in range(40)] + [("c", "none", "p", "l", "")]), buckets=8)
    before = _stamps(root)
    touched = files.append_campaign(spark, root, rows([("c", "co3", "p", "l", "no"), ("c", "new", "p", "l", "yes")]), buckets=8)
    got = {r.company: r.replied for r in files.load_campaign(spark, root).collect()}
    assert len(got) == 41 and got["co3"] == "no" and got["new"] == "yes" and "none" not in got
    after = _stamps(root)
    assert len(touched) <= 2 and all(after[d] == before[d] for d in before if d not in {f"bucket={b}" for b in touched})


def test_goldset_rows_are_appended_by_split(spark, tmp_path):
    root = str(tmp_path / "gold")
    rows = lambda values: spark.createDataFrame(values, "goldset_split string, example_id string, created_at string, source_kind string, human_decision string")
    files.append_goldset(spark, root, rows([("frozen_eval_set", "1", "1", "operator_review", "send"), ("reviewed_examples", "1", "1", "client_feedback", "edit")]))
    files.append_goldset(spark, root, rows([("reviewed_examples", "1", "2", "client_feedback", "send"), ("reviewed_examples", "2", "2", "operator_review", "edit")]))
    got = sorted((r.goldset_split, r.example_id, r.human_decision) for r in files.read_goldset(spark, root).collect())
    assert got == [("frozen_eval_set", "1", "send"), ("reviewed_examples", "1", "send"), ("reviewed_examples", "2", "edit")]
    with pytest.raises(ValueError):
        files.append_goldset(spark, root, rows([("frozen_eval_set", "3", "3", "client_feedback", "send")]))


# ---- baselines and edits


def test_latest_baseline_before_a_run(spark):
    rng = random.Random(8)
    day = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i)
    history = [(m, float(rng.randint(0, 99)), day(rng.randint(0, 60))) for m in "ab" for _ in range(12)]
    history = list({(m, at): (m, v, at) for m, v, at in history}.values()) + [("a", None, day(5))]
    runs = [(f"r{i}", m, float(i), day(rng.randint(0, 60))) for i in range(40) for m in "abc"]
    got = evals.baseline_before(
        spark.createDataFrame(runs, "run_id string, metric string, value double, evaluated_at timestamp"),
        spark.createDataFrame(history, "metric string, value double, created_at timestamp"))
    found = {(r.run_id, r.metric): r.baseline_value for r in got.collect()}
    for run, metric, _, at in runs:
        seen = [(t, v is not None, v) for m, v, t in history if m == metric and t < at]
        assert found[run, metric] == (max(seen)[2] if seen else None)
    assert len(found) == len(runs)


def test_edited_rows_alone_are_judged_again(spark, sf_dir):
    rows = catalog.QUERIES["rescored_metrics"](spark, sf_dir)
    got = {r.metric: r.value for r in rows.collect()}
    from quillgate.plans import views
    lines = views.lines(spark, sf_dir)
    edited = lines.withColumn("personalized_line", F.when(F.col("human_decision") == "edit", F.col("edited_line")).otherwise(F.col("personalized_line")))
    assert got == {r.metric: r.value for r in evals.metrics(gates.apply_sendability(edited)).collect()}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    scans = len(re.findall(r"Relation \[doc_id", plan))
    judged = evals.metrics(gates.apply_sendability(edited))._jdf.queryExecution().optimizedPlan().toString()
    # the stored verdicts take the place of the gate over all rows: its marks appear once, over the edited rows
    assert plan.count("inline(") == judged.count("inline(") and scans >= 1


def test_regression_rules_are_per_run(spark):
    rows = spark.createDataFrame([(1, "frozen_eval_rows", 5.0), (1, "false_send_rows", 1.0), (1, "reject_recall_pct", 50.0),
                                  (2, "frozen_eval_rows", 5.0), (2, "false_send_rows", 0.0), (2, "reject_recall_pct", 50.0)], "run int, metric string, value double")
    base = spark.createDataFrame([(1, "false_send_rows", 0.0), (1, "reject_recall_pct", 60.0)], "run int, metric string, value double")
    got = {(r.run, r.metric, r.rule) for r in evals.release_gate(rows, baseline=base, keys=["run"]).collect() if r.rule == "no_regression"}
    assert got == {(1, "false_send_rows", "no_regression"), (1, "reject_recall_pct", "no_regression")}


# ---- draws, JSON, pages


def test_draws_follow_their_distribution(spark):
    leads = spark.range(4000).select(F.lit("e").alias("experiment_id"), F.col("id").cast("string").alias("lead_id"))
    for a, b in [(1.0, 1.0), (3.0, 40.0), (500.0, 20.0), (2e6, 1e6)]:
        draws = [r.d for r in leads.select(experiments.beta_draw(F.lit(a), F.lit(b), F.lit("e"), F.col("lead_id"), F.lit("v")).alias("d")).collect()]
        mean, variance = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
        assert all(0 < d < 1 for d in draws) and len(set(draws)) > 3990
        assert abs(statistics.fmean(draws) - mean) < 5 * (variance / 4000) ** 0.5
        assert abs(statistics.pvariance(draws) / variance - 1) < 0.12


def test_assignments_run_without_python(spark, sf_dir):
    for name in ("ab_thompson", "ab_fixed", "ab_sticky_thompson"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_json_texts_equal_the_standard_library(spark):
    texts = ["", 'a"b\\c', "line\nend\r\t\b\f", "\x01\x1f\x7f", "é中\U0001F600", "mixed é \x02 \"q\" 😀😀", None]
    rows = [(t, [x for x in texts[:i] if x is not None], i - 3, i % 2 == 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "t string, l array<string>, n int, b boolean")
    for ascii_only in (True, False):
        for ordered in (True, False):
            made = J.json_object({"z": J.quoted("t", ascii_only), "list": J.text_list("l", ascii_only), "n": J.number("n"), "b": J.truth("b")}, sort=ordered)
            got = [r.j for r in df.select(made.alias("j")).collect()]
            want = [json.dumps({"z": t or "", "list": l, "n": n, "b": b}, ensure_ascii=ascii_only, sort_keys=ordered) for t, l, n, b in rows]
            assert got == want


def test_tags_end_outside_of_quotes(spark):
    pages = [
        ("<p title=\"a>b't\">one</p><img alt='x>y'>two", "one two"), ("<div data-x='\">'>t &#39;q&#x27; &#233;</div>", "t 'q' é"),
        ("<script a=\">\">no</script>yes &amp;#39;", "yes &#39;"), ("<p " + "a=1 " * 20000 + "b='>'>long</p>", "long"), ("a < b > c &#0; &#xD800;", "a < b > c &#0; &#xD800;")]
    df = spark.createDataFrame(pages, "h string, w string")
    got = df.select(html.visible_text(F.col("h")).alias("t"), "w").collect()
    assert [r.t for r in got] == [r.w for r in got]
    con = duckdb.connect()
    con.execute("create table p (html varchar)")
    con.executemany("insert into p values (?)", [(h,) for h, _ in pages])
    assert [r[0] for r in con.execute(f"select {html.visible_sql()} from p").fetchall()] == [w for _, w in pages]
