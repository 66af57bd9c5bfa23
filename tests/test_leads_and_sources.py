import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.operators import evals, gates, leads, order, prompts
from quillgate.operators.rows import fill_down, lookup_join, merge_fields, upsert
from quillgate.sources import dims, files, tables
from quillgate.streaming import ingest


def test_client_layout(spark, tmp_path):
    path = tmp_path / "leads.csv"
    path.write_text('App Store,Company Name ,Website ,Linkedin,First Name ,Job Tile ,Email\n'
                    'https://apps.apple.com/us/app/x/id1,"Little Otter\r",littleotterhealth.com,li,Ana,Co-Founder,ana@x.example\n',
                    newline="")
    row = files.read_leads(spark, str(path)).collect()[0]
    assert (row.company_name, row.website_url, row.recipient_role) == ("Little Otter", "https://littleotterhealth.com", "Co-Founder")
    assert row.app_store_url.endswith("id1") and row.optional_notes == "ana@x.example" and row.is_valid
    assert row.original_columns["Company Name"] == "Little Otter"


def test_row_index_over_many_splits(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"p{part}.csv").write_text("company_name,website_url\n" + "".join(
            f"c{part * 500 + i},w{part * 500 + i}.example\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        from quillgate.operators.rows import with_row_index

        rows = with_row_index(spark.read.option("header", True).csv(str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.row_idx, r.company_name) for r in rows) == [(i, f"c{i}") for i in range(1500)]


def test_missing_columns_are_refused():
    with pytest.raises(ValueError):
        leads.check_layout(["Name", "Phone"])


@pytest.mark.parametrize("spread", ["dense", "sparse", "negative", "far"])
def test_running_values_over_any_numbers(spark, monkeypatch, spread):
    """Small blocks and fans, so that every level of the tree has several blocks; per key, with nulls, also over far numbers."""
    monkeypatch.setattr(order, "BLOCK_BITS", 4)
    monkeypatch.setattr(order, "FAN_BITS", 15)
    rng = random.Random(spread)
    place = {
        "dense": lambda i: i, "sparse": lambda i: i * 1_000_003 + rng.randint(0, 9), "negative": lambda i: (i - 150) * 37,
        "far": lambda i: (i - 150) * (1 << 54) + rng.randint(0, 9)}[spread]
    rows = [(place(i), rng.choice(["x", "y", "y", "y", None]), rng.choice([None, 1, 5, 0, -2]), rng.choice(["", "", "a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rng.sample(rows, 300), "row_idx long, k string, n long, v string").repartition(5)
    got = sorted(map(tuple, order.running(df, sums={"total": "n", "place": F.lit(1)}, keys=["k"]).select("row_idx", "total", "place").collect()))
    want, sums = [], {}
    for at, k, n, _ in rows:
        total, count = sums.get(k, (0, 0))
        sums[k] = (total + (n or 0), count + 1)
        want.append((at, *sums[k]))
    assert got == want
    filled, last = [], ""
    for at, _, _, v in rows:
        last = v or last
        filled.append((at, last))
    assert sorted(map(tuple, fill_down(df, ["v", "missing"]).select("row_idx", "v").collect())) == filled


def test_running_values_of_empty_tables_and_nulls(spark):
    empty = spark.createDataFrame([], "row_idx long, n long")
    assert order.running(empty, sums={"total": "n"}).collect() == []
    rows = spark.createDataFrame([(None, 4), (2, 1), (None, 3), (1, None)], "row_idx long, n long")
    got = order.running(rows, sums={"total": "n"}, lasts={"seen": "n"}).collect()
    by_row = {r.row_idx: (r.total, r.seen) for r in got if r.row_idx is not None}
    assert by_row[1][0] == 7 and by_row[1][1] in (3, 4) and by_row[2] == (8, 1)
    assert max(r.total for r in got if r.row_idx is None) == 7


def test_numbers_of_any_order_keep_that_order(spark):
    rows = [(f"{i % 7:03d}", -i, i) for i in range(200)]
    df = spark.createDataFrame(rows, "a string, b long, n long").repartition(6)
    numbered = order.numbered(df, "a", F.desc("b"))
    got = order.running(numbered, "__number", sums={"total": "n"}).orderBy("__number").collect()
    want, total = [], 0
    for a, b, n in sorted(rows, key=lambda r: (r[0], -r[1])):
        total += n
        want.append((a, b, total))
    assert [(r.a, r.b, r.total) for r in got] == want


@pytest.mark.parametrize("name", ["budget_admit", "call_limit_admit", "running_tokens", "follow_up_ids", "lead_fill_down"])
def test_no_window_spans_a_whole_order(spark, sf_dir, name):
    from quillgate.plans.catalog import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert windows and all(re.search(r"\], \[[^\]]+\], \[", line) for line in windows), windows


def test_duplicates_and_urls(spark):
    rows = [(0, "", ""), (1, "A", "www.X.example/a/?q=1"), (2, "A2", "http://x.example#z"), (3, "B", "https://"), (4, "", "https://acme-labs.io/")]
    df = spark.createDataFrame(rows, "row_idx long, company_name string, website_url string")
    out = leads.load_leads(df).orderBy("row_idx").collect()
    assert out[0].validation_errors == [T.ERR_URL_MISSING, T.ERR_COMPANY_MISSING] or out[0].validation_errors[0] == T.ERR_URL_MISSING
    assert out[1].website_url == "https://x.example/a" and out[1].is_valid
    assert out[2].is_duplicate and out[2].validation_errors == [T.ERR_DUPLICATE]


def test_hot_key_lookup(spark):
    facts = spark.range(1000).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    dim = facts.select("k").distinct().withColumn("v", F.concat(F.lit("v_"), "k"))
    out = lookup_join(facts, dim, ["k"])
    assert out.count() == 1000 and out.filter(F.col("v") != F.concat(F.lit("v_"), "k")).count() == 0


def test_upsert_and_partial_update(spark):
    old = spark.createDataFrame([("r", "1", "a", "t0"), ("r", "2", "b", "t0")], "run_id string, row_id string, v string, created_at string")
    new = spark.createDataFrame([("r", "2", "c", "t1"), ("r", "3", "d", "t1")], "run_id string, row_id string, v string, created_at string")
    out = {r.row_id: (r.v, r.created_at) for r in upsert(old, new, ["run_id", "row_id"]).collect()}
    assert out == {"1": ("a", "t0"), "2": ("c", "t0"), "3": ("d", "t1")}
    updates = spark.createDataFrame([("r", "1", None, 2), ("r", "1", "z", 1), ("r", "9", "q", 1)], "run_id string, row_id string, v string, o int")
    got = {r.row_id: (r.v, r.was_updated) for r in merge_fields(old, updates, ["run_id", "row_id"], ["v"], "o").collect()}
    assert got == {"1": ("z", True), "2": ("b", False)}


def test_budget_refuses_before_the_first_call(spark):
    df = spark.createDataFrame([(0, 10, 1), (1, 10, 1), (2, 10, 1)], "row_idx long, input_tokens long, output_tokens long")
    assert prompts.admit(df, max_calls=1).count() == 1
    assert prompts.admit(df, max_cost=1e-9).count() == 0
    assert prompts.admit(df, max_cost=1.0).count() == 3


def test_hashes_and_manifest(spark, tmp_path):
    for name in ("evidence.txt", "write.txt", "qc.txt"):
        (tmp_path / name).write_text(f"text of {name}")
    sha = lambda n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest()
    row = files.prompt_hashes(spark, str(tmp_path / "*.txt"), {
        "evidence_prompt_hash": "evidence.txt", "write_prompt_hash": "write.txt", "qc_prompt_hash": "qc.txt"}).collect()[0].asDict()
    want = {"evidence_prompt_hash": sha("evidence.txt"), "write_prompt_hash": sha("write.txt"), "qc_prompt_hash": sha("qc.txt")}
    assert row["prompt_set_hash"] == hashlib.sha256(json.dumps(want, sort_keys=True).encode()).hexdigest()
    manifest = tmp_path / "manifest.json"
    manifest.write_text(json.dumps({"name": "m", "version": 1, "description": "", "files": [
        {"path": "qc.txt", "sha256": sha("qc.txt"), "rows": 1}, {"path": "write.txt", "sha256": "0", "rows": 1}, {"path": "gone.csv", "sha256": "0", "rows": 1}]}))
    bad = {r.path: r.problem for r in files.check_manifest(spark, str(manifest), str(tmp_path / "*.txt")).collect()}
    assert bad == {"write.txt": "mismatch", "gone.csv": "missing"}


def test_goldset_partitions(spark, tmp_path, sf_dir):
    from quillgate.plans import views as V

    root = str(tmp_path / "gold")
    lines = V.lines(spark, sf_dir)
    for split in ("reviewed_examples", "candidate_training_set"):
        files.write_goldset(evals.goldset_rows(lines, split, "2024-01-01"), root)
    one = files.read_goldset(spark, root, "reviewed_examples")
    n = lines.filter("human_decision <> 'unreviewed'").count()
    assert one.count() == n and files.read_goldset(spark, root).count() == 2 * n
    again = evals.append_goldset(one, evals.goldset_rows(lines, "reviewed_examples", "2024-01-02"))
    assert again.count() == n and again.select("created_at").distinct().collect()[0][0] == "2024-01-02"
    with pytest.raises(ValueError):
        files.read_goldset(spark, root, "other")


def test_history_log_and_cache(spark, tmp_path):
    path = str(tmp_path / "history")
    for i, stamp in enumerate(["2024-01-01", "2024-01-02"]):
        tables.append_history(spark.createDataFrame([(i, f"out{i}.csv")], "rows int, output_file string"), path, stamp)
    newest = tables.load_history(spark, path, 1).collect()
    assert json.loads(newest[0].payload_json)["output_file"] == "out1.csv"
    log = tables.email_log_rows(spark.createDataFrame([("r", "1", "Acme", "hi")], "run_id string, row_id string, company_name string, opening_line string"), "t").collect()[0]
    assert (log.company, log.personalized_line, json.loads(log.payload_json)["row_id"]) == ("Acme", "hi", "1")
    cache = spark.createDataFrame([("a", 1.0, "x"), ("b", 100.0, "y"), ("c", None, "z")], "cache_key string, cached_at double, reply string")
    tables.purge_cache(cache, str(tmp_path / "cache"), 110.0, 50)
    assert sorted(r.cache_key for r in spark.read.parquet(str(tmp_path / "cache")).collect()) == ["b", "c"]
    spark.createDataFrame([("9999-01-01", "no json")], "created_at string, payload_json string").write.mode("append").parquet(path)
    assert json.loads(tables.load_history(spark, path, 1).collect()[0].payload_json)["output_file"] == "out1.csv"
    assert tables.load_history(spark, path, None).count() == 2


def test_profiles_and_workspaces(spark, tmp_path):
    (tmp_path / "casual.json").write_text(json.dumps({"description": " d ", "qc_focus": "one", "banned_phrases": ["x", " ", "y"]}))
    read = dims.read_profiles(spark, str(tmp_path / "*.json"))
    row = read.collect()[0]
    assert (row.name, row.description, row.qc_focus, row.banned_phrases) == ("casual", "d", ["one"], ["x", "y"])
    presets = read.limit(0).unionByName(spark.createDataFrame(
        [("casual", "p"), ("friction_first", "p")], "name string, description string"), allowMissingColumns=True)
    dim = dims.profile_dimension(read, presets)
    assert {r.name: r.description for r in dim.collect()} == {"casual": "d", "friction_first": "p"}
    assert [r.name for r in dims.profile_names(read, presets).collect()] == ["casual", "friction_first"]
    new = spark.createDataFrame([("", "Acme & Co", "", "", "", "", "", "", "")], "client_id string, display_name string, tone_profile string, default_campaign_context string, default_research_region string, default_export_preset string, notes string, created_at string, updated_at string")
    first = dims.save_workspaces(dims.workspace_defaults(new.limit(0)), new, "2024-01-01")
    second = dims.save_workspaces(first, new.withColumn("notes", F.lit("n")), "2024-02-01").collect()
    assert len(second) == 1 and second[0].client_id == "acme_co" and second[0].created_at == "2024-01-01" and second[0].notes == "n"


def test_sinks(spark, tmp_path, sf_dir):
    from quillgate.plans import views as V
    from quillgate.plans.gate_queries import run_rows

    files.write_review_csv(run_rows(spark, sf_dir), str(tmp_path / "review"))
    back = spark.read.option("header", True).option("sep", ";").option("multiLine", True).option("escape", '"').csv(str(tmp_path / "review"))
    assert back.count() == 200 and "input__Rank" in back.columns
    flat = files.flat_rows(run_rows(spark, sf_dir), ["row_id", "missing_one"])
    assert flat.columns == ["row_id", "missing_one", "input__Rank"]
    scored = gates.apply_sendability(V.lines(spark, sf_dir))
    files.write_eval_report(scored, str(tmp_path / "report"))
    files.write_baseline(scored, str(tmp_path / "base"), "now")
    assert files.read_baseline(spark, str(tmp_path / "base")).count() == 9
    files.write_client_safe(V.lines(spark, sf_dir), str(tmp_path / "safe"))
    assert spark.read.json(str(tmp_path / "safe/manifest")).collect()[0].status == "client_safe"


def test_streams(spark, tmp_path, sf_dir):
    from quillgate.plans import views as V

    src, log, ck = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "ck")
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps(r) for r in [
        {"run_id": "r", "row_id": "1", "was_opened": True, "reviewed_at": "2024-01-01"},
        {"run_id": "r", "row_id": "2", "converted": True, "reviewed_at": "2024-01-01"}]))
    sends = spark.createDataFrame([("r", "1", "", False, False, None, False, None, None, 0), ("r", "2", "", False, False, None, False, None, None, 0)],
                                  "run_id string, row_id string, example_id string, was_opened boolean, got_reply boolean, reply_text string, converted boolean, conversion_type string, conversion_notes string, time_to_reply_minutes int")
    ingest.stream_results(spark, str(src), log, ck, 1).awaitTermination()
    (src / "b.json").write_text(json.dumps({"run_id": "r", "row_id": "1", "got_reply": True, "time_to_reply_minutes": 12, "reviewed_at": "2024-01-02"}))
    ingest.stream_results(spark, str(src), log, ck, 1).awaitTermination()
    row = ingest.funnel(sends, spark, log).collect()[0]
    assert (row.opened, row.replied, row.converted, row.avg_reply_time_minutes) == (1, 1, 1, 12)
    src2, log2 = tmp_path / "in2", str(tmp_path / "log2")
    src2.mkdir()
    (src2 / "a.json").write_text("\n".join(json.dumps({
        "experiment_id": "e", "variant_id": v, "lead_id": str(i % 40), "was_opened": True, "got_reply": False,
        "converted": v == "b" and i % 2 == 0, "recorded_at": f"2024-01-0{1 + i // 40}"}) for v in "ab" for i in range(80)))
    ingest.stream_experiment_results(spark, str(src2), log2, str(tmp_path / "ck2")).awaitTermination()
    rep = ingest.experiment_report(spark, log2).collect()[0]
    assert (rep.total_leads, rep.status, rep.winner_variant_id) == (80, "significant", "b")


def test_results_without_a_time_are_kept(spark):
    from quillgate.operators import feedback

    sends = spark.createDataFrame([("r", "1", "", False), ("r", "2", "", False), ("r", "3", "", False)], "run_id string, row_id string, example_id string, was_opened boolean")
    results = spark.createDataFrame(
        [("r", "1", None, True, "early"), ("r", "1", "2024-01-02", None, "late"), ("r", "2", "2024-01-01", None, "a"), ("r", "2", "2024-01-01", None, "b"), ("x", "9", None, True, "")],
        "run_id string, row_id string, reviewed_at string, was_opened boolean, reply_text string")
    got = {r.row_id: (r.was_opened, r.reply_text, r.was_updated) for r in feedback.ingest_results(sends, results).collect()}
    assert got == {"1": (True, "late", True), "2": (False, "b", True), "3": (False, None, False)}


def test_admission_and_ids_with_gaps(spark):
    from quillgate.operators import prompts, rows

    calls = spark.createDataFrame([(i * 977, 1000, 1000) for i in range(9)], "row_idx long, input_tokens long, output_tokens long")
    assert [r.row_idx for r in prompts.admit(calls, max_calls=3).orderBy("row_idx").collect()] == [0, 977, 1954]
    cost = prompts.admit(calls, max_cost=0.0025).orderBy("row_idx").collect()
    assert [r.row_idx for r in cost] == [0, 977, 1954, 2931]
    main = spark.createDataFrame([("1",), ("2",)], "row_id string")
    ids = rows.append_with_ids(main, calls.select("row_idx"), "row_idx").filter("row_idx is not null").orderBy("row_idx").collect()
    assert [r.row_id for r in ids] == [str(3 + i) for i in range(9)]


def test_feedback_context_of_nothing(spark, sf_dir):
    from quillgate.operators import feedback
    from quillgate.plans import views as V

    assert feedback.feedback_context(V.sends(spark, sf_dir).limit(0)).collect()[0][0] == ""
