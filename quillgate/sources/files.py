"""Text tables, sinks, integrity checks and file hashes."""

import json

from pyspark.sql import functions as F

from quillgate import schemas
from quillgate.functions import text as X
from quillgate.operators import delivery, evals, experiments, leads
from quillgate.operators.rows import ensure_columns, with_row_index
from quillgate.sources.tables import merge_partitions, with_bucket


def read_text_table(spark, path, sep=","):
    """CSV as all-text columns with blanks for missing cells, no inference."""
    df = (
        spark.read.option("header", True).option("multiLine", True).option("sep", sep)
        .option("quote", '"').option("escape", '"').csv(path)
    )
    return df


def read_leads(spark, path, default_context="", deduplicate=True):
    """Lead file to canonical, validated lead rows in file order."""
    raw = read_text_table(spark, path)
    leads.check_layout(raw.columns)
    return leads.load_leads(with_row_index(raw).na.fill(""), default_context, deduplicate)


def read_labels(spark, path):
    return with_row_index(read_text_table(spark, path)).na.fill("")


def read_campaign(spark, path):
    return with_row_index(ensure_columns(read_text_table(spark, path), [])).na.fill("")


def read_goldset(spark, root, split=None):
    """Goldset table; a split reads only its own partition."""
    if split is not None:
        evals.check_split(split)
    df = spark.read.parquet(root)
    return df if split is None else df.filter(F.col("goldset_split") == split)


def write_goldset(rows, root):
    """Write the splits present in ``rows``; other splits on disk stay as they are."""
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("goldset_split").parquet(root)
    )


def append_goldset(spark, root, new):
    """Add goldset rows: newest row per split and example; splits without new rows stay untouched on disk.

    Rows that may not enter their split raise an error before anything is written.
    """
    refused = evals.split_guard(new)[1]
    if not refused.isEmpty():
        raise ValueError("client labels cannot enter the frozen split, and splits must be known")
    return merge_partitions(spark, root, evals.append_goldset(new.limit(0), new), "goldset_split", evals.append_goldset)


def append_campaign(spark, path, new, buckets=64):
    """Add campaign results: newest row per campaign, company, person and line; only the buckets of the new rows are rewritten."""
    rows = with_bucket(new, ["campaign_name", "company", "person", "delivered_line"], buckets)
    return merge_partitions(spark, path, evals.append_campaign(rows.limit(0), rows), "bucket", evals.append_campaign)


def load_campaign(spark, path):
    """All stored campaign results."""
    return spark.read.parquet(path).drop("bucket")


def record_experiment_results(spark, path, new):
    """Record results by (experiment, variant, lead); only the experiments of the new rows are rewritten."""
    settled = experiments.record_results(new.limit(0), new)
    return merge_partitions(spark, path, settled, "experiment_id", experiments.record_results)


def flat_rows(rows, columns, order="row_idx"):
    """Fixed column order, missing columns blank, then the input__ tail sorted by name."""
    tail = sorted((c for c in rows.columns if c.startswith("input__") and c not in columns), key=str.lower)
    out = ensure_columns(rows, columns).select(*[X.text(c).alias(c) for c in columns], *[X.text(F.col(f"`{c}`")).alias(c) for c in tail])
    return out


def write_csv(rows, path, sep=",", mode="overwrite"):
    rows.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_review_csv(rows, path):
    write_csv(delivery.review_rows(rows).drop("row_idx"), path, sep=";")


def write_sending_tool(review, path, preset="generic"):
    write_csv(delivery.sending_tool(review, preset), path)


def write_client_safe(df, path):
    """Client-safe CSV plus manifest; nothing is published while hard leaks remain.

    The table is made once, into a staging folder beside the result; that very table is scanned, counted and published.
    """
    spark = df.sparkSession
    made = delivery.client_safe(df)
    made.write.mode("overwrite").parquet(f"{path}/staging")
    safe = spark.read.schema(made.schema).parquet(f"{path}/staging")
    leaks = delivery.hard_leaks(safe).head()["leaks"]
    if leaks:
        raise ValueError(f"Delivery blocked, sensitive values remain after redaction: {', '.join(leaks)}")
    write_csv(safe, f"{path}/delivery")
    delivery.delivery_manifest(df, safe).write.mode("overwrite").json(f"{path}/manifest")


def write_eval_report(scored, path):
    metric_rows = evals.metrics(scored).unionByName(evals.decision_counts(scored))
    metric_rows.write.mode("overwrite").parquet(f"{path}/summary")
    evals.eval_details(scored).write.mode("overwrite").parquet(f"{path}/details")


def write_baseline(scored, path, created_at):
    """Metric map as one JSON row."""
    rows = evals.metrics(scored)
    rows.agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics")).select(
        F.lit(created_at).alias("created_at"), "metrics").write.mode("overwrite").json(path)


def read_baseline(spark, path):
    df = spark.read.schema("created_at string, metrics map<string,double>").json(path)
    return df.select(F.explode("metrics").alias("metric", "value"))


# --- hashes -----------------------------------------------------------------------------
def file_hashes(spark, pattern):
    """sha256 of every file; each file is hashed inside the task that reads it."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(
        F.regexp_replace("path", "^file:/*", "/").alias("path"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.sha2("content", 256).alias("sha256"))


def check_manifest(spark, manifest_path, files_pattern):
    """Files of a manifest that are missing or differ; empty means intact."""
    manifest = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(manifest_path)
    wanted = manifest.select(F.explode("files").alias("f")).select("f.path", F.col("f.sha256").alias("expected"))
    actual = file_hashes(spark, files_pattern).select(F.col("file_name").alias("path"), F.col("sha256").alias("actual"))
    joined = wanted.join(actual, "path", "left")
    return joined.filter(F.col("actual").isNull() | (F.col("actual") != F.col("expected"))).withColumn(
        "problem", F.when(F.col("actual").isNull(), "missing").otherwise("mismatch"))


def prompt_hashes(spark, folder, files):
    """Hash per prompt file and the hash of the whole set, one row.

    ``files`` maps the hash name to a file name.  The set hash covers a JSON object with
    sorted names, a blank after every comma and colon.
    """
    found = file_hashes(spark, folder)
    names = sorted(files)
    row = found.agg(*[
        F.coalesce(F.max(F.when(F.col("file_name") == files[n], F.col("sha256"))), F.lit("")).alias(n) for n in names])
    body = F.concat_ws(", ", *[F.concat(F.lit(json.dumps(n) + ': "'), F.col(n), F.lit('"')) for n in names])
    return row.withColumn("prompt_set_hash", F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256))
