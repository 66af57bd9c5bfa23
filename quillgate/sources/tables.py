"""Append-only logs and change logs on plain Parquet folders."""

from pyspark.sql import functions as F

from quillgate.functions import text as X


def append_history(records, path, created_at):
    """Run records as JSON payload rows."""
    payload = F.to_json(F.struct(F.lit(created_at).alias("created_at"), *records.columns))
    records.select(F.lit(created_at).alias("created_at"), payload.alias("payload_json")).write.mode("append").parquet(path)


def load_history(spark, path, limit=50):
    """The newest ``limit`` run payloads among those that are JSON (all of them with ``limit=None``)."""
    df = spark.read.parquet(path).filter(F.try_parse_json("payload_json").isNotNull())
    return df if limit is None else df.orderBy(F.desc("created_at"), F.desc("payload_json")).limit(max(1, limit))


def load_history_jsonl(spark, path, schema, limit=50, order="created_at"):
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.orderBy(F.desc(order)).limit(max(1, limit))


EMAIL_LOG = {
    "run_id": ["run_id"], "row_id": ["row_id"], "example_id": ["example_id"],
    "company": ["company_name", "company"], "person": ["recipient_name", "person"],
    "website": ["website_url", "website"], "model_provider": ["model_provider"],
    "model_name": ["model_name"], "tone_profile": ["tone_profile"],
    "prompt_set_hash": ["prompt_set_hash"], "evidence_prompt_hash": ["evidence_prompt_hash"],
    "write_prompt_hash": ["write_prompt_hash"], "qc_prompt_hash": ["qc_prompt_hash"],
    "tone_profile_hash": ["tone_profile_hash"], "personalized_line": ["opening_line", "personalized_line"],
}


def email_log_rows(rows, created_at):
    """Typed log columns plus the whole row as JSON."""
    def pick(names):
        have = [n for n in names if n in rows.columns]
        return X.first_present(*have) if have else F.lit("")

    return rows.select(
        F.lit(created_at).alias("created_at"), *[pick(n).alias(c) for c, n in EMAIL_LOG.items()],
        F.to_json(F.struct(*rows.columns)).alias("payload_json"))


def append_email_log(rows, path, created_at):
    email_log_rows(rows, created_at).write.mode("append").parquet(path)


# --- change logs --------------------------------------------------------------------------
def write_change(df, path, batch_id):
    """One folder per batch; a repeated batch replaces its own folder, so retries are safe."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _folders(spark, path, prefix, finished=False):
    """{number: folder} of the folders ``prefix=number`` below a path, in any store that Spark reads."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    found = {}
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{prefix}=") and (
                not finished or files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))):
            found[int(name.split("=")[1])] = status.getPath()
    return found


def read_changes(spark, path, schema, after=None):
    """Batches of a change log with their batch number: all, or only the folders of those behind a batch."""
    if after is None:
        return spark.read.schema(schema + ", batch_id bigint").option("basePath", path).parquet(path)
    later = [folder.toString() for n, folder in sorted(_folders(spark, path, "batch_id").items()) if n > after]
    if not later:
        return spark.createDataFrame([], schema + ", batch_id bigint")
    return spark.read.schema(schema + ", batch_id bigint").option("basePath", path).parquet(*later)


def latest_snapshot(spark, base_path):
    """(number of the last batch that the newest finished snapshot contains, its folder), or (None, None)."""
    found = _folders(spark, base_path, "through", finished=True)
    return (max(found), found[max(found)].toString()) if found else (None, None)


def read_state(spark, log_path, schema, fold, base_path=None):
    """The folded state of a change log: the newest snapshot and the batches behind it, or all batches.

    ``fold`` turns changes into one row per key, and folding folded rows with later changes gives the same as
    folding all changes at once.  A batch that a snapshot contains is not read again, so a retry of it has no
    effect and old batches cost nothing.
    """
    through, folder = latest_snapshot(spark, base_path) if base_path else (None, None)
    later = fold(read_changes(spark, log_path, schema, through))
    return later if folder is None else fold(spark.read.schema(later.schema).parquet(folder).unionByName(later))


def write_snapshot(spark, log_path, schema, fold, base_path):
    """Write the state of the log as a snapshot that names the last batch it contains, and return that number.

    Readers go on with the older snapshot until the new one is finished; a repeated call without new batches
    writes nothing.
    """
    batches = _folders(spark, log_path, "batch_id", finished=True)
    through = latest_snapshot(spark, base_path)[0]
    if not batches or through is not None and max(batches) <= through:
        return through
    last = max(batches)
    upto = lambda df: fold(df.filter(F.col("batch_id") <= last) if "batch_id" in df.columns else df)
    state = read_state(spark, log_path, schema, upto, base_path)
    state.write.mode("overwrite").parquet(f"{base_path}/through={last}")
    return last


def trim_log(spark, log_path, base_path):
    """Drop the batches that the last snapshot but one contains already, and the snapshots before that one.

    The newest two snapshots stay, so a reader that began with the older one still finds what it needs.
    """
    kept = sorted(_folders(spark, base_path, "through", finished=True))[-2:]
    if len(kept) < 2:
        return 0
    old = [f for n, f in _folders(spark, log_path, "batch_id").items() if n <= kept[0]]
    old += [f for n, f in _folders(spark, base_path, "through").items() if n < kept[0]]
    for folder in old:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(old)


# --- tables of keyed rows in partitions ---------------------------------------------------
def merge_partitions(spark, path, new, partition, merge):
    """Merge new rows into a partitioned table; only the partitions that they fall into are read and written.

    ``merge(old, new)`` returns the rows that replace these partitions.  The partitions touched are a short
    list (splits, or hash buckets of a fixed number).  Repeating a merge changes nothing, since it merges by key.
    """
    touched = sorted(r[0] for r in new.select(partition).distinct().collect())
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    rows = new
    if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        old = spark.read.schema(new.schema).parquet(path).filter(F.col(partition).isin(touched))
        rows = merge(old, new)
    rows.select(*new.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return touched


def with_bucket(df, keys, buckets=64, name="bucket"):
    """Hash bucket of the keys, as the partition of a table that has no natural one."""
    return df.withColumn(name, F.pmod(F.hash(*keys), F.lit(buckets)))


def purge_cache(cache, path, as_of_epoch, ttl_seconds=86400):
    """Write the rows of a cache table that are still valid to a new folder."""
    from quillgate.operators.prompts import fresh

    fresh(cache, as_of_epoch, ttl_seconds).write.mode("overwrite").parquet(path)
