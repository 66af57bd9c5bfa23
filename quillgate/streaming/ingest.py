"""Incremental ingest of send results and experiment results.

Every micro-batch appends to a change log (one folder per batch number, overwritten on a
retry), so the cost of a batch depends on the batch, not on the table.  The current state is
a fold over the newest snapshot of the log and the batches behind it.
"""

from pyspark.sql import functions as F

from quillgate import schemas
from quillgate.operators import experiments, feedback
from quillgate.operators.rows import last_per_key
from quillgate.sources.tables import read_state, write_change, write_snapshot


def _append(log_path):
    def write(batch, batch_id):
        write_change(batch, log_path, batch_id)

    return write


def _start(stream, log_path, checkpoint):
    return (
        stream.writeStream.foreachBatch(_append(log_path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_results(spark, source, log_path, checkpoint, max_files=None):
    """Send results (JSON files) into the change log."""
    reader = spark.readStream.schema(schemas.SEND_RESULTS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _start(reader.json(source), log_path, checkpoint)


def stream_experiment_results(spark, source, log_path, checkpoint, max_files=None):
    reader = spark.readStream.schema(schemas.EXPERIMENT_RESULTS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _start(reader.json(source), log_path, checkpoint)


def fold_sends(changes):
    """One row per named send: changes are packed first, snapshot rows are packed already."""
    packed = changes if "ident" in changes.columns else feedback.pack_results(changes)
    return feedback.fold_results(packed)


def current_sends(sends, spark, log_path, base_path=None):
    """Sends with all partial updates of the log; the latest review time wins per field."""
    return feedback.apply_results(sends, read_state(spark, log_path, schemas.SEND_RESULTS, fold_sends, base_path))


def fold_experiment_results(changes):
    """Latest result per (experiment, variant, lead); the later batch wins at equal time."""
    return last_per_key(changes, ["experiment_id", "variant_id", "lead_id"], ["recorded_at", "batch_id"])


def current_experiment_results(spark, log_path, base_path=None):
    """Latest result per (experiment, variant, lead)."""
    return read_state(spark, log_path, schemas.EXPERIMENT_RESULTS, fold_experiment_results, base_path).drop("batch_id")


def funnel(sends, spark, log_path, base_path=None):
    return feedback.funnel_totals(current_sends(sends, spark, log_path, base_path))


def experiment_report(spark, log_path, min_sample=30, base_path=None):
    results = experiments.variant_results(current_experiment_results(spark, log_path, base_path))
    return experiments.report(experiments.significance(results, min_sample), min_sample)


def compact_sends(spark, log_path, base_path):
    """Snapshot of the send log; returns the last batch it contains."""
    return write_snapshot(spark, log_path, schemas.SEND_RESULTS, fold_sends, base_path)


def compact_experiment_results(spark, log_path, base_path):
    return write_snapshot(spark, log_path, schemas.EXPERIMENT_RESULTS, fold_experiment_results, base_path)
