"""Intermediate tables in the folder that driver and executors share, and small table helpers."""

import tempfile
import uuid

from pyspark.sql import functions as F


def shared_dir(spark):
    """The folder named in spark.checkpoint.dir; a local one only where a one-machine session names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quillgate-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df, name):
    """Write a table into the shared folder and read it back: later plans start there, also after lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgate/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of a narrow side that is sent to every task; beyond, both sides are shuffled.
MOST_SENT = 200_000


def sent(small):
    """Hint to send a saved table to every task where its counted rows are few; else the table as it is."""
    return F.broadcast(small) if small.count() <= MOST_SENT else small


#: Documents in one Arrow batch: texts are long, and a task holds a batch in the JVM and one in its Python worker.
BATCH_ROWS = 1000


def small_batches(spark):
    """Arrow batches of BATCH_ROWS documents from here on, so that the memory of a task does not grow with the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_column):
    """True for ids whose crc32 as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def one_text(docs, picked, id_column="doc_id", text_column="text"):
    """The picked rows with one text per id: the smallest of its texts that are not null (null where all are).

    ``picked`` has one row per id and few rows, so it goes to every task; texts of a repeated id are combined
    before they are shuffled.
    """
    met = docs.select(F.col(id_column), F.col(text_column).alias("text")).join(F.broadcast(picked), id_column)
    return met.groupBy(*picked.columns).agg(F.min("text").alias("text"))


def labelled_sample(docs, labels, label_column, per_label, withheld=True):
    """(doc_id, text, label) of at most ``per_label`` documents of each label 0 and 1, and the counts of both labels.

    The ids with the smallest hashes are picked: bounded, and the same on every run.  An id counts once, however
    often it is labelled or stored: with the label that at least half of its labels are 1 for, and with the
    smallest of its texts.  Texts are fetched for picked ids alone.  With ``withheld``, held-out ids never enter.
    """
    marked = labels.where(F.col(label_column).isin(0, 1) & F.col("doc_id").isNotNull())
    marked = marked.where(~held_out("doc_id")) if withheld else marked
    marked = marked.groupBy("doc_id").agg((F.avg(F.col(label_column)) >= 0.5).cast("int").alias("label"))
    known = saved(marked.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id"), "labelled")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = part if picked is None else picked.unionByName(part)
    sample = saved(one_text(docs, saved(picked, "picked")).select("doc_id", "text", "label"), "sample")  # at most 2 * per_label ids
    return sample, (sizes.get(0, 0), sizes.get(1, 0))
