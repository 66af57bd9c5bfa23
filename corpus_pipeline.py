"""Training-corpus pipeline: toxicity, quality, near duplicates, benchmark decontamination, token ids.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next
one's docs.  The first four return the columns of documents; a null text is never toxic, contaminated or
a copy, and its quality is the share of good labels.
"""

import public_tokenizers
from pyspark.sql import functions as F

from quillgate.llm import bpe, decontam, probmin, quality, queries, severity
from quillgate.llm.store import saved, small_batches, table

#: The fitted models and the byte-pair encoding have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def toxicity(spark, docs, sf_dir):
    """Documents whose probability of any severity grade is below one half."""
    small_batches(spark)
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return docs.where(~severity.severity(model, F.col("text"))["toxic"])


def quality_vote(spark, docs, sf_dir):
    """Documents that their labelled neighbours vote to be of quality 1."""
    small_batches(spark)
    model = queries.quality_model(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.quality(model, F.col("text")) >= 0.5)


def near_duplicates(spark, docs, sf_dir):
    """The document of the smallest id of each class of copies and near copies."""
    small_batches(spark)
    return probmin.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Documents of which benchmark windows cover less than a twentieth of the words."""
    small_batches(spark)
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark, docs, sf_dir):
    """Token ids of each document, and whether they decode to its text."""
    small_batches(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    found = bpe.coded(texts, ranks, public_tokenizers.PATTERN)
    return found.select("doc_id", "lang", "source", "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", toxicity), ("quality", quality_vote), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("token_ids", token_ids)]


def run(spark, sf_dir):
    """All stages over documents; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = saved(docs, f"stage-{name}") if i < len(STAGES) - 1 else docs
    return docs
