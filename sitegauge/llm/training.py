"""The bounded sample of labelled rows that classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, materialize


def in_training(doc_id: Column) -> Column:
    """Rows whose crc32 of the id isn't 0 modulo 5; the others are held out."""
    return crc_fold(doc_id) != 0


#: Code points that a sample has at most, about.
MAX_TRAINING_CHARS = 400_000_000


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_chars: int = MAX_TRAINING_CHARS) -> DataFrame:
    """At most about `max_rows` labelled training rows and `max_chars` code points, as doc_id, label, text, written to the shared folder.

    Rows are drawn by a hash of doc_id, so the same rows come at every run and
    on any cluster; null ids, labels and held-out rows are never drawn. Labels
    that repeat an id count once (the largest), and so do texts (that of the
    least hash). The drawn ids are bounded, so broadcasting them is too; only
    drawn texts are shuffled, repeated ones combined before.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & in_training(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    total = known.count()
    if total > max_rows:
        buckets = 1_000_000
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(buckets)) < int(buckets * max_rows / total))
    drawn = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = drawn.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    out = materialize(one.select("doc_id", "label", "x.text"))
    size = out.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).collect()[0][0]
    if size > max_chars:
        out = out.where(F.pmod(F.xxhash64("doc_id", F.lit(19)), F.lit(1_000_000)) < int(1_000_000 * max_chars / size))
    return out
