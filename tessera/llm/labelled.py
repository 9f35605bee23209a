"""Bounded labelled samples for the classifiers, and the fold that is never learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents of each class, each of at most so many bytes, train a classifier.
ROWS_A_CLASS, ROW_BYTES = 2500, 25_000


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids that nothing is learned from; null ids belong to it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, worst, rows: int = ROWS_A_CLASS) -> tuple[list[bytes], list[int]]:
    """Texts and labels of at most ``rows`` documents of each class, the first by a hash of their id.

    ``worst`` (``F.min`` or ``F.max``) decides between contradictory labels of an id. Rows without id, label or
    text, held-out ids and texts over ``ROW_BYTES`` are not used; of several texts of an id the smallest is. The driver
    gets 2 * ``rows`` texts at most, 125 MB by default.
    """
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    marked = marked.where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(worst("label").alias("label"))
    drawn = [marked.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    ids = drawn[0].unionByName(drawn[1])  # 2 * rows ids at most, so a broadcast is safe
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= ROW_BYTES)
    one = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = one.select("doc_id", "label", F.col("text").cast("binary").alias("text")).collect()
    found.sort(key=lambda r: r["doc_id"])
    return [bytes(r["text"]) for r in found], [r["label"] for r in found]
