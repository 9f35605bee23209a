"""Tab-separated sources and sinks, model files and resumable tables."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = ("entity_id", "business_name", "business_address", "country")


def dataset_root(spark: SparkSession, given: str | None = None, default: str = "dataset") -> str:
    """The folder of the data set: the argument, the session's ``tessera.dataset.root``, ``DATASET_ROOT``, or the default."""
    return given or spark.conf.get("tessera.dataset.root", None) or os.environ.get("DATASET_ROOT") or default


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines behind each file's header that are not blank; malformed UTF-8 becomes U+FFFD."""
    rows = spark.read.text(paths).select(F.make_valid_utf8("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # the header is the first line of the block that starts a file
    heads = rows.where("block = 0").groupBy("file").agg(F.min("at").alias("head"))
    return rows.join(F.broadcast(heads), "file", "left").where("head is null or at <> head").where(F.trim("value") != "").select("value")


def read_entities(spark: SparkSession, *paths: str) -> DataFrame:
    """Entity records of one or more files, in one table: short rows are padded with empty strings, further columns dropped."""
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    return _lines(spark, list(paths)).select(*[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(ENTITY)])


def read_entities_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """The same through the CSV reader, which prunes columns at the scan."""
    schema = ", ".join(f"{c} string" for c in ENTITY)
    return spark.read.csv(list(paths), sep="\t", quote="", escape="", header=True, schema=schema, mode="PERMISSIVE", encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).na.fill("")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``sid, gold``: the comma-separated ids of the second column, blank ones dropped, each once."""
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    ids = F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ",", -1)
    return _lines(spark, [path]).select(F.get(parts, F.lit(0)).alias("sid"), F.array_distinct(F.filter(ids, lambda x: F.trim(x) != "")).alias("gold"))


def truth_long(truth: DataFrame) -> DataFrame:
    return truth.select("sid", F.explode_outer("gold").alias("eid"))


def concatenate(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def result_rows(s1: DataFrame, matches: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row per S1 record: its matches (sid, eid, rank), each once, by rank, joined by commas; empty if there are none."""
    first = matches.groupBy("sid", "eid").agg(F.min("rank").alias("rank"))
    lists = first.groupBy("sid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "eid"))), lambda x: x.eid), ",").alias(column))
    return s1.select(F.col("entity_id").alias("source1_entity_id"), *([c for c in ("ordinal",) if c in s1.columns])).join(lists.withColumnRenamed("sid", "source1_entity_id"), "source1_entity_id", "left").withColumn(column, F.coalesce(column, F.lit("")))


def write_results(rows: DataFrame, path: str, order: str = "ordinal") -> None:
    """Write result rows in the order of the S1 file as one tab-separated folder, part files in that order."""
    out = rows.orderBy(order).drop(order) if order in rows.columns else rows
    out.write.mode("overwrite").csv(path, sep="\t", quote="", emptyValue="", header=True, lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_json(path: str, default=None):
    """A small JSON file of weights or run facts; the default where there is none."""
    if not os.path.exists(path):
        return default
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_linear_model(path: str, coef, intercept: float, threshold: float) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"type": "lr", "coef": [round(float(c), 6) for c in coef], "intercept": round(float(intercept), 6), "threshold": round(float(threshold), 4)}, f)


def write_run_facts(spark: SparkSession, facts: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").write.mode("overwrite").text(path)


def append_log(spark: SparkSession, facts: dict, path: str) -> None:
    """One more row of an experiment log."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "facts string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def write_missing(df: DataFrame, path: str, key: str = "eid") -> DataFrame:
    """Append the rows whose key the table at ``path`` does not hold yet, and return the whole table: a rerun resumes."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).select(key)
        df = df.join(there, key, "left_anti")
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path)
