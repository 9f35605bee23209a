"""Incremental linkage: new S1 records arrive as files and are matched against a static pool, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import features as FE
from tessera.functions import text as X
from tessera.operators import blocking
from tessera.sources.tsv import ENTITY


def entity_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Tab-separated entity files as a stream; short rows are padded with empty strings."""
    schema = ", ".join(f"{c} string" for c in ENTITY)
    reader = spark.readStream.schema(schema).option("sep", "\t").option("quote", "").option("escape", "").option("header", True).option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(folder).na.fill("")


def normalised_stream(stream: DataFrame) -> DataFrame:
    """Records with their derived fields; row by row, so it needs no state."""
    return X.precompute(stream)


def start_linkage(stream: DataFrame, pool_pre: DataFrame, idf: DataFrame, freq: DataFrame, out: str, checkpoint: str, threshold: float = 0.5, cap: int = blocking.CAP, max_posting: int = blocking.MAX_POSTING, fuzzy: bool = False) -> StreamingQuery:
    """Match every micro-batch against the pool and append ``sid, eid, score, batch`` to ``out``.

    With ``fuzzy`` all fifteen features of the linear scorer count, otherwise five of them are 0.
    Each batch overwrites only its own partition, so a batch that is run again after a failure leaves no repeats.
    """

    def match(batch: DataFrame, number: int) -> None:
        pre = X.precompute(batch).persist()
        cands = blocking.candidates(pre, pool_pre, idf, cap, max_posting).select("sid", "eid")
        f = FE.pair_features(cands, pre, pool_pre, idf, freq, fuzzy=fuzzy)
        scored = f.select("sid", "eid", F.round(1 / (1 + F.exp(-FE.linear_score(f))), 6).alias("score")).where(F.col("score") >= threshold)
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")
        pre.unpersist()

    return stream.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
