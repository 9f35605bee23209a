"""Regular-expression mining of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Results depend on exactly these patterns of web addresses, quoted paths and quoted operation names.
URL = r"https://[a-zA-Z0-9._/-]{8,160}"
PATH = r"""["'](/[a-zA-Z0-9_{}/-]{5,80})["']"""
OPERATION = r"""["']([A-Z][A-Za-z]{8,60})["']"""


def mine(df: DataFrame, text: str, pattern: str, group: int = 0, keywords: tuple[str, ...] = ()) -> DataFrame:
    """Distinct matches of a pattern, those that contain a keyword if there are any, with the number of texts."""
    found = df.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))).alias("item"))
    if keywords:
        found = found.where(F.lower("item").rlike("|".join(keywords)))
    return found.groupBy("item").agg(F.count("*").alias("n_texts"))


def mine_pairs(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Distinct values of a pattern's two groups, taken together."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"))
    return df.select(F.explode(both).alias("p")).select(F.col("p.a").alias("first"), F.col("p.b").alias("second")).distinct()


def context(df: DataFrame, key: str, text: str, word: str, before: int = 80, after: int = 120) -> DataFrame:
    """Where a word first stands in each text (-1 if it does not) and what surrounds it."""
    at = F.locate(word, F.col(text)) - 1
    start = F.greatest(at - before, F.lit(0))
    cut = F.when(at >= 0, F.substring(F.col(text), start + 1, at + after - start)).otherwise("")
    return df.select(key, at.cast("long").alias("position"), cut.alias("context"))
