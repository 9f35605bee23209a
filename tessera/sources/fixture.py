"""A record-linkage data set derived from the ``documents`` table: two noisy sources, and the truth.

Clean records S1 have id ``S1-<doc_id>``; up to four noisy variants of each, ids ``S2-|S3-<4*doc_id+v>``, form
the pool. Every eighteenth record has no match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BASE = """
select doc_id, case lang when 'en' then 'US' when 'fr' then 'France' else 'India' end as country,
       coalesce(get(w, 0), '') a1, coalesce(get(w, 1), '') a2, coalesce(get(w, 2), '') a3,
       coalesce(get(w, 3), '') s1, coalesce(get(w, 4), '') s2, coalesce(get(w, 5), '') s3,
       cast((doc_id * 37) % 9000 + 1 as string) hn,
       case doc_id % 5 when 0 then 'Inc' when 1 then 'LLC' when 2 then 'SARL' when 3 then 'Pvt Ltd' else '' end sfx
from (select doc_id, lang, split(replace(text, chr(10), ' '), ' ') w from {docs})
"""
_UP = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_S1 = """
select concat('S1-', cast(doc_id as string)) entity_id, trim(concat(a1, ' ', a2, ' ', a3, ' ', sfx)) business_name,
       concat(hn, ' ', s1, ' ', s2, ' Street, ', s3) business_address, country from b
"""
_POOL = f"""
select concat(case when v < 2 then 'S2-' else 'S3-' end, cast(doc_id * 4 + v as string)) entity_id,
  case when v = 0 and doc_id % 10 = 3 then trim(concat({_UP.format("a1")}, '  ', a2, ' ', a3, ' ', sfx))
       when v = 0 then concat({_UP.format("a1")}, ' ', {_UP.format("a2")}, ' ', a3) when v = 1 then concat(a2, ' ', a1, ' ', a3, ' & Co')
       when v = 2 then concat('www.', a1, a2, '.com ', a3) else concat(a1, ' ', a3) end business_name,
  case when v = 0 and doc_id % 10 = 3 then concat(hn, ' ', s1, ' ', s2, ' Street, ', s3)
       when v = 0 then concat('#00', hn, ' ', s1, ' ', s2, ' St ', s3) when v = 1 then concat('Unit ', hn, ', ', s1, ' ', s3)
       when v = 2 then '' else concat(s3, ' ', hn, ' ', s2, ' Rd') end business_address, country
from b cross join {{variants}} where doc_id % 18 <> 0 and (doc_id + v) % 7 <> 0
"""


def _base(spark: SparkSession, sf_dir: str) -> str:
    return f"with b as ({_BASE.format(docs=f'parquet.`{sf_dir}/documents.parquet`')})"


def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_base(spark, sf_dir) + _S1)


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_base(spark, sf_dir) + _POOL.format(variants="(select explode(sequence(0, 3)) v)"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sid, gold``: the ids of the pool records of each S1 record, an empty array for a record without any."""
    ids = "filter(transform(sequence(0, 3), v -> if(doc_id % 18 <> 0 and (doc_id + v) % 7 <> 0, concat(if(v < 2, 'S2-', 'S3-'), cast(doc_id * 4 + v as string)), '')), x -> x <> '')"
    return spark.sql(_base(spark, sf_dir) + f" select concat('S1-', cast(doc_id as string)) sid, {ids} gold from b")
