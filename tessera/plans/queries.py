"""One query per operator, each with its oracle where SQL can express it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import features as FE
from tessera.functions import similarity as S
from tessera.functions import text as X
from tessera.operators import blocking, decide, dense, graph, lsh, metrics, mining, models
from tessera.plans import sql as Q
from tessera.plans.linkage import CAP, MAX_POSTING, Full, Linkage
from tessera.plans.registry import full, query
from tessera.sources import tsv

_C = Q.candidates(CAP, MAX_POSTING)
_SCORED = f"with {Q.POSTINGS}, {_C}, {Q.SCORED}"
_CAND = f"with {Q.POSTINGS}, {_C}"


def _text(c):
    """An array as text that any engine writes alike."""
    return F.array_join(c, " ")


def _table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- sources ---------------------------------------------------------------------------------------------------


@query(f"with {Q.FIXTURE} select * from s1")
def scan_entities(spark, sf_dir):
    """S1 records through a tab-separated file and back."""
    run = Linkage(spark, sf_dir)
    path = run.scratch.path("tsv")
    run.s1.write.csv(path, sep="\t", quote="", header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tsv.read_entities(spark, path)


@query(f"with {Q.FIXTURE} select * from s1")
def scan_entities_csv(spark, sf_dir):
    run = Linkage(spark, sf_dir)
    path = run.scratch.path("tsv")
    run.s1.write.csv(path, sep="\t", quote="", header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tsv.read_entities_csv(spark, path)


@query(f"with {Q.FIXTURE} select s1.entity_id sid, gold.eid from s1 left join gold on s1.entity_id = gold.sid")
def ground_truth_long(spark, sf_dir):
    """Truth through its tab-separated file, one row per link, entities without links kept."""
    run = Linkage(spark, sf_dir)
    path = run.scratch.path("truth")
    run.truth.select("sid", F.array_join("gold", ",").alias("ids")).write.csv(path, sep="\t", quote="", header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tsv.truth_long(tsv.read_truth(spark, path))


@query(f"with {Q.FIXTURE} select * from pool where entity_id like 'S2-%' union all select * from pool where entity_id like 'S3-%'")
def pool_union(spark, sf_dir):
    pool = Linkage(spark, sf_dir).pool
    return tsv.concatenate(pool.where(F.col("entity_id").startswith("S2-")), pool.where(F.col("entity_id").startswith("S3-")))


@query("select page_id, length(html) n_chars from pages")
def whole_texts(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("n_chars"))


@query("select vec_id, len(embedding) dim from embeddings")
def vector_table(spark, sf_dir):
    """Embeddings written to and reloaded from their table, resuming without repeats."""
    run = Linkage(spark, sf_dir)
    emb = _table(spark, sf_dir, "embeddings").withColumn("dim", F.size("embedding").cast("long"))
    path = run.scratch.path("vectors")
    tsv.write_missing(emb.where("vec_id < 100"), path, "vec_id")
    return tsv.write_missing(emb, path, "vec_id").select("vec_id", "dim")


# --- normalisation ---------------------------------------------------------------------------------------------

_BOTH = "(select entity_id, business_name, business_address, country from s1 union all select entity_id, business_name, business_address, country from pool)"


def _records(spark, sf_dir):
    run = Linkage(spark, sf_dir)
    return run.s1.unionByName(run.pool)


@query(f"select c_custkey, trim({Q.clean_noise('n')}) cleaned from (select c_custkey, concat('x@y.co ', c_name, ' @me_é') n from customer)")
def clean_noise(spark, sf_dir):
    n = F.concat(F.lit("x@y.co "), F.col("c_name"), F.lit(" @me_é"))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.trim(X.clean_noise(n)).alias("cleaned"))


@query(f"select doc_id, len(t) n_tokens, md5(array_to_string(t, ' ')) digest from (select doc_id, {Q.tokens('text')} t from documents)")
def fold_tokens(spark, sf_dir):
    t = _table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(_text("t")).alias("digest"))


@query(f"with {Q.FIXTURE} select entity_id, {Q.joined(Q.name_tokens('business_name'))} toks from {_BOTH}")
def name_tokens(spark, sf_dir):
    return _records(spark, sf_dir).select("entity_id", _text(X.name_tokens(F.col("business_name"))).alias("toks"))


@query(f"with {Q.FIXTURE} select entity_id, {Q.joined('list_sort(' + Q.house_numbers('business_address') + ')')} nums from {_BOTH}")
def house_numbers(spark, sf_dir):
    return _records(spark, sf_dir).select("entity_id", _text(F.array_sort(X.house_numbers(F.col("business_address")))).alias("nums"))


@query(f"with {Q.FIXTURE} select entity_id, {Q.joined('t')} toks, coalesce(t[-1], '') city, coalesce(list_filter(t, lambda x: length(x) >= 4)[1], t[1], '') street from (select entity_id, {Q.addr_tokens('business_address')} t from {_BOTH})")
def addr_tokens(spark, sf_dir):
    t = _records(spark, sf_dir).select("entity_id", X.addr_tokens(F.col("business_address")).alias("t"))
    return t.select("entity_id", _text("t").alias("toks"), X.last_token(F.col("t")).alias("city"), X.street_token(F.col("t")).alias("street"))


@query(f"with {Q.PRECOMPUTED} select entity_id, name_sq, {Q.joined('list_sort(name_set)')} names, {Q.joined('list_sort(house_set)')} houses, addr_sq, {Q.joined('list_sort(addr_set)')} addrs, city, folded from (select * from p1 union all select * from p2)")
def precompute(spark, sf_dir):
    p = X.precompute(_records(spark, sf_dir))
    return p.select("entity_id", "name_sq", *[_text(F.array_sort(c)).alias(n) for c, n in (("name_set", "names"), ("house_set", "houses"))], "addr_sq", _text(F.array_sort("addr_set")).alias("addrs"), "city", "folded")


@query(f"with {Q.PRECOMPUTED} select entity_id, {Q.joined('list_sort(' + Q.grams(chr(40) + chr(39) + '  ' + chr(39) + ' || name_sq || ' + chr(39) + ' ' + chr(39) + chr(41)) + ')')} grams from p2")
def char_grams(spark, sf_dir):
    p = Linkage(spark, sf_dir).pool_pre
    return p.select("entity_id", _text(F.array_sort(X.padded_grams(F.col("name_sq")))).alias("grams"))


_SHINGLES = Q.grams("replace(folded, ' ', '')")


@query(f"with {Q.PRECOMPUTED} select entity_id, {Q.joined('list_sort(' + _SHINGLES + ')')} shingles from p2")
def char_shingles(spark, sf_dir):
    p = Linkage(spark, sf_dir).pool
    return p.select("entity_id", _text(F.array_sort(X.char_shingles(F.col("business_name")))).alias("shingles"))


@query(
    f"""with {Q.FIXTURE} select entity_id, array_to_string(list_filter([case when trim(business_name) <> '' then 'COL name VAL ' || trim(business_name) end,
    case when trim(business_address) <> '' then 'COL address VAL ' || trim(business_address) end, case when trim(country) <> '' then 'COL country VAL ' || trim(country) end], lambda x: x is not null), ' ') line,
    trim(business_name || ' ' || business_address || ' ' || country) embed from {_BOTH}"""
)
def serialize_entities(spark, sf_dir):
    c = [F.col(x) for x in ("business_name", "business_address", "country")]
    return _records(spark, sf_dir).select("entity_id", X.serialize(*c).alias("line"), X.embedding_text(*c).alias("embed"))


_LOWERED = "['inc', 'llc', 'ltd', 'corp', 'co', 'sarl', 'sas', 'pvt']"


@query(
    f"""with {Q.FIXTURE}, cut as (select entity_id, business_name, string_split(trim(regexp_replace(business_name, '\\s+', ' ', 'g')), ' ') parts, {', '.join(f"cast('0x' || substr(md5(concat(entity_id, ':{42 + k}')), 1, 7) as bigint) h{k}" for k in range(4))} from s1),
    word as (select *, h0 % 100 r, len(parts) n, cast(h1 % len(parts) as int) + 1 i from cut), letter as (select *, cast(h2 % greatest(1, length(parts[i]) - 1) as int) + 1 j, parts[i] x from word)
    select entity_id, business_name, case when trim(business_name) = '' then business_name
      when r < 25 and n > 1 then array_to_string(list_concat(parts[:i - 1], parts[i + 1:]), ' ')
      when r < 50 then array_to_string(list_concat(parts[:i - 1], [case when length(x) > 2 then concat(substring(x, 1, j - 1), substring(x, j + 1, 1), substring(x, j, 1), substring(x, j + 2)) else x end], parts[i + 1:]), ' ')
      when r < 75 and list_contains({_LOWERED}, rtrim(lower(parts[-1]), '.')) then array_to_string(list_concat(parts[:n - 1], [['Inc', 'LLC', 'Ltd', 'Corp', 'Co', 'SARL', 'SAS', 'Pvt'][cast(h3 % 8 as int) + 1]]), ' ')
      else array_to_string(parts, ' ') end augmented from letter"""
)
def augment_names(spark, sf_dir):
    s1 = Linkage(spark, sf_dir).s1
    return s1.select("entity_id", "business_name", X.augment_name(F.col("business_name"), F.col("entity_id")).alias("augmented"))


# letters as digits of the code, 7 for letters that are passed over, 0 for all else; equal neighbours count once
_SOUNDEX = "translate(name_sq, 'abcdefghijklmnopqrstuvwxyz0123456789', '012301270224550126230172020000000000')"


@query(
    f"""with {Q.PRECOMPUTED}, digits as (select entity_id, name_sq, concat({_SOUNDEX}[1], replace(substring({_SOUNDEX}, 2), '7', '')) d from p2)
    select entity_id, name_sq, case when regexp_matches(name_sq, '^[a-z]') then concat(upper(name_sq[1]),
      rpad(left(array_to_string(list_transform(range(2, length(d) + 1), lambda i: case when d[i] <> '0' and d[i] <> d[i - 1] then d[i] else '' end), ''), 3), 3, '0')) else name_sq end code from digits"""
)
def soundex_codes(spark, sf_dir):
    p = Linkage(spark, sf_dir).pool_pre
    return p.select("entity_id", "name_sq", X.soundex_code(F.col("name_sq")).alias("code"))


@query("select p_partkey, replace(p_name, 'a', 'a') p_name, array_to_string(flatten(list_transform(string_split(lower(p_type), ' '), lambda t: case t when 'standard' then [t, 'std'] when 'economy' then [t, 'eco'] else [t] end)), ' ') expanded from part")
def expand_abbreviations(spark, sf_dir):
    t = X.expand_abbreviations(F.split(F.lower("p_type"), " "), {"standard": "std", "economy": "eco"})
    return _table(spark, sf_dir, "part").select("p_partkey", "p_name", _text(t).alias("expanded"))


# --- blocking --------------------------------------------------------------------------------------------------


@query(
    f"""with {Q.FIXTURE}, k as (select {Q.plain_key("business_name")} n, {Q.plain_key("business_address")} a, entity_id from pool where trim(business_address) <> ''),
    r as (select s.entity_id sid, list_distinct(list(k.entity_id) filter (k.entity_id is not null)) pred from s1 s left join k on {Q.plain_key("s.business_name")} = k.n and {Q.plain_key("s.business_address")} = k.a group by s.entity_id),
    g as (select sid, list(eid) gold from gold group by sid),
    e as (select r.sid, coalesce(len(pred), 0) n_pred, coalesce(len(gold), 0) n_gold, coalesce(len(list_intersect(pred, gold)), 0) tp from r left join g on r.sid = g.sid)
    select count(*) n, count(*) filter (n_pred > 0) n_hit, count(*) filter (n_pred = 0) n_none, count(*) filter (n_gold = 0) n_singletons, round(avg({Q.f05("tp", "n_pred", "n_gold")}), 6) macro_f05 from e"""
)
def exact_match_f05(spark, sf_dir):
    """The exact-key baseline: plain name and address equal."""
    run = Linkage(spark, sf_dir)
    e = blocking.exact_matches(run.s1, run.pool).join(run.truth, "sid", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return e.agg(F.count("*").alias("n"), count(F.size("pred") > 0).alias("n_hit"), count(F.size("pred") == 0).alias("n_none"), count(F.size("gold") == 0).alias("n_singletons"), F.round(F.avg(metrics.f05(F.col("pred"), F.col("gold"))), 6).alias("macro_f05"))


@query(f"with {Q.POSTINGS} select * from post")
def postings(spark, sf_dir):
    return blocking.postings(Linkage(spark, sf_dir).pool_pre)


@query(f"with {Q.POSTINGS} select fld, count(*) n_tokens, max(n) longest, count(*) filter (fld = 'H' or n <= {MAX_POSTING}) n_used from stats group by fld")
def posting_stats(spark, sf_dir, linkage=Linkage):
    run = linkage(spark, sf_dir)
    stats = blocking.posting_stats(blocking.postings(run.pool_pre))
    used = F.sum(F.when((F.col("fld") == "H") | (F.col("n") <= run.max_posting), 1).otherwise(0))
    return stats.groupBy("fld").agg(F.count("*").alias("n_tokens"), F.max("n").alias("longest"), used.alias("n_used"))


@query(f"with {Q.POSTINGS} select token, round(idf, 6) idf from idf")
def idf_table(spark, sf_dir):
    return Linkage(spark, sf_dir).idf.select("token", F.round("idf", 6).alias("idf"))


@query(f"{_CAND} select * from cand")
def idf_overlap_candidates(spark, sf_dir, linkage=Linkage):
    return linkage(spark, sf_dir).candidates.select("sid", "eid", "score", "rank", "capped")


@query(f"with {Q.POSTINGS}, {Q.candidates(CAP, MAX_POSTING, True)} select sid, eid, score, rank from cand")
def uniform_candidates(spark, sf_dir, linkage=Linkage):
    run = linkage(spark, sf_dir)
    return blocking.candidates(run.s1_pre, run.pool_pre, None, run.cap, run.max_posting).select("sid", "eid", "score", "rank")


@query(f"{_CAND} select count(*) n, round(avg(cast(capped as int)), 6) capped_rate, round(avg(n), 6) mean_candidates from (select sid, bool_or(capped) capped, count(*) n from cand group by sid)")
def capped_rate(spark, sf_dir, linkage=Linkage):
    per = linkage(spark, sf_dir).candidates.groupBy("sid").agg(F.bool_or("capped").alias("capped"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n"), F.round(F.avg(F.col("capped").cast("int")), 6).alias("capped_rate"), F.round(F.avg("n"), 6).alias("mean_candidates")).select("n", "capped_rate", "mean_candidates")


_RECALL = "select k, round(avg(h / n), 6) recall from (select g.sid, k, count(*) n, count(*) filter (c.rank <= k) h from gold g cross join (select unnest([1, 5, 10, 20]) k) left join cand c on g.sid = c.sid and g.eid = c.eid group by g.sid, k) group by k"


@query(f"{_CAND} {_RECALL}")
def candidate_recall_at_k(spark, sf_dir, linkage=Linkage, ks=(1, 5, 10, 20)):
    run = linkage(spark, sf_dir)
    return metrics.recall_at_k(run.candidates, run.gold, ks)


@query(f"{_CAND}, r as ({_RECALL}) select recall, case when recall >= 0.93 then 'proceed' when recall >= 0.88 then 'marginal' else 'change' end gate from r where k = 20")
def recall_gate(spark, sf_dir, linkage=Linkage, k=20):
    run = linkage(spark, sf_dir)
    r = metrics.recall_at_k(run.candidates, run.gold, (k,))
    return r.select("recall", metrics.gate(F.col("recall")).alias("gate"))


@query(f"{_CAND}, e as (select s1.entity_id sid, (select count(*) from gold g where g.sid = s1.entity_id) n_gold, (select count(*) from gold g join cand c on g.sid = c.sid and g.eid = c.eid where g.sid = s1.entity_id) tp from s1) select count(*) n, round(avg({Q.f05('tp', 'tp', 'n_gold')}), 6) macro_ceiling from e")
def macro_ceiling(spark, sf_dir, linkage=Linkage):
    run = linkage(spark, sf_dir)
    return metrics.macro_ceiling(run.entities, run.candidates, run.gold)


@query(
    f"""{_SCORED}, p as (select sid, count(*) n_cand, count(*) filter (score >= 0.5) n_pred from scored group by sid),
    h as (select s.sid, count(*) n_reached, count(*) filter (score >= 0.5) tp from scored s join gold g on s.sid = g.sid and s.eid = g.eid group by s.sid),
    g as (select sid, count(*) n_gold from gold group by sid),
    e as (select s1.entity_id, coalesce(n_cand, 0) n_cand, coalesce(n_pred, 0) n_pred, coalesce(n_reached, 0) n_reached, coalesce(tp, 0) tp, coalesce(n_gold, 0) n_gold from s1 left join p on entity_id = p.sid left join h on entity_id = h.sid left join g on entity_id = g.sid)
    select count(*) n, round(avg({Q.f05("tp", "n_pred", "n_gold")}), 6) macro_f05, round(sum(n_reached) / sum(n_gold), 6) recall_ceiling, round(avg(n_cand), 6) mean_candidates, cast(sum(n_gold) as bigint) gold_links from e"""
)
def run_summary(spark, sf_dir, linkage=Linkage):
    """Single-threshold evaluation of the fixed scorer, with the recall ceiling of its candidates."""
    run = linkage(spark, sf_dir)
    per = metrics.per_entity(run.entities, run.scored, run.gold, F.col("score") >= 0.5)
    more = metrics.per_entity(run.entities, run.scored, run.gold, F.lit(True)).select("sid", F.col("n_pred").alias("n_cand"), F.col("tp").alias("n_reached"))
    return metrics.summary(per.join(more, "sid"))


_SH = f"with {Q.PRECOMPUTED}, a as (select entity_id sid, {_SHINGLES} sh from p1), e as (select entity_id eid, {_SHINGLES} sh from p2)"


def _shingled(spark, sf_dir):
    run = Linkage(spark, sf_dir)
    left = run.s1.select(F.col("entity_id").alias("sid"), X.char_shingles(F.col("business_name")).alias("sh"))
    right = run.pool.select(F.col("entity_id").alias("eid"), X.char_shingles(F.col("business_name")).alias("sh"))
    return run.scratch.table(left, "left"), run.scratch.table(right, "right")


@query(f"{_SH}, t1 as (select sid, len(sh) n, unnest(sh) g from a), t2 as (select eid, len(sh) n, unnest(sh) g from e) select sid, eid, round(count(*) / (any_value(t1.n) + any_value(t2.n) - count(*)), 6) score from t1 join t2 using (g) group by sid, eid having round(count(*) / (any_value(t1.n) + any_value(t2.n) - count(*)), 6) >= 0.4")
def exact_jaccard_join(spark, sf_dir):
    return lsh.exact_join(*_shingled(spark, sf_dir), 0.4).select("sid", "eid", "score")


@query(None)
def minhash_lsh_join(spark, sf_dir):
    return lsh.lsh_join(*_shingled(spark, sf_dir), 0.4)


def _vectors(spark, sf_dir, key, dim=None):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias(key), dense.normalised(F.col("embedding"), dim).alias("v"))


def _knn_sql(dim: str, k: int) -> str:
    v = f"list_transform(embedding[1:{dim}], lambda x: cast(x as double))"
    return f"""n as (select cast(vec_id as varchar) id, label, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) v from (select vec_id, label, {v} v from embeddings)),
    knn as (select sid, eid, score, r as rank from (select a.id sid, e.id eid, round(list_inner_product(a.v, e.v), 6) score, row_number() over (partition by a.id order by round(list_inner_product(a.v, e.v), 6) desc, e.id) r from n a, n e where cast(a.id as bigint) % 20 = 0) where r <= {k})"""


def _queries_of(v):
    """The stated query set: every twentieth vector."""
    return v.where("cast(sid as bigint) % 20 = 0")


@query(f"with {_knn_sql('64', 10)} select sid, eid, score, rank from knn")
def knn_topk(spark, sf_dir):
    return dense.knn(_queries_of(_vectors(spark, sf_dir, "sid")), _vectors(spark, sf_dir, "eid"), 10)


@query(f"with {_knn_sql('32', 5)} select sid, eid, score, rank from knn")
def knn_truncated(spark, sf_dir):
    return dense.knn(_queries_of(_vectors(spark, sf_dir, "sid", 32)), _vectors(spark, sf_dir, "eid", 32), 5)


def _lists(spark, sf_dir, linkage=Linkage):
    run = linkage(spark, sf_dir)
    uniform = blocking.candidates(run.s1_pre, run.pool_pre, None, run.cap, run.max_posting)
    return run, run.candidates, uniform


_UNION = f"""with {Q.POSTINGS}, {_C}, {Q.candidates(CAP, MAX_POSTING, True, "uni")},
  j as (select sid, eid, row_number() over (partition by sid order by score desc, eid) rank from (
    select sid, eid, round(count(*) / (any_value(t1.n) + any_value(t2.n) - count(*)), 6) score
    from (select entity_id sid, len(sh) n, unnest(sh) g from (select entity_id, {_SHINGLES} sh from p1)) t1
    join (select entity_id eid, len(sh) n, unnest(sh) g from (select entity_id, {_SHINGLES} sh from p2)) t2 using (g) group by sid, eid) where score >= 0.4)"""
_MERGED = "select sid, eid, row_number() over (partition by sid order by src, pos, eid) rank from (select sid, eid, min(src * 1000000 + pos) // 1000000 src, min(src * 1000000 + pos) % 1000000 pos from u group by sid, eid)"


@query(f"{_UNION}, u as (select sid, eid, 0 src, rank pos from cand union all select sid, eid, 1, rank from uni) {_MERGED}")
def hybrid_union(spark, sf_dir, linkage=Linkage):
    run, a, b = _lists(spark, sf_dir, linkage)
    return blocking.union_candidates(a, b, pool=run.pool)


@query(f"{_UNION}, u as (select sid, eid, 0 src, rank pos from cand union all select sid, eid, 1, rank from uni union all select sid, eid, 2, rank from j) select * from ({_MERGED}) where rank <= 30")
def triple_union(spark, sf_dir, linkage=Linkage, max_k=30):
    run, a, b = _lists(spark, sf_dir, linkage)
    # a list's rank k is never before place k of the union
    return blocking.union_candidates(a, b, lsh.exact_join(*_shingled(spark, sf_dir), 0.4, max_k), max_k=max_k, pool=run.pool)


def _hash_sql(src, key):
    parts = {"NS": ["name_sq"], "HS": ["h", "street"], "HC": ["h", "city"], "AD": ["addr_sq"], "FC": ["f", "city"]}
    return " union all ".join(f"select entity_id {key}, concat_ws('|', '{t}', country, {', '.join(c)}) k from {src} where {' and '.join(x + chr(60) + chr(62) + chr(39) * 2 for x in c)}" for t, c in parts.items())


@query(
    f"""with {Q.PRECOMPUTED}, x1 as (select *, coalesce(house_set[1], '') h, coalesce(list_filter(al, lambda x: length(x) >= 4)[1], al[1], '') street, coalesce(name_list[1], '') f from (select p1.*, {Q.addr_tokens("business_address")} al from p1 join s1 using (entity_id))),
    x2 as (select *, coalesce(house_set[1], '') h, coalesce(list_filter(al, lambda x: length(x) >= 4)[1], al[1], '') street, coalesce(name_list[1], '') f from (select p2.*, {Q.addr_tokens("business_address")} al from p2 join pool using (entity_id))),
    k1 as ({_hash_sql("x1", "sid")}), k2 as ({_hash_sql("x2", "eid")}) select sid, eid, count(*) n_keys from k1 join k2 using (k) group by sid, eid"""
)
def hash_key_candidates(spark, sf_dir):
    run = Linkage(spark, sf_dir)
    return blocking.hash_key_candidates(run.s1_pre, run.pool_pre)


# --- features and scores ---------------------------------------------------------------------------------------

_SQL_FEATURES = [f for f in FE.FEATURES if f not in ("jaro_winkler", "phonetic_match") and not f.startswith("rf_")]


@query(f"with {Q.POSTINGS} select country, name_sq, freq from (select country, name_sq, count(*) freq from p1 group by all)")
def name_freq(spark, sf_dir):
    return FE.name_frequency(Linkage(spark, sf_dir).s1_pre)


@query(f"{_CAND}, {Q.FEATURES} select sid, eid, {', '.join(f'round({f}, 6) {f}' for f in _SQL_FEATURES)} from feat")
def pair_features(spark, sf_dir, linkage=Linkage):
    """All features that need no Python."""
    return linkage(spark, sf_dir).features().select("sid", "eid", *[F.round(f, 6).alias(f) for f in _SQL_FEATURES])


# DuckDB compares bytes: letters that folding keeps beyond ASCII become single bytes first
_ONE_BYTE = "translate({}, 'ßæœøđłþðı', concat(chr(1), chr(2), chr(3), chr(4), chr(5), chr(6), chr(7), chr(8), chr(11)))"


@query(f"{_CAND}, {Q.FEATURES} select sid, eid, round(case when a_folded = '' and e_folded = '' then 1.0 else jaro_winkler_similarity({_ONE_BYTE.format('a_folded')}, {_ONE_BYTE.format('e_folded')}) end, 6) jaro_winkler from feat")
def feature_jaro_winkler(spark, sf_dir):
    run = Linkage(spark, sf_dir)
    name = lambda df, key, c: df.select(F.col("entity_id").alias(key), F.col("folded").alias(c))
    p = run.candidates.select("sid", "eid").join(name(run.s1_pre, "sid", "a"), "sid").join(name(run.pool_pre, "eid", "b"), "eid")
    return p.select("sid", "eid", F.round(S.jaro_winkler_udf("a", "b"), 6).alias("jaro_winkler"))


@query(None)
def feature_fuzzy(spark, sf_dir):
    """All seventeen features."""
    return Full(spark, sf_dir).features(fuzzy=True)


_COS = "cosine as (select sid, eid, round(1.0 / rank, 6) cosine from cand where rank <= 5)"


@query(f"{_CAND}, {Q.FEATURES}, {_COS} select f.sid, f.eid, coalesce(cosine, 0.0) cosine, round(idf_contain_fwd, 6) idf_contain_fwd, round(idf_contain_rev, 6) idf_contain_rev from feat f left join cosine c on f.sid = c.sid and f.eid = c.eid")
def feature_extended(spark, sf_dir):
    """The extended features; pairs without a dense hit have cosine 0."""
    run = Linkage(spark, sf_dir)
    cos = run.candidates.where("rank <= 5").select("sid", "eid", F.round(1.0 / F.col("rank"), 6).alias("cosine"))
    return run.features(cos).select("sid", "eid", "cosine", F.round("idf_contain_fwd", 6).alias("idf_contain_fwd"), F.round("idf_contain_rev", 6).alias("idf_contain_rev"))


@query(f"{_SCORED} select * from scored")
def linear_score(spark, sf_dir, linkage=Linkage):
    """Blocking, features and the fixed linear scorer, end to end; the flagship is its full form."""
    return linkage(spark, sf_dir).scored


_MODEL = tuple(f for f in FE.FEATURES if f != "jaro_winkler" and not f.startswith("rf_"))


def _training(spark, sf_dir, linkage=Linkage):
    run = linkage(spark, sf_dir)
    pairs = run.candidates.select("sid", "eid").join(run.gold.withColumn("label", F.lit(1)), ["sid", "eid"], "left").na.fill(0, ["label"])
    return run, run.compared("training", pairs, lambda f: f.withColumn("train", decide.in_training_part(F.col("sid"))))


@query(None)
def gbt_score(spark, sf_dir, linkage=Linkage, used=_MODEL, **more):
    _, f = _training(spark, sf_dir, linkage)
    model = models.fit_gbt(f.where("train"), used, **(more or {"rounds": 10, "depth": 5}))
    return models.score(model, f.where("not train"), used).select("sid", "eid", "label", "score")


@query(None)
def lr_score(spark, sf_dir, linkage=Linkage, used=_MODEL):
    _, f = _training(spark, sf_dir, linkage)
    return models.score(models.fit_lr(f.where("train"), used), f.where("not train"), used).select("sid", "eid", "label", "score")


@query(None)
def isotonic_calibration(spark, sf_dir):
    run = Full(spark, sf_dir)
    s = run.scored.join(run.gold.withColumn("label", F.lit(1.0)), ["sid", "eid"], "left").na.fill(0.0, ["label"])
    return models.calibrate(models.fit_isotonic(s), s).select("sid", "eid", "raw_score", "score")


@query(None)
def tabular_demo(spark, sf_dir):
    d = _table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice", (F.col("o_totalprice") > 150000).cast("double").alias("label"))
    return models.tabular_demo(d, ("o_orderpriority", "o_orderstatus"), ("o_totalprice",), "label")


# --- decisions -------------------------------------------------------------------------------------------------


@query(f"{_SCORED} select sid, eid, score, r as rank from (select *, row_number() over (partition by sid order by score desc, eid) r, max(score) over (partition by sid) best from scored) where best between 0.2 and 0.8 and r <= 20")
def uncertain_band(spark, sf_dir, linkage=Linkage):
    return decide.uncertain(linkage(spark, sf_dir).scored)


@query(f"{_CAND}, l as (select c.sid, c.eid, c.rank, cast(g.eid is not null as int) label from cand c left join gold g on c.sid = g.sid and c.eid = g.eid) select sid, eid, label from (select *, sum(label) over (partition by sid) pos, row_number() over (partition by sid, label order by rank) r from l) where label = 1 or r <= 2 * greatest(1, pos)")
def negative_sampling(spark, sf_dir, linkage=Linkage):
    run = linkage(spark, sf_dir)
    return decide.training_pairs(run.candidates, run.gold, 2)


_LINE = "array_to_string(list_filter([case when trim({0}.business_name) <> '' then 'COL name VAL ' || trim({0}.business_name) end, case when trim({0}.business_address) <> '' then 'COL address VAL ' || trim({0}.business_address) end, case when trim({0}.country) <> '' then 'COL country VAL ' || trim({0}.country) end], lambda x: x is not null), ' ')"


@query(
    f"""{_CAND}, l as (select c.sid, c.eid, c.rank, cast(g.eid is not null as int) label from cand c left join gold g on c.sid = g.sid and c.eid = g.eid),
    t as (select sid, eid, label from (select *, sum(label) over (partition by sid) pos, row_number() over (partition by sid, label order by rank) r from l) where label = 1 or r <= 5 * greatest(1, pos))
    select sid, eid, {_LINE.format("s1")} "left", {_LINE.format("pool")} "right", label from t join s1 on sid = s1.entity_id join pool on eid = pool.entity_id"""
)
def scorer_pairs(spark, sf_dir, linkage=Linkage):
    """Training pairs of a text-pair scorer, without noise."""
    run = linkage(spark, sf_dir)
    return models.scorer_pairs(decide.training_pairs(run.candidates, run.gold), run.s1, run.pool, augment_percent=0)


_GRID = tuple(range(5, 95, 2))


@query(
    f"""{_SCORED}, n as (select s1.entity_id sid, t, (select count(*) from gold g where g.sid = s1.entity_id) n_gold from s1, (select unnest(range(5, 95, 2)) t)),
    h as (select s.sid, t, count(*) n_pred, count(g.eid) tp from scored s join (select unnest(range(5, 95, 2)) t) on s.score * 100 >= t left join gold g on s.sid = g.sid and s.eid = g.eid group by s.sid, t)
    select cast(n.t as int) t, round(avg({Q.f05("coalesce(tp, 0)", "coalesce(n_pred, 0)", "n_gold")}), 6) macro_f05 from n left join h on n.sid = h.sid and n.t = h.t group by n.t"""
)
def threshold_sweep(spark, sf_dir, linkage=Linkage):
    run = linkage(spark, sf_dir)
    return decide.threshold_sweep(run.entities, run.scored, run.gold, _GRID)


_TWO = f"""{_SCORED}, {Q.STATS}, grid as (select mt, st from (select unnest(range(20, 81, 5)) mt), (select unnest(range(20, 96, 5)) st) where st >= greatest(mt, 40)),
  n as (select s1.entity_id sid, mt, st, (select count(*) from gold g where g.sid = s1.entity_id) n_gold from s1, grid),
  h as (select s.sid, mt, count(*) n_pred, count(g.eid) tp from scored s join (select distinct mt from grid) on s.score * 100 >= mt left join gold g on s.sid = g.sid and s.eid = g.eid group by s.sid, mt),
  two as (select cast(n.mt as int) mt, cast(n.st as int) st, round(avg({Q.f05("tp_", "np_", "n_gold")}), 6) macro_f05 from (
    select n.*, case when best * 100 >= {Q.eff("st")} then coalesce(n_pred, 0) else 0 end np_, case when best * 100 >= {Q.eff("st")} then coalesce(tp, 0) else 0 end tp_
    from n left join stat on n.sid = stat.sid left join h on n.sid = h.sid and n.mt = h.mt) n group by n.mt, n.st)"""


@query(f"{_TWO} select * from two")
def two_threshold_sweep(spark, sf_dir, linkage=Linkage):
    run = linkage(spark, sf_dir)
    return decide.two_threshold_sweep(run.entities, run.scored, run.gold)


@query(f"{_TWO} select * from two order by macro_f05 desc, mt, st limit 1")
def best_thresholds(spark, sf_dir, linkage=Linkage):
    run = linkage(spark, sf_dir)
    return decide.best_of(decide.two_threshold_sweep(run.entities, run.scored, run.gold), "mt", "st")


_DECIDED = f"{_SCORED}, {Q.STATS}, dec as (select r.* from (select sid, eid, score, row_number() over (partition by sid order by score desc, eid) rank from scored) r join stat on r.sid = stat.sid where best * 100 >= {Q.eff('70')} and score * 100 >= 50)"


@query(f"{_DECIDED} select sid, eid, score, rank from dec")
def decisions(spark, sf_dir, linkage=Linkage):
    run = linkage(spark, sf_dir)
    return decide.decide(run.entities, run.scored, 50, 70)


@query(f"{_SCORED} select sid, eid, case when r <= 3 and best between 0.2 and 0.8 then round(score * score, 6) else score end score from (select *, row_number() over (partition by sid order by score desc, eid) r, max(score) over (partition by sid) best from scored)")
def score_merge(spark, sf_dir, linkage=Linkage):
    """Scores of uncertain pairs replaced by those of a second scorer."""
    run = linkage(spark, sf_dir)
    second = decide.uncertain(run.scored, top_k=3).withColumn("score", F.round(F.col("score") * F.col("score"), 6))
    return decide.merge_scores(run.scored, second).select("sid", "eid", "score")


@query(f"{_DECIDED} select sid, eid from dec")
def closure_identity(spark, sf_dir, linkage=Linkage):
    run = linkage(spark, sf_dir)
    return decide.closure(decide.decide(run.entities, run.scored, 50, 70))


_LINKS = "l as (select x.entity_id x, y.entity_id y from p2 x join p2 y on x.country = y.country and x.name_sq = y.name_sq and x.name_sq <> '' and x.entity_id < y.entity_id)"
_COMPONENTS = f"recursive_l as (select x, y from l union all select y, x from l), reach(node, other) as (select x, x from recursive_l union select r.node, e.y from reach r join recursive_l e on r.other = e.x)"


def _name_links(run):
    key = run.pool_pre.where("name_sq <> ''").select("country", "name_sq", "entity_id")
    first = Window.partitionBy("country", "name_sq")
    linked = key.withColumn("x", F.min("entity_id").over(first)).where("x <> entity_id")
    return linked.select("x", F.col("entity_id").alias("y"), F.lit(1.0).alias("score"))


@query(f"with recursive {Q.PRECOMPUTED}, {_LINKS}, {_COMPONENTS} select node, min(other) component from reach group by node")
def components(spark, sf_dir):
    """Connected components of pool records with equal squashed names."""
    return graph.connected_components(_name_links(Linkage(spark, sf_dir)), "x", "y")


@query(
    f"""{_DECIDED.replace("with ", "with recursive ", 1)}, {_LINKS}, {_COMPONENTS}, comp as (select node, min(other) component from reach group by node),
    small as (select * from comp where component in (select component from comp group by component having count(*) <= 15)),
    sure as (select distinct sid, component from dec join small on eid = node where score >= 0.9)
    select sid, eid from dec union select sid, node from sure join small using (component)"""
)
def closure_linked(spark, sf_dir, linkage=Linkage):
    """Decisions closed over links between pool records."""
    run = linkage(spark, sf_dir)
    d = decide.decide(run.entities, run.scored, 50, 70)
    return decide.closure(d.select("sid", "eid", "score"), _name_links(run))


@query(f"{_DECIDED}, lists as (select sid, string_agg(eid, ',' order by rank, eid) ids from dec group by sid) select entity_id source1_entity_id, coalesce(ids, '') matched_entity_ids from s1 left join lists on entity_id = sid")
def submission_rows(spark, sf_dir, linkage=Linkage):
    run = linkage(spark, sf_dir)
    return tsv.result_rows(run.s1, decide.decide(run.entities, run.scored, 50, 70))


@query("select unnest(['missing_record', 'repeated_record', 'repeated_match', 'self_match', 'unknown_match', 'match_outside_candidates']) as rule, cast(0 as bigint) n")
def validator(spark, sf_dir, linkage=Linkage):
    run = linkage(spark, sf_dir)
    rows = tsv.result_rows(run.s1, decide.decide(run.entities, run.scored, 50, 70))
    return decide.violations(rows, run.s1, run.pool, run.candidates)


_FAULTY = "select sid, cast(substring(sid, 4) as bigint) d, string_split(ids, ',') ids from (select entity_id sid, coalesce(ids, '') || case when d % 5 = 0 then ',' || entity_id else '' end || case when d % 6 = 0 then ',S9-0' else '' end || case when d % 4 = 0 and ids is not null then ',' || string_split(ids, ',')[1] else '' end ids from (select entity_id, cast(substring(entity_id, 4) as bigint) d, (select string_agg(eid, ',' order by eid) from gold where sid = entity_id) ids from s1)) where cast(substring(sid, 4) as bigint) % 7 <> 0"


@query(
    f"""{_CAND}, once as ({_FAULTY}), r as (select * from once union all select * from once where d % 11 = 0), long as (select sid, unnest(ids) eid from r)
    select unnest(['missing_record', 'repeated_record', 'repeated_match', 'self_match', 'unknown_match', 'match_outside_candidates']) as rule, unnest([
      (select count(*) from s1 where entity_id not in (select sid from r)), (select count(*) from (select sid from r group by sid having count(*) > 1)),
      (select count(*) from r where len(ids) <> len(list_distinct(ids))), (select count(*) from long where sid = eid),
      (select count(*) from long where eid <> '' and eid not in (select entity_id from pool)), (select count(*) from long where eid <> '' and not exists (select 1 from cand c where c.sid = long.sid and c.eid = long.eid))]) n"""
)
def validator_faults(spark, sf_dir):
    """Broken rules of the true matches after records were lost and doubled, and own, unknown and repeated ids added."""
    run = Linkage(spark, sf_dir)
    d = F.substring("sid", 4, 20).try_cast("bigint")
    true = run.truth.select("sid", F.array_join(F.array_sort("gold"), ",").alias("ids")).where(d % 7 != 0)
    more = lambda when, c: F.when(when, F.concat(F.lit(","), c)).otherwise("")
    ids = F.concat("ids", more(d % 5 == 0, F.col("sid")), more(d % 6 == 0, F.lit("S9-0")), more((d % 4 == 0) & (F.col("ids") != ""), F.substring_index("ids", ",", 1)))
    rows = true.select(F.col("sid").alias("source1_entity_id"), ids.alias("matched_entity_ids"), (d % 11 == 0).alias("twice"))
    rows = rows.unionByName(rows.where("twice")).drop("twice")
    return decide.violations(rows, run.s1, run.pool, run.candidates)


@query("select doc_id, cast(('0x' || substr(md5(cast(doc_id as varchar)), 1, 4)) as bigint) % 100 < 70 train from documents")
def entity_split(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", decide.in_training_part(F.col("doc_id").cast("string")).alias("train"))


@query(f"with {Q.FIXTURE} select entity_id sid, country from s1 order by md5(concat(entity_id, ':42')), entity_id limit 100")
def seeded_sample(spark, sf_dir):
    return decide.sample(Linkage(spark, sf_dir).entities, "sid", 100)


# --- mining and exploration ------------------------------------------------------------------------------------


def _mine_sql(pattern, group, text="html", table="pages"):
    return f"select item, count(*) n_texts from (select unnest(list_distinct(regexp_extract_all({text}, {Q.q(pattern)}, {group}))) item from {table}) group by item"


@query(f"select * from ({_mine_sql(mining.URL, 0, 'url')}) where regexp_matches(lower(item), 'example|blog')")
def url_mining(spark, sf_dir):
    return mining.mine(_table(spark, sf_dir, "pages"), "url", mining.URL, 0, ("example", "blog"))


@query(_mine_sql(mining.OPERATION, 1, "concat('call(\"', c_mktsegment, '\")')", "customer"))
def operation_mining(spark, sf_dir):
    calls = _table(spark, sf_dir, "customer").select(F.concat(F.lit('call("'), "c_mktsegment", F.lit('")')).alias("script"))
    return mining.mine(calls, "script", mining.OPERATION, 1)


@query(_mine_sql(mining.PATH, 1))
def path_mining(spark, sf_dir):
    return mining.mine(_table(spark, sf_dir, "pages"), "html", mining.PATH, 1)


@query("select distinct a as first, b as second from (select unnest(regexp_extract_all(html, '<([a-z0-9]+) ([a-z]+)=', 1)) a, unnest(regexp_extract_all(html, '<([a-z0-9]+) ([a-z]+)=', 2)) b from pages)")
def pair_mining(spark, sf_dir):
    return mining.mine_pairs(_table(spark, sf_dir, "pages"), "html", "<([a-z0-9]+) ([a-z]+)=")


@query("select page_id, cast(p as bigint) as position, case when p >= 0 then substring(html, greatest(p - 80, 0) + 1, p + 120 - greatest(p - 80, 0)) else '' end context from (select page_id, html, instr(html, '<script>') - 1 p from pages)")
def text_context(spark, sf_dir):
    return mining.context(_table(spark, sf_dir, "pages"), "page_id", "html", "<script>")


@query(f"with {Q.FIXTURE} select 'S1' source, country, count(*) n from s1 group by country union all select left(entity_id, 2), country, count(*) from pool group by all")
def eda_sources(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.groupBy(F.substring("entity_id", 1, 2).alias("source"), "country").agg(F.count("*").alias("n"))


@query(f"with {Q.FIXTURE}, n as (select entity_id, count(gold.eid) k from s1 left join gold on entity_id = sid group by entity_id) select k n_matches, count(*) n from n group by k")
def eda_match_histogram(spark, sf_dir):
    return Linkage(spark, sf_dir).truth.groupBy(F.size("gold").cast("long").alias("n_matches")).agg(F.count("*").alias("n"))


@query(f"with {Q.FIXTURE} select count(*) filter (k = 0) n_singletons, round(avg(case when k = 0 then 1 else 0 end), 6) rate, max(k) most, round(avg(k), 6) mean_matches from (select entity_id, count(gold.eid) k from s1 left join gold on entity_id = sid group by entity_id)")
def singleton_rate(spark, sf_dir):
    t = Linkage(spark, sf_dir).truth.select(F.size("gold").alias("k"))
    none = F.when(F.col("k") == 0, 1).otherwise(0)
    return t.agg(F.sum(none).alias("n_singletons"), F.round(F.avg(none), 6).alias("rate"), F.max("k").cast("long").alias("most"), F.round(F.avg("k"), 6).alias("mean_matches"))


@query(f"{_DECIDED} select count(distinct sid) n_matched, count(distinct case when country = 'France' then sid end) n_france from dec join p1 on sid = entity_id")
def matched_counts(spark, sf_dir, linkage=Linkage):
    run = linkage(spark, sf_dir)
    m = decide.decide(run.entities, run.scored, 50, 70).join(run.entities, "sid").groupBy("sid").agg(F.first("country").alias("country"))
    return m.agg(F.count("*").alias("n_matched"), F.count(F.when(F.col("country") == "France", 1)).alias("n_france"))


@query("select o_orderpriority as value, count(*) n, round(count(*) / (select count(*) from orders), 6) share from orders group by all")
def value_counts(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    n = o.groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(o.agg(F.count("*").alias("total")))).select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row


@query("select count(*) filter (lang is null) lang, count(*) filter (source is null) source, count(*) filter (text is null) as text from documents")
def missing_counts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").agg(*[F.count_if(F.isnull(c)).alias(c) for c in ("lang", "source", "text")])


_REPORT = "count(*) filter (y and p) tp, count(*) filter (not y and p) fp, count(*) filter (y and not p) fn, count(*) filter (y = p) ok, count(*) n"


@query(f"select n, tp, fp, fn, round(ok / n, 6) accuracy, round(case when tp + fp > 0 then tp / (tp + fp) else 0.0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0.0 end, 6) recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end, 6) f1 from (select {_REPORT} from (select quality = 1 y, n_chars >= 1000 p from labels join documents using (doc_id)))")
def class_report(spark, sf_dir):
    d = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents"), "doc_id").withColumn("p", (F.col("n_chars") >= 1000).cast("int"))
    return metrics.class_report(d, "quality", "p")


@query(f"{_CAND} select cast(count(g.eid) as bigint) n_pos, count(*) - count(g.eid) n_neg, round((count(*) - count(g.eid)) / greatest(1, count(g.eid)), 6) scale_pos_weight from cand c left join gold g on c.sid = g.sid and c.eid = g.eid")
def class_balance(spark, sf_dir, linkage=Linkage):
    run = linkage(spark, sf_dir)
    return metrics.class_balance(run.candidates.join(run.gold.withColumn("label", F.lit(1)), ["sid", "eid"], "left").na.fill(0, ["label"]), "label")


@query("with k as (select n.n_nationkey, n.n_name, count(c.c_custkey) n from nation n left join customer c on n.n_nationkey = c.c_nationkey group by all) select n_name, n from k")
def lookup_join(spark, sf_dir):
    """Left join with a default, as record lookups do."""
    c = _table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return _table(spark, sf_dir, "nation").join(c, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("select conv_id, string_agg(role, '>' order by turn, role) roles from (select conv_id, role, min(turn) turn from conversations group by conv_id, role) group by conv_id")
def ordered_distinct(spark, sf_dir):
    """Distinct values in the order of their first appearance."""
    first = _table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("at"))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "role"))), lambda x: x.role), ">").alias("roles"))


# --- the same with all features, at the limits of full-size sources --------------------------------------------

for _f in (linear_score, decisions, submission_rows, run_summary, threshold_sweep, two_threshold_sweep, best_thresholds, uncertain_band, score_merge, closure_identity, closure_linked, validator, matched_counts):
    full(_f, Full)
for _f in (idf_overlap_candidates, uniform_candidates, posting_stats, capped_rate, macro_ceiling, hybrid_union, pair_features, negative_sampling, scorer_pairs, class_balance):
    full(_f, Full)
full(triple_union, Full, max_k=500)
# recall at 200 needs 200 candidates
full(candidate_recall_at_k, partial(Full, cap=200), ks=(25, 50, 100, 200))
full(recall_gate, partial(Full, cap=200), k=200)
full(gbt_score, Full, used=FE.FEATURES, rounds=500, depth=6)
full(lr_score, Full, used=FE.FEATURES)
