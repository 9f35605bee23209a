"""Building blocks of the oracle: the same definitions as DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from tessera.functions import lexicon as L
from tessera.functions.text import EMAIL, HANDLE, HASHTAG


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def clean_noise(e: str) -> str:
    return reduce(lambda x, p: f"regexp_replace({x}, {q(p)}, ' ', 'g')", (EMAIL, HANDLE, HASHTAG), e)


def fold(e: str) -> str:
    e = f"replace(replace({e}, {q(chr(0xFFFD))}, ' '), '&', ' and ')"
    e = reduce(lambda x, kv: f"replace({x}, {q(kv[0])}, {q(kv[1])})", L.FOLD_LONG.items(), e)
    return f"lower(translate({e}, {q(L.FOLD_FROM)}, {q(L.FOLD_TO)}))"


def tokens(e: str) -> str:
    return f"regexp_extract_all({fold(e)}, '[a-z0-9]+')"


def name_tokens(e: str) -> str:
    e = f"regexp_replace({clean_noise(e)}, 'https?://|www\\.', ' ', 'g')"
    for _ in range(2):
        e = f"regexp_replace({e}, '(?i)\\.(com|in|fr|net|org|co|io)($|[^\\p{{L}}\\p{{N}}_])', ' \\2', 'g')"
    drop = _list((*L.SUFFIXES, *L.NOISE_WORDS))
    return f"list_filter({tokens(e)}, lambda t: not list_contains({drop}, t) and not regexp_full_match(t, '[0-9]+'))"


def house_numbers(e: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({e}, '\\p{{Nd}}+'), lambda m: case when ltrim(m, '0') = '' then '0' else ltrim(m, '0') end))"


def addr_tokens(e: str) -> str:
    regions = "map(" + _list(L.REGION) + ", " + _list(L.REGION.values()) + ")"
    named = f"list_transform({tokens(e)}, lambda t: coalesce({regions}[t], t))"
    return f"list_filter({named}, lambda t: not list_contains({_list(L.ADDR_STOP)}, t) and not regexp_full_match(t, '[0-9]+') and length(t) >= 2)"


def plain_key(e: str) -> str:
    return f"trim(regexp_replace(lower({e}), '\\s+', ' ', 'g'))"


def grams(e: str, n: int = 3) -> str:
    return f"list_distinct(list_transform(range(1, greatest(1, length({e}) - {n - 1}) + 1), lambda i: substring({e}, i, {n})))"


def joined(e: str) -> str:
    """A list as text that any engine writes alike."""
    return f"coalesce(array_to_string({e}, ' '), '')"


_UP = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"

#: CTEs: b, s1, pool, gold (sid, eid).
FIXTURE = f"""
b as (
  select doc_id, case lang when 'en' then 'US' when 'fr' then 'France' else 'India' end as country,
         coalesce(w[1], '') a1, coalesce(w[2], '') a2, coalesce(w[3], '') a3, coalesce(w[4], '') s1, coalesce(w[5], '') s2, coalesce(w[6], '') s3,
         cast((doc_id * 37) % 9000 + 1 as varchar) hn,
         case doc_id % 5 when 0 then 'Inc' when 1 then 'LLC' when 2 then 'SARL' when 3 then 'Pvt Ltd' else '' end sfx
  from (select doc_id, lang, string_split(replace(text, chr(10), ' '), ' ') w from documents)),
s1 as (
  select concat('S1-', cast(doc_id as varchar)) entity_id, trim(concat(a1, ' ', a2, ' ', a3, ' ', sfx)) business_name,
         concat(hn, ' ', s1, ' ', s2, ' Street, ', s3) business_address, country from b),
pool as (
  select concat(case when v < 2 then 'S2-' else 'S3-' end, cast(doc_id * 4 + v as varchar)) entity_id,
    case when v = 0 and doc_id % 10 = 3 then trim(concat({_UP.format("a1")}, '  ', a2, ' ', a3, ' ', sfx))
         when v = 0 then concat({_UP.format("a1")}, ' ', {_UP.format("a2")}, ' ', a3) when v = 1 then concat(a2, ' ', a1, ' ', a3, ' & Co')
         when v = 2 then concat('www.', a1, a2, '.com ', a3) else concat(a1, ' ', a3) end business_name,
    case when v = 0 and doc_id % 10 = 3 then concat(hn, ' ', s1, ' ', s2, ' Street, ', s3)
         when v = 0 then concat('#00', hn, ' ', s1, ' ', s2, ' St ', s3) when v = 1 then concat('Unit ', hn, ', ', s1, ' ', s3)
         when v = 2 then '' else concat(s3, ' ', hn, ' ', s2, ' Rd') end business_address, country
  from b, (select unnest([0, 1, 2, 3]) v) x where doc_id % 18 <> 0 and (doc_id + v) % 7 <> 0),
gold as (
  select concat('S1-', cast(doc_id as varchar)) sid, concat(case when v < 2 then 'S2-' else 'S3-' end, cast(doc_id * 4 + v as varchar)) eid
  from b, (select unnest([0, 1, 2, 3]) v) x where doc_id % 18 <> 0 and (doc_id + v) % 7 <> 0)
"""


def _pre(name: str, src: str) -> str:
    return f"""
{name} as (
  select entity_id, trim(country) country, nl name_list, list_distinct(nl) name_set, array_to_string(nl, '') name_sq, hs house_set,
         array_to_string(al, '') addr_sq, list_distinct(al) addr_set, coalesce(al[-1], '') city, folded
  from (select entity_id, country, {name_tokens("business_name")} nl, {addr_tokens("business_address")} al,
               {house_numbers("business_address")} hs, {fold("business_name")} folded from {src}))
"""


#: Adds p1 and p2, the precomputed records of both sources.
PRECOMPUTED = FIXTURE + "," + _pre("p1", "s1") + "," + _pre("p2", "pool")


def _long(name: str, src: str, key: str) -> str:
    part = lambda f, c: f"select country, '{f}' fld, unnest({c}) as token, entity_id {key} from {src}"
    return f"{name} as ({part('N', 'name_set')} union all {part('A', 'addr_set')} union all {part('H', 'house_set')})"


#: Adds post, stats, idf, asked.
POSTINGS = (
    PRECOMPUTED
    + ","
    + _long("post", "p2", "eid")
    + ", stats as (select country, fld, token, count(*) n from post group by all)"
    + ", idf as (select token, ln((select count(*) from p2) / (1 + tf)) idf from (select token, count(*) tf from (select unnest(name_list) as token from p2) group by token)),"
    + _long("asked", "p1", "sid")
)


def candidates(cap: int, max_posting: int, uniform: bool = False, name: str = "cand") -> str:
    """Adds ``name`` (sid, eid, score, rank, capped)."""
    w = "1.0" if uniform else "coalesce(idf.idf, 1.0)"
    return f"""
{name}_pairs as (
  select a.sid, p.eid, round(sum(case a.fld when 'N' then {w} * 2.0::double when 'A' then {w} * 1.2::double else 8.0::double end), 6) score
  from asked a join (select * from stats where fld = 'H' or n <= {max_posting}) s on a.country = s.country and a.fld = s.fld and a.token = s.token
       left join idf on a.token = idf.token join post p on a.country = p.country and a.fld = p.fld and a.token = p.token
  group by a.sid, p.eid),
{name} as (
  select sid, eid, score, r as rank, n > {cap} capped
  from (select *, row_number() over (partition by sid order by score desc, eid) r, count(*) over (partition by sid) n from {name}_pairs) where r <= {cap})
"""


#: Adds feat over cand, with all features that SQL can express; fuzzy ones are 0.
FEATURES = """
freq as (select country, name_sq, count(*) freq from p1 group by all),
tok1 as (select entity_id, t token, coalesce(idf.idf, 1.0) w from (select entity_id, unnest(name_set) t from p1) left join idf on t = idf.token),
tok2 as (select entity_id, t token, coalesce(idf.idf, 1.0) w from (select entity_id, unnest(name_set) t from p2) left join idf on t = idf.token),
sum1 as (select entity_id, sum(w) s, sqrt(sum(w * w)) n from tok1 group by entity_id),
sum2 as (select entity_id, sum(w) s, sqrt(sum(w * w)) n from tok2 group by entity_id),
both_ as (select c.sid, c.eid, count(*) k, sum(x.w) s, sum(x.w * x.w) ss from cand c join tok1 x on c.sid = x.entity_id join tok2 y on c.eid = y.entity_id and x.token = y.token group by c.sid, c.eid),
feat as (
  select c.sid, c.eid, c.score as block_score,
    case when coalesce(b.k, 0) = 0 then 0.0 when f.s + r.s - b.s > 0 then b.s / (f.s + r.s - b.s) else 0.0 end idf_name_jac,
    case when len(a.name_set) > 0 then coalesce(b.k, 0) / len(a.name_set) else 0.0 end name_contain,
    case when a.name_sq = '' or e.name_sq = '' then 0.0 else len(list_intersect({ga}, {ge})) / len(list_distinct(list_concat({ga}, {ge}))) end char_sim,
    cast(list_has_any(a.house_set, e.house_set) as double) house_agree,
    case when len(a.addr_set) = 0 or len(e.addr_set) = 0 then 0.0 else len(list_intersect(a.addr_set, e.addr_set)) / len(list_distinct(list_concat(a.addr_set, e.addr_set))) end addr_jac,
    cast(length(a.addr_sq) >= 8 and a.addr_sq = e.addr_sq as double) addr_exact,
    cast(a.city <> '' and a.city = e.city as double) city_agree,
    cast(coalesce(q.freq, 1) < 4 as double) name_rare,
    case when a.name_sq = '' or e.name_sq = '' then 0.0 else least(length(a.name_sq), length(e.name_sq)) / greatest(length(a.name_sq), length(e.name_sq)) end name_len_ratio,
    0.0 jaro_winkler,
    case when coalesce(b.k, 0) = 0 or f.n * r.n = 0 then 0.0 else b.ss / (f.n * r.n) end tfidf_cos,
    0.0 rf_token_sort, 0.0 rf_token_set, 0.0 rf_partial, 0.0 rf_addr_sort,
    ln(1.0 / greatest(coalesce(q.freq, 1), 1) + 1) name_rarity_log,
    case when coalesce(f.s, 0) > 0 then coalesce(b.s, 0) / f.s else 0.0 end idf_contain_fwd,
    case when coalesce(r.s, 0) > 0 then coalesce(b.s, 0) / r.s else 0.0 end idf_contain_rev,
    a.folded a_folded, e.folded e_folded
  from cand c join p1 a on c.sid = a.entity_id join p2 e on c.eid = e.entity_id
    left join freq q on a.country = q.country and a.name_sq = q.name_sq
    left join sum1 f on c.sid = f.entity_id left join sum2 r on c.eid = r.entity_id left join both_ b on c.sid = b.sid and c.eid = b.eid)
""".format(ga=grams("('  ' || a.name_sq || ' ')"), ge=grams("('  ' || e.name_sq || ' ')"))

#: Adds scored (sid, eid, score) with probabilities of the fixed linear scorer.
SCORED = (
    FEATURES
    + ", scored as (select sid, eid, round(1 / (1 + exp(-("
    + str(L.LINEAR_BIAS)
    + "".join(f" + {w}::double * {c}" for c, w in zip(("idf_name_jac", "name_contain", "char_sim", "house_agree", "addr_jac", "addr_exact", "city_agree", "name_rare", "name_len_ratio", "jaro_winkler", "tfidf_cos"), L.LINEAR_WEIGHTS, strict=False))
    + "))), 6) score from feat)"
)

#: Adds stat (sid, country, best, gap) over scored.
STATS = """
stat as (
  select s.sid, country, best, gap from (
    select sid, max(score) best, max(case when r = 1 then score end) - max(case when r = 2 then score end) gap
    from (select *, row_number() over (partition by sid order by score desc, eid) r from scored) group by sid) s join p1 on s.sid = p1.entity_id)
"""


def eff(st: str) -> str:
    return f"greatest({st} + case when lower(trim(country)) = 'france' then 10 else 0 end, {st} + case when gap < 0.05 then 10 else 0 end)"


def f05(tp: str, n_pred: str, n_gold: str) -> str:
    return f"(case when {n_pred} = 0 and {n_gold} = 0 then 1.0 when {tp} = 0 then 0.0 else 1.25 * ({tp} / {n_pred}) * ({tp} / {n_gold}) / (0.25 * ({tp} / {n_pred}) + ({tp} / {n_gold})) end)"
