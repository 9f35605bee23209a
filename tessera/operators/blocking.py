"""Candidate generation: postings, IDF, IDF-weighted overlap joins, exact and hash-key joins, unions of candidate lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.runtime import Scratch, arrow_rows, join_by_size

CAP, MAX_POSTING = 150, 2000
#: Weights of shared name, address and house-number tokens.
NAME_WEIGHT, ADDR_WEIGHT, HOUSE_WEIGHT = 2.0, 1.2, 8.0
#: Ids in a row of a posting list; longer lists take several rows.
LIST_IDS = 4096
#: Hash keys of a record, and pairs of a key that a task makes at a time.
HASH_KEYS, CELL_PAIRS = 5, 1 << 23


def _tokens_long(pre: DataFrame, id_name: str) -> DataFrame:
    """One row per record, field and distinct token, from one scan."""
    tag = lambda fld, c: F.transform(c, lambda t: F.struct(F.lit(fld).alias("fld"), t.alias("token")))
    # a null name or address has no tokens and takes none from the other
    all_of = F.concat(*[F.coalesce(tag(fld, c), F.array().cast("array<struct<fld:string,token:string>>")) for fld, c in (("N", "name_set"), ("A", "addr_set"), ("H", "house_set"))])
    return pre.select(F.trim("country").alias("country"), F.col("entity_id").alias(id_name), F.explode(all_of).alias("p")).select("country", "p.fld", "p.token", id_name)


def postings(pool: DataFrame) -> DataFrame:
    """``country, fld, token, eid`` of precomputed pool records."""
    return _tokens_long(pool, "eid")


def posting_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("country", "fld", "token").agg(F.count("*").alias("n"))


def guarded(stats: DataFrame, max_posting: int = MAX_POSTING) -> DataFrame:
    """Tokens whose posting lists are used: house numbers always, others up to ``max_posting`` entries."""
    return stats.where((F.col("fld") == "H") | (F.col("n") <= max_posting))


def idf(pool: DataFrame) -> DataFrame:
    """``token, idf`` over name tokens: ln(records / (1 + occurrences)), every occurrence counting."""
    n = pool.agg(F.count("*").alias("n"))
    tf = pool.select(F.explode("name_list").alias("token")).groupBy("token").agg(F.count("*").alias("tf"))
    return tf.crossJoin(F.broadcast(n)).select("token", F.log(F.col("n") / (F.lit(1) + F.col("tf"))).alias("idf"))  # n is one row


def _weight(value: Column) -> Column:
    return F.when(F.col("fld") == "N", value * NAME_WEIGHT).when(F.col("fld") == "A", value * ADDR_WEIGHT).otherwise(F.lit(HOUSE_WEIGHT))


def _numbered(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """``eid, e``: each id once with its place in the order of ids."""
    runs = scratch.table(ids.distinct().orderBy("eid").withColumn("at", F.monotonically_increasing_id()), "ids")
    part = F.shiftright("at", 33)
    before, n = [], 0
    for r in runs.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        before.append((r["part"], n))
        n += r["n"]
    if n >= 1 << 31:
        raise ValueError("a pool of more than 2**31 ids")
    offsets = ids.sparkSession.createDataFrame(before, "part long, before long")
    # a row for each partition of the sort
    return runs.withColumn("part", part).join(F.broadcast(offsets), "part").select("eid", (F.col("at").bitwiseAND((1 << 33) - 1) + F.col("before")).cast("int").alias("e"))


def _best(cap: int):
    """Arrow function: rows (sid, w, es) in order of sid to each record's best ``cap`` by (score, id), with rank and whether there were more."""

    def ranked(sids, weights, lists):
        first = np.array([i for i in range(len(sids)) if i == 0 or sids[i] != sids[i - 1]])
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sids))))
        sizes = np.array([len(x) for x in lists])
        key = np.repeat(group << 32, sizes) | np.concatenate(lists)
        order = np.argsort(key, kind="stable")
        key, w = key[order], np.repeat(weights, sizes)[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        score, key = np.rint(np.add.reduceat(w, starts) * 1e6) / 1e6, key[starts]
        order = np.lexsort((key, -score, key >> 32))  # ids break ties
        key, score = key[order], score[order]
        group = key >> 32
        begun = np.searchsorted(group, np.arange(len(first)))
        rank = np.arange(len(group)) - begun[group] + 1
        more = np.diff(np.append(begun, len(group))) > cap
        keep = rank <= cap
        names = pa.array([sids[i] for i in first], pa.string()).take(pa.array(group[keep]))
        columns = [names, pa.array(key[keep] & 0x7FFFFFFF, pa.int32()), pa.array(score[keep], pa.float64()), pa.array(rank[keep], pa.int32()), pa.array(more[group[keep]], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["sid", "e", "score", "rank", "capped"])

    def run(batches):
        sids, weights, lists = [], [], []
        for batch in batches:
            column = batch.column("es")
            bounds, values = column.offsets.to_numpy(), column.values.to_numpy().astype(np.int64)
            sids += batch.column("sid").to_pylist()
            weights += batch.column("w").to_pylist()
            lists += [values[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            done = len(sids)
            while done and sids[done - 1] == sids[-1]:  # the last record may go on
                done -= 1
            if done:
                yield ranked(sids[:done], weights[:done], lists[:done])
                sids, weights, lists = sids[done:], weights[done:], lists[done:]
        if sids:
            yield ranked(sids, weights, lists)

    return run, "sid string, e int, score double, rank int, capped boolean"


def candidates(s1: DataFrame, pool: DataFrame, idf_table: DataFrame | None, cap: int = CAP, max_posting: int = MAX_POSTING) -> DataFrame:
    """``sid, eid, score, rank, capped``: pool records by the summed weight of shared tokens in the same country.

    Long posting lists are dropped before the join. A record's tokens meet whole posting lists of numbered ids, so that
    the shuffle has four bytes for each shared token, and one worker sums and ranks all partners of a record. Scores
    are rounded to six places, ties go to the smaller id. Without an IDF table all tokens weigh 1.
    """
    scratch, by = Scratch(pool.sparkSession, "candidates"), ["country", "fld", "token"]
    post = postings(pool)
    used = guarded(posting_stats(post), max_posting)
    if idf_table is not None:
        used = used.join(idf_table, "token", "left").select(*by, "n", _weight(F.coalesce("idf", F.lit(1.0))).alias("w"))
    else:
        used = used.withColumn("w", _weight(F.lit(1.0)))
    ids = _numbered(pool.select(F.col("entity_id").alias("eid")), scratch)
    numbered = post.join(ids.withColumnRenamed("eid", "id"), F.col("eid").eqNullSafe(F.col("id"))).select(*by, "e")
    chunk = F.pmod(F.xxhash64("e"), F.ceil(F.col("n") / LIST_IDS)).alias("chunk")
    lists = numbered.join(used, by).groupBy(*by, "w", chunk).agg(F.collect_list("e").alias("es"))
    asked = _tokens_long(s1, "sid").join(lists, by).select("sid", "w", "es")
    with arrow_rows(pool.sparkSession, 1000):
        run, schema = _best(cap)
        found = scratch.table(asked.repartition(F.col("sid")).sortWithinPartitions("sid").mapInArrow(run, schema), "found")
    return join_by_size(found, ids, ["e"], "inner", 24).select("sid", "eid", "score", "rank", "capped")


def top(pairs: DataFrame, cap: int) -> DataFrame:
    """The best ``cap`` partners of each record by (score, id), with whether there were more."""
    by = Window.partitionBy("sid").orderBy(F.desc("score"), "eid")
    ranked = pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= cap + 1)
    over = F.max("rank").over(Window.partitionBy("sid")) > cap
    return ranked.withColumn("capped", over).where(F.col("rank") <= cap)


def union_candidates(*lists: DataFrame, max_k: int | None = None, pool: DataFrame | None = None) -> DataFrame:
    """``sid, eid, rank``: the lists (sid, eid, rank) one behind the other, each id once, up to ``max_k``; ids
    outside ``pool`` are dropped."""
    tagged = None
    for i, c in enumerate(lists):
        part = c.select("sid", "eid", F.lit(i).alias("src"), F.col("rank").alias("at"))
        tagged = part if tagged is None else tagged.unionByName(part)
    if pool is not None:
        tagged = join_by_size(tagged, pool.select(F.col("entity_id").alias("eid")), ["eid"], "left_semi", 24)
    # dealt by record once, for the first places and for the ranks
    first = tagged.repartition(F.col("sid")).groupBy("sid", "eid").agg(F.min(F.struct("src", "at")).alias("at"))
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("sid").orderBy("at", "eid")))
    return out.select("sid", "eid", "rank") if max_k is None else out.where(F.col("rank") <= max_k).select("sid", "eid", "rank")


def exact_matches(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """``sid, pred``: pool records with the same plain name and address; records without address match nothing."""
    key = lambda df: df.withColumn("n", X.plain_key(F.col("business_name"))).withColumn("a", X.plain_key(F.col("business_address")))
    there = key(pool).where(F.trim("business_address") != "").groupBy("n", "a").agg(F.collect_set("entity_id").alias("pred"))
    return key(s1).join(there, ["n", "a"], "left").select(F.col("entity_id").alias("sid"), F.coalesce("pred", F.array().cast("array<string>")).alias("pred"))


def hash_keys(pre: DataFrame, id_name: str) -> DataFrame:
    """``keys`` of each record, null where a part is empty, for earlier blocking by equal ones: squashed name, house and street, house and city, whole address, first name token and city.

    Of several house numbers DuckDB's ``list_distinct`` names the one.
    """
    street, first = X.street_token(F.col("addr_set")), F.coalesce(F.get("name_set", F.lit(0)), F.lit(""))
    pre = pre.withColumn("house", F.coalesce(X.first_distinct(F.col("house_set")), F.lit("")))
    h = F.col("house")
    parts = [("NS", (F.col("name_sq"),)), ("HS", (h, street)), ("HC", (h, F.col("city"))), ("AD", (F.col("addr_sq"),)), ("FC", (first, F.col("city")))]
    keys = F.array(*[F.when(sum((F.when(c == "", 1).otherwise(0) for c in cols), F.lit(0)) == 0, F.concat_ws("|", F.lit(tag), F.trim("country"), *cols)) for tag, cols in parts])
    return pre.select(F.col("entity_id").alias(id_name), keys.alias("keys"))


def _by_key(records: DataFrame, id_name: str) -> DataFrame:
    """A row for each key of a record, with all its keys and their hashes as columns."""
    names = [f"{id_name}_{x}{i}" for x in "kh" for i in range(HASH_KEYS)]
    values = [F.get("keys", F.lit(i)) for i in range(HASH_KEYS)]
    flat = records.select(id_name, "keys", *[v.alias(n) for v, n in zip([*values, *(F.xxhash64(v) for v in values)], names, strict=True)])
    rows = flat.select(id_name, *names, F.posexplode("keys").alias("tag", "key")).where("key is not null")
    return rows.select("key", F.xxhash64("key").alias("kh"), "tag", id_name, *names)


def _dealt(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``cell``: keys of very many pairs are a square of cells, each with a share of either side."""
    n_left, n_right = (df.groupBy("kh").agg(F.count("*").alias(n)) for df, n in ((left, "n_left"), (right, "n_right")))
    side = F.ceil(F.sqrt(F.col("n_left") * F.col("n_right") / CELL_PAIRS))
    # one row for CELL_PAIRS pairs at most
    large = F.broadcast(n_left.join(n_right, "kh").select("kh", side.alias("side")).where("side > 1"))

    def cells(df, id_name, cell):
        cut = df.join(large, "kh", "left").withColumn("side", F.coalesce("side", F.lit(1).cast("bigint")))
        own = F.pmod(F.xxhash64(id_name), F.col("side"))
        return cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("side") - 1))).withColumn("cell", cell).drop("side", "own", "other")

    return cells(left, "sid", F.expr("own * side + other")), cells(right, "eid", F.expr("other * side + own"))


def hash_key_candidates(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """``sid, eid, n_keys``: pairs of records with a common key, and how many they have.

    A pair is made where its records meet at their first common key, which counts the others on the spot, so that pairs are
    never shuffled. Only those of ids that several records have are added up.
    """
    scratch = Scratch(pool.sparkSession, "hash-keys")
    a, b = scratch.table(hash_keys(s1, "sid"), "left"), scratch.table(hash_keys(pool, "eid"), "right")
    twice = [df.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(F.col(c).alias("twice")) for df, c in ((a, "sid"), (b, "eid"))]
    if all(t.isEmpty() for t in twice):
        return _met_once(a, b)
    (a1, a2), (b1, b2) = (
        [df.join(t, F.col(c).eqNullSafe(F.col("twice")), how) for how in ("left_anti", "left_semi")] for df, c, t in ((a, "sid", twice[0]), (b, "eid", twice[1]))
    )
    rows = lambda df, c: df.select(c, F.explode(F.array_compact("keys")).alias("key"))
    several = rows(a2, "sid").join(rows(b, "eid"), "key").unionByName(rows(a1, "sid").join(rows(b2, "eid"), "key"))
    return _met_once(a1, b1).unionByName(several.groupBy("sid", "eid").agg(F.count("*").alias("n_keys")))


def _met_once(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = _dealt(_by_key(a, "sid"), _by_key(b, "eid"))
    met = left.join(right.withColumnRenamed("tag", "tag_"), ["kh", "cell", "key"])
    # texts are compared where hashes are equal
    same = [F.coalesce((F.col(f"sid_h{i}") == F.col(f"eid_h{i}")) & (F.col(f"sid_k{i}") == F.col(f"eid_k{i}")), F.lit(False)) for i in range(HASH_KEYS)]
    first = F.lit(HASH_KEYS)
    for i in reversed(range(HASH_KEYS)):
        first = F.when(F.lit(i) == F.col("tag"), i).when(same[i], i).otherwise(first)
    n_keys = sum((F.when(x, 1).otherwise(0) for x in same[1:]), F.when(same[0], 1).otherwise(0))
    return met.where(first == F.col("tag")).select("sid", "eid", n_keys.cast("bigint").alias("n_keys"))
