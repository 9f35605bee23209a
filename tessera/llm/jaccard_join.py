"""N-gram Jaccard join by a token-group matrix.

1. Every text becomes its set of distinct word shingles (64-bit hashes). Equal sets collapse into one
   *class*, so exact copies never meet each other again.
2. Classes that could link are found without counting pairs. If two sets of sizes a and b have a Jaccard
   similarity of P percent or more, they differ in at most k = (a+b)(100-P)/(100+P) shingles. The shingle
   universe is dealt by hash into more than k parts, so some parts hold the same shingles in both
   sets: classes are keyed by the digests of their parts. The number of parts depends on the size of the
   smaller set, in windows of sizes that a partner may lie beyond. There are enough spare parts for empty ones
   to be left out. Large sets get a few parts more, so that linked sets share several of their window: classes
   that share fewer, as by a passage that many texts quote, are out.
   Parts meet in ``ROUNDS`` rounds, by their digest, so only a share of them is ever being shuffled.
3. Classes that share parts are partitioned into groups of similar documents. A group has at most
   ``GROUP_CLASSES`` classes and about ``GROUP_TOKENS`` shingles; larger ones are split by hash.
   The *token-group matrix* stores, per group, its members' shingles and their union. Overlaps within a group
   are counted exactly.
4. A class that shares parts with another group is a query to it: its overlap with the group's union bounds its
   overlap with every member, and only groups that still qualify are opened and compared exactly.

Components need no two classes compared that are connected already. So two classes of each component in a group first
ask a neighbour among the groups that share a part, which joins what is alike; then classes ask every other group that could still connect
them with something. Where most classes that share a part are one component only the others ask. m near copies of
one text thus take work in proportion to m, not to its square. Nothing is capped or sampled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.batches import released, slices
from tessera.llm.shingles import mix, shingle_sets
from tessera.operators.graph import connected_components
from tessera.runtime import Scratch, arrow_rows, join_by_size

GROUP_CLASSES = 2048
GROUP_TOKENS = 1 << 20
ROUNDS = 4
#: Keys of classes that a task remembers, so as to send a class's parts or shingles once.
REMEMBERED = 1 << 17
_U = np.uint64
_RATIO = 1.6
#: Windows of sizes that a digest can name.
WINDOWS = 64
_COLUMNS = 1 << 10
_ROWS = 128


class PartPlan:
    """Which partitions of the shingle universe a set of a given size is keyed by."""

    def __init__(self, percent: int):
        if not 50 <= percent < 100:
            raise ValueError("the similarity is 50 to 99 percent")
        self.percent = percent
        self.edges = [1]
        while self.edges[-1] < 1 << 32:  # no text has so many words; fewer than WINDOWS edges
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * _RATIO)))
        self._own: dict[int, tuple[int, int, int, int] | None] = {}

    def _window(self, i: int) -> tuple[int, int, int, int] | None:
        """(identity, parts, spare parts, parts that linked sets share at least); None if only equal sets can link.

        It serves pairs whose smaller set has ``edges[i]`` to ``edges[i + 1] - 1`` shingles.
        """
        if i not in self._own:
            most = self.edges[i + 1] - 1
            total = most + most * 100 // self.percent
            k = total * (100 - self.percent) // (100 + self.percent)
            share = max(4, total // 200) if total >= 200 else 1
            n = k + share
            empty = n * math.exp(-self.edges[i] / n)
            spare = int(empty + 3 * math.sqrt(empty)) + 1
            self._own[i] = (i, n + spare, spare, share) if k else None
        return self._own[i]

    def of(self, size: int) -> list[tuple[int, int, int, int]]:
        """The windows in which a set of this size may be the smaller or the larger of a linked pair."""
        i = int(np.searchsorted(self.edges, size, side="right")) - 1
        out = [self._window(i)]
        while i > 0 and size * self.percent <= 100 * (self.edges[i] - 1):
            i -= 1
            out.append(self._window(i))
        return [x for x in out if x]

    def shares(self) -> list[int]:
        """For each window, how many of its parts the two sets of a pair that it serves share at least."""
        return [(self._window(i) or (0, 0, 0, 1))[3] for i in range(len(self.edges) - 1)]


def part_digests(tokens: np.ndarray, plan: PartPlan) -> np.ndarray:
    """Sorted digests of the parts that a set is keyed by; their last six bits are the window."""
    out = []
    spread = mix(tokens, 77)
    for ident, parts, spare, _ in plan.of(len(tokens)):
        part = (mix(tokens, ident + 1) % _U(parts)).astype(np.int64)
        sums = np.zeros(parts, _U)
        np.add.at(sums, part, spread)
        full = np.bincount(part, minlength=parts) > 0
        use = np.flatnonzero(full) if parts - full.sum() <= spare else np.arange(parts)
        digests = mix(mix(sums[use], ident + 1) + use.astype(_U), parts)
        out.append(digests & ~_U(WINDOWS - 1) | _U(ident))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, _U)


def _set_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _once(seen: set[int], key: int) -> bool:
    """True if the key is new to the bounded set of remembered ones; repeats that slip through are merged later."""
    if key in seen:
        return False
    if len(seen) >= REMEMBERED:
        seen.clear()
    seen.add(key)
    return True


def _keyed(n: int, percent: int):
    """Arrow function: (doc_id, h, text) to (doc_id, h, n_shingles, key, parts by round); parts once a class and task."""
    lists = [f"parts{r}" for r in range(ROUNDS)]
    cuts = np.array([(r << 64) // ROUNDS for r in range(1, ROUNDS)], _U)

    def run(batches):
        plan, seen = PartPlan(percent), set()
        for batch in batches:
            sizes, keys, values, ends = [], [], [[] for _ in lists], [[0] for _ in lists]
            for tokens in shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), n):
                key = _set_key(tokens) if len(tokens) else 0
                sizes.append(len(tokens))
                keys.append(key)
                digests = part_digests(tokens, plan) if len(tokens) and _once(seen, key) else np.zeros(0, _U)
                for r, own in enumerate(np.split(digests, np.searchsorted(digests, cuts))):
                    values[r].append(own.view(np.int64))
                    ends[r].append(ends[r][-1] + len(own))
            parts = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(np.concatenate([*v, np.zeros(0, np.int64)]))) for v, e in zip(values, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), *parts], names=["doc_id", "h", "n_shingles", "key", *lists])

    return run, "doc_id bigint, h bigint, n_shingles bigint, key bigint, " + ", ".join(f"{x} array<bigint>" for x in lists)


def _tokens_of(n: int):
    """Arrow function: texts of wanted classes to their shingles. A text that shares id and hash with a wanted one is not taken for it."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            sets = list(shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), n))
            keys = [_set_key(s) if len(s) else 0 for s in sets]
            ok = [k == w and _once(seen, k) for k, w in zip(keys, batch.column("key").to_pylist(), strict=True)]
            arrays = [pa.array(keys, pa.int64()), batch.column("grp"), batch.column("mult"), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "grp", "mult", "tokens"]).filter(pa.array(ok, pa.bool_()))

    return run, "key bigint, grp bigint, mult bigint, tokens binary"


def _unions(batches):
    """Adds each group's token union: a row of the token-group matrix."""
    for batch in batches:
        unions = []
        for members in batch.column("members").to_pylist():
            # a single class is its own union
            unions.append(np.unique(np.frombuffer(b"".join(m["tokens"] for m in members), _U)).tobytes() if len(members) > 1 else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(unions, pa.binary())], names=[*batch.schema.names, "token_union"])


def _overlap(queries: list[np.ndarray], union: np.ndarray) -> np.ndarray:
    """How many shingles of each query the union holds."""
    if not len(union) or not queries:
        return np.zeros(len(queries), np.int64)
    flat = np.concatenate(queries)
    at = np.searchsorted(union, flat)
    hit = union[np.minimum(at, len(union) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, queries)])[:-1])


def _inside(a: list[np.ndarray], b: list[np.ndarray], common: np.ndarray | None = None) -> np.ndarray:
    """Exact overlaps of all sets of ``a`` with all sets of ``b``; ``common`` are the shingles of both sides, if known."""
    fa, fb = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(fa, fb) if common is None else common
    out = np.zeros((len(a), len(b)), np.float32)
    left, right = _places(a, fa, common), _places(b, fb, common)
    for lo in range(0, len(common), _COLUMNS):
        width, sides = min(_COLUMNS, len(common) - lo), []
        for at, rows, count in ((*left, len(a)), (*right, len(b))):
            i, j = np.searchsorted(at, (lo, lo + width))
            m = np.zeros((count, width), np.float32)
            m[rows[i:j], at[i:j] - lo] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _places(sets: list[np.ndarray], flat: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place in ``common`` of each shingle of the sets that it holds, in order, and the set's number."""
    if not len(common):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
    hit = np.flatnonzero(common[at] == flat)
    at = at[hit].astype(np.int32)
    order = np.argsort(at, kind="stable")
    return at[order], np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])[hit[order]]


def _linked(a: list[np.ndarray], b: list[np.ndarray], percent: int, common: np.ndarray | None = None) -> np.ndarray:
    both, links = _inside(a, b, common), np.zeros((len(a), len(b)), bool)
    na, nb = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None, :]
    for rows in _blocks(len(a)):
        k = both[rows].astype(np.int64)
        links[rows] = 100 * k >= percent * (na[rows] + nb - k)
    return links


def _blocks(n: int):
    """Rows of a matrix that are widened to whole numbers together."""
    return (slice(lo, lo + _ROWS) for lo in range(0, n, _ROWS))


def _probe(queries: list[np.ndarray], members: list[np.ndarray], union: np.ndarray, percent: int) -> np.ndarray:
    """Which queries link with which members of a group; if no query's bound qualifies the group stays closed."""
    links = np.zeros((len(queries), len(members)), bool)
    ask = np.flatnonzero(100 * _overlap(queries, union) >= percent * np.array([len(x) for x in queries]))
    if len(ask):
        links[ask] = _linked([queries[i] for i in ask], members, percent)
    return links


def _own_links(members: list[np.ndarray], percent: int) -> np.ndarray:
    """Which members of a group link with each other. A member's bound is what it shares with the union of the others."""
    links = np.zeros((len(members), len(members)), bool)
    size, left = np.array([len(x) for x in members]), np.arange(len(members))
    while len(left) > 1:
        flat = np.concatenate([members[i] for i in left])
        values, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.add.reduceat((count[at] > 1).astype(np.int64), np.cumsum([0, *size[left]])[:-1])
        ask = left[100 * shared >= percent * size[left]]
        if len(ask) == len(left):
            links[np.ix_(left, left)] = _linked([members[i] for i in left], [members[i] for i in left], percent, values[count > 1])
            break
        left = ask
    np.fill_diagonal(links, False)
    return links


def _roots(links: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and the columns of a link matrix the smallest node reached; columns follow the rows unless same."""
    na, nb = links.shape
    left, right = np.arange(na), np.arange(nb) + (0 if same else na)
    big = na + nb
    while True:
        r = right
        for rows in _blocks(na):
            r = np.minimum(r, np.where(links[rows], left[rows][:, None], big).min(axis=0))
        if same:
            r = np.minimum(r, r[r])
            done, left, right = np.array_equal(r, right), r, r
        else:
            new = np.concatenate([np.minimum(left[rows], np.where(links[rows], r[None, :], big).min(axis=1)) for rows in _blocks(na)])
            done, left, right = np.array_equal(r, right) and np.array_equal(new, left), new, r
        if done:
            return left, right


def _compare(percent: int):
    """Arrow function over groups with queries, or without for their own members: one row per linked class with its links there and a root."""

    def load(members):
        return [m["key"] for m in members], [m["mult"] for m in members], [np.frombuffer(m["tokens"], _U) for m in members]

    def run(batches):
        for batch in batches:
            keys, counts, roots = [], [], []
            for row in (x for one in slices([batch], 1) for x in one.to_pylist()):
                same = row["queries"] is None
                kb, mb, sb = load(row["members"])
                ka, ma, sa = (kb, mb, sb) if same else load(row["queries"])
                union = None if same else sb[0] if row["token_union"] is None else np.frombuffer(row["token_union"], _U)
                links = _own_links(sb, percent) if same else _probe(sa, sb, union, percent)
                if not links.any():
                    continue
                left, right = _roots(links, same)
                names = ka if same else ka + kb
                for own, deg, root in ((ka, links @ np.array(mb), left), *([] if same else [(kb, links.T @ np.array(ma), right)])):
                    for i in np.flatnonzero(deg):
                        keys.append(own[i])
                        counts.append(int(deg[i]))
                        roots.append(names[root[i]])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(roots, pa.int64())], names=["key", "links", "root"])

    return run, "key bigint, links bigint, root bigint"


_MEMBERS = "array<struct<key:bigint,mult:bigint,tokens:binary>>"


@dataclass
class _Join:
    """The steps of a join over the classes of ``docs``."""

    scratch: Scratch
    percent: int

    def enough(self, parts: str, sides: int = 1) -> Column:
        """True if so many parts of a window are as many as a linked pair shares, or the larger of two ``sides`` of these."""
        shares = F.array(*[F.lit(x) for x in PartPlan(self.percent).shares()])
        return F.col(parts) * sides >= F.element_at(shares, (F.col("window") + 1).cast("int"))

    def shared_parts(self, keyed: DataFrame) -> DataFrame:
        """``home, last, window, key, parts``: how many parts of a round a class shares with others, by the least and the greatest class that have them.

        The two ends of a part are a grouped aggregate, which absorbs parts of very many classes before the shuffle.
        """
        found, by = [], ["home", "last", "window", "key"]
        for r in range(ROUNDS):
            long = keyed.select("key", F.explode(f"parts{r}").alias("part"))
            ends = long.groupBy("part").agg(F.min("key").alias("home"), F.max("key").alias("last")).where("home <> last")
            rows = long.join(ends, "part").withColumn("window", F.col("part").bitwiseAND(WINDOWS - 1))
            found.append(self.scratch.table(rows.groupBy(*by).agg(F.count("*").alias("parts")), f"shared{r}"))
        shared = found[0]
        for more in found[1:]:
            shared = shared.unionByName(more)
        return shared

    def members(self, shared: DataFrame) -> DataFrame:
        """``bucket, home, window, key, parts``: classes that share enough parts of a window, and with whom."""
        shared = shared.repartition("key", "window")  # the aggregation and the window below keep it
        shared = shared.groupBy("home", "last", "window", "key").agg(F.sum("parts").alias("parts"))
        kept = shared.withColumn("all_parts", F.sum("parts").over(Window.partitionBy("key", "window"))).where(self.enough("all_parts"))
        kept = self.scratch.table(kept.select(F.xxhash64("home", "last", "window").alias("bucket"), "home", "window", "key", "parts"), "kept")
        for r in range(ROUNDS):
            self.scratch.drop(f"shared{r}")
        alive = kept.groupBy("bucket").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("bucket")
        members = self.scratch.table(kept.join(alive, "bucket", "left_semi"), "members")
        self.scratch.drop("kept")
        return members

    def grouped(self, members: DataFrame, classes: DataFrame) -> DataFrame:
        """``key, doc_id, h, n, mult, grp`` of the classes in buckets."""
        home = members.groupBy("key").agg(F.min("home").alias("home"))
        for _ in range(2):  # let neighbouring groups flow together
            bucket_home = members.select("bucket", "key").join(home, "key").groupBy("bucket").agg(F.min("home").alias("home"))
            home = members.select("bucket", "key").join(bucket_home, "bucket").groupBy("key").agg(F.min("home").alias("home"))
        sized = self.scratch.table(home.join(classes, "key"), "sized")
        slices = sized.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / GROUP_CLASSES), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("slices"))
        sized = sized.join(slices, "home").withColumn("grp", F.xxhash64("home", F.pmod(F.xxhash64("key"), F.col("slices")))).drop("home", "slices")
        grouped = self.scratch.table(sized, "grouped")
        self.scratch.drop("sized")
        return grouped

    def seats(self, members: DataFrame, grouped: DataFrame) -> DataFrame:
        """``bucket, window, key, parts, n, grp``: classes in buckets of several groups. Buckets of the same groups are one."""
        seats = members.select("bucket", "window", "key", "parts").join(grouped.select("key", "n", "grp"), "key")
        mark = seats.select("bucket", "grp").distinct().groupBy("bucket").agg(F.count("*").alias("groups"), F.expr("bit_xor(xxhash64(grp))").alias("mark"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
        mark = mark.where("groups > 1").select("bucket", F.xxhash64("groups", "mark", "lo", "hi").alias("several"))
        seats = seats.join(mark, "bucket").groupBy(F.col("several").alias("bucket"), "window", "key").agg(F.sum("parts").alias("parts"), F.first("n").alias("n"), F.first("grp").alias("grp"))
        return self.scratch.table(seats, "seats")

    def matrix(self, base: DataFrame, grouped: DataFrame, n: int) -> DataFrame:
        """``grp, members, token_union``: the token-group matrix."""
        spark = base.sparkSession
        wanted = grouped.select(F.coalesce("doc_id", F.lit(-1)).alias("wanted_id"), F.col("h").alias("wanted_h"), "key", "grp", "mult")
        texts = base.select(F.coalesce("doc_id", F.lit(-1)).alias("wanted_id"), F.col("h").alias("wanted_h"), "text")
        with arrow_rows(spark, 1000):
            run, schema = _tokens_of(n)
            tokens = join_by_size(texts, wanted, ["wanted_id", "wanted_h"], "inner", 48).select("key", "grp", "mult", "text").mapInArrow(released(run), schema)
            tokens = tokens.repartition(F.col("grp"))  # both aggregations below keep it
            tokens = tokens.groupBy("grp", "key").agg(F.first("mult").alias("mult"), F.first("tokens").alias("tokens"))
            members = self.scratch.table(tokens.groupBy("grp").agg(F.collect_list(F.struct("key", "mult", "tokens")).alias("members")), "sets")
        with arrow_rows(spark, 4):
            matrix = self.scratch.table(members.mapInArrow(released(_unions), f"grp bigint, members {_MEMBERS}, token_union binary"), "matrix")
        self.scratch.drop("sets")
        return matrix

    def within(self, matrix: DataFrame) -> DataFrame:
        """``key, links, root`` of classes with links inside their group."""
        alone = matrix.where("size(members) > 1").select("members", F.lit(None).cast(_MEMBERS).alias("queries"), F.lit(None).cast("binary").alias("token_union"))
        return self._compared(alone, "within")

    def answers(self, asks: DataFrame, matrix: DataFrame, name: str) -> DataFrame:
        """``key, links, root`` of classes linked across groups, for ``asks`` of classes (key, n) to groups (grp)."""
        slices = asks.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / GROUP_CLASSES), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("slices"))
        asks = self.scratch.table(asks.join(slices, "grp").select("key", "grp", F.pmod(F.xxhash64("key"), F.col("slices")).alias("slice")), f"{name}-slices")
        one = matrix.select(F.explode("members").alias("m")).select("m.key", F.col("m").alias("member"))
        queries = join_by_size(one, asks, ["key"], "inner", 32).groupBy("grp", "slice").agg(F.collect_list("member").alias("queries"))
        compared = self._compared(queries.join(matrix, "grp").select("members", "queries", "token_union"), name)
        self.scratch.drop(f"{name}-slices")
        return compared

    def _compared(self, work: DataFrame, name: str) -> DataFrame:
        with arrow_rows(work.sparkSession, 2):
            run, schema = _compare(self.percent)
            return self.scratch.table(work.mapInArrow(released(run), schema), name)

    def to_neighbours(self, open_seats: DataFrame) -> DataFrame:
        """``key, n, grp``: two classes of each component of several in a group ask the group before it in a bucket."""
        along = Window.partitionBy("bucket").orderBy("grp")
        order = open_seats.select("bucket", "grp").distinct().withColumn("other", F.lag("grp").over(along)).where("other is not null")
        two = open_seats.groupBy("bucket", "grp", "component").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
        two = two.join(order, ["bucket", "grp"]).select("bucket", "other", F.explode(F.array("lo", "hi")).alias("key"))
        return self._asked(open_seats.join(two, ["bucket", "key"]))

    def to_all(self, open_seats: DataFrame) -> DataFrame:
        """``key, n, grp``: classes ask a bucket's other groups, unless they are connected with all of such a group there.

        Where most of a bucket is one component only the other classes ask; elsewhere of each two groups one asks.
        A pair's parts lie in several buckets, so either side may ask in some of them only: one has half of the parts or more.
        """
        there = open_seats.groupBy("bucket", F.col("grp").alias("other")).agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        rows = open_seats.where("not mostly or component <> main").join(there, "bucket")
        return self._asked(rows.where("grp <> other and (mostly or grp < other) and not (lo = hi and lo = component)"), sides=2)

    def to_every(self, seats: DataFrame) -> DataFrame:
        """``key, n, grp``: the classes of a bucket ask its other groups, of each two groups those of the one with fewer askers."""
        there = seats.select("bucket", F.col("grp").alias("other")).distinct()
        asks = self._asked(seats.join(there, "bucket").where("grp <> other").withColumnRenamed("grp", "own"), "own")
        asks = self.scratch.table(asks, "every")
        two = [F.least("own", "grp").alias("lo"), F.greatest("own", "grp").alias("hi")]
        votes = asks.groupBy(*two).agg(F.count_if(F.expr("own < grp")).alias("n_lo"), F.count_if(F.expr("own > grp")).alias("n_hi"))
        return asks.select("key", "n", "own", "grp", *two).join(votes, ["lo", "hi"]).where("(own < grp) = (n_lo <= n_hi)").select("key", "n", "grp")

    def _asked(self, rows: DataFrame, *more: str, sides: int = 1) -> DataFrame:
        """Asks whose class shares enough parts of a window with the other group."""
        asks = rows.groupBy("key", "other", "window", *more).agg(F.sum("parts").alias("all_parts"), F.first("n").alias("n")).where(self.enough("all_parts", sides))
        return asks.groupBy("key", F.col("other").alias("grp"), *more).agg(F.first("n").alias("n"))

    def open_seats(self, seats: DataFrame, component: DataFrame, name: str) -> DataFrame:
        """``seats`` in buckets of several components: their ``component``, the ``main`` one of the bucket and if it holds more than half."""
        known = seats.join(component, "key", "left").withColumn("component", F.coalesce("component", "key"))
        count = known.groupBy("bucket", "component").agg(F.count("*").alias("size"))
        main = count.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("components"), F.sum("size").alias("all")).where("components > 1")
        main = main.select("bucket", "top.component", F.expr("2 * top.size > all").alias("mostly")).withColumnRenamed("component", "main")
        return self.scratch.table(known.join(main, "bucket"), name)

    @staticmethod
    def components(links: DataFrame) -> DataFrame:
        return connected_components(links.select(F.col("key").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "key")


def _classes(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, count_links: bool) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, h, n_shingles, key`` of ``docs``, and per class ``key, class_id, component, component_id, mult, n_links``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    join = _Join(scratch, percent)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    with arrow_rows(spark, 1000):
        run, schema = _keyed(n, percent)
        keyed = scratch.table(base.select("doc_id", "h", "text").mapInArrow(released(run), schema), "keyed")
    rows = scratch.table(keyed.select("doc_id", "h", "n_shingles", "key"), "rows")
    # classes of equal sets; struct order puts null ids last
    own = rows.where("n_shingles > 0").groupBy("key").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "h")).alias("rep"), F.min("n_shingles").alias("n"), F.count("*").alias("mult"))
    classes = scratch.table(own.select("key", "rep.doc_id", "rep.h", "n", "mult"), "classes")
    shared = join.shared_parts(keyed.where("n_shingles > 0"))
    scratch.drop("keyed")
    members = join.members(shared)
    grouped = join.grouped(members, classes)
    seats = join.seats(members, grouped)
    scratch.drop("members")
    matrix = join.matrix(base, grouped, n)
    scratch.drop("grouped")
    links = join.within(matrix)
    if count_links:
        links = links.unionByName(join.answers(scratch.table(join.to_every(seats), "asks-every"), matrix, "across"))
        component = join.components(links)
    else:
        component = links.select("key", F.col("root").alias("component"))
        for name, ask in (("neighbours", join.to_neighbours), ("all", join.to_all)):
            asks = scratch.table(ask(join.open_seats(seats, component, f"open-{name}")), f"asks-{name}")
            if not asks.isEmpty():
                links = links.unionByName(join.answers(asks, matrix, f"links-{name}"))
                component = scratch.table(join.components(links), f"components-{name}")
            scratch.drop(f"open-{name}")
    degree = links.groupBy("key").agg(F.sum("links").alias("far"))
    least = component.join(classes, "key").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = component.join(least, "component").join(degree, "key", "left").select("key", "component", "component_id", "far")
    known = classes.select("key", F.col("doc_id").alias("class_id"), "mult").join(linked, "key", "left")
    n_links = F.col("mult") - 1 + F.coalesce("far", F.lit(0)) if count_links else F.lit(None).cast("bigint")
    # a class whose component has ids keeps the smallest of them, one without any stays null
    id_of = F.when(F.col("component").isNull(), F.col("class_id")).otherwise(F.col("component_id"))
    known = scratch.table(known.select("key", "class_id", F.coalesce("component", "key").alias("component"), id_of.alias("component_id"), "mult", n_links.alias("n_links")), "known")
    for name in ("matrix", "seats", "classes", "within", "across", "every", "asks-every", "asks-neighbours", "asks-all", "links-neighbours", "links-all", "components-neighbours", "components-all"):
        scratch.drop(name)
    return rows, known


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, class_id, copies``, and ``n_links`` if they are counted.

    Two documents link when 100 * shared shingles >= ``percent`` * all their shingles. ``component_id`` is the
    smallest id reachable by links, the document's own included; ``class_id`` the smallest id with the same
    shingle set; ``copies`` the number of rows with that set. With ``count_links``, ``n_links`` is the number of
    documents it links with, copies counted each: this compares m different texts that are all alike in m * m ways,
    while components alone take work in proportion to m.
    Null or wordless texts have no shingles, link with nothing, keep their own id and are their only copy. A null id takes part
    like any other but is never the smallest; where no other id is reachable the component is null.
    Repeated rows, and different texts under one id, are documents of their own. Other columns of ``docs`` are ignored;
    no rows give no rows. Texts of any length are taken whole; a set larger than a group is a group of its own.
    """
    rows, known = _classes(docs, n, percent, id_col, text_col, count_links)
    more = ["n_links"] if count_links else []
    full = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "key").join(known, "key").select("doc_id", "n_shingles", "component_id", "class_id", F.col("mult").alias("copies"), *more)
    none = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("copies"), *[F.lit(0).cast("bigint").alias(x) for x in more])
    return full.unionByName(none)


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of near-duplicates, with its columns; rows without words all stay.

    The row with the smallest ``doc_id`` stays, null ids last; of several texts under that id the one with the smallest
    hash, of repeated rows any one. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    rows, known = _classes(docs, n, percent, "doc_id", "text", False)
    each = rows.where("n_shingles > 0").groupBy("doc_id", "h", "key").agg(F.count("*").alias("times")).join(known.select("key", "component", "mult"), "key")
    order = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "h")
    each = scratch.table(each.withColumn("place", order), "each")
    crowds = each.groupBy("component").agg(F.min("place").alias("first"), F.count("*").alias("texts"), F.sum("times").alias("rows")).where("rows > 1")
    id_, h_ = (next(x for x in (f"{x}{'_' * k}" for k in range(1, 99)) if x not in docs.columns) for x in ("id", "h"))
    marked = each.join(crowds, "component").select(F.col("doc_id").alias(id_), F.col("h").alias(h_), (F.col("place") == F.col("first")).alias("stays"), "times")
    marked = scratch.table(marked, "marked")
    scratch.drop("each")
    gone, twice = marked.where("not stays or times > 1").select(id_, h_), marked.where("stays and times > 1").select(id_, h_)
    text_hash = F.xxhash64(F.col("text").cast("string"))
    same = [F.col(id_).eqNullSafe(F.col("doc_id").cast("bigint")), F.col(h_) == text_hash]
    kept = join_by_size(docs, gone, same, "left_anti", 24)
    repeated = join_by_size(docs, twice, same, "left_semi", 24).withColumn(h_, text_hash).dropDuplicates(["doc_id", h_]).drop(h_)
    return kept.unionByName(repeated)


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """``documents`` by word triples at a similarity of 90 percent."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)
