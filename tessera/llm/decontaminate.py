"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items: runs of ``window`` consecutive words, or the whole item
where it is shorter. Patterns of one length are searched together. A shift table says, for the hash of a block of two
words, how far the search may jump when the block stands at the end of the current position; blocks that end a
pattern have shift 0 and lead, by the hash of the words up to there, to the bucket of patterns that a direct comparison
of the words confirms. Equal hashes of different blocks only shorten jumps.

The benchmark is the stated query set. It is read in blocks of items of at most ``BLOCK_BYTES`` of text (an item is never
split). A block is a few numpy arrays, about ten times its text, and is broadcast on its own. Driver and workers hold the
tables of one block at a time; documents are scanned once against all blocks and are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import ROWS, released, texts
from tessera.llm.shingles import mix, word_hashes

WINDOW = 10
BLOCK_BYTES = 8 << 20
_U = np.uint64
_WORDS = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """ASCII letters (lower-cased), digits and everything beyond ASCII make words; all else separates them."""
    return text.translate(_WORDS).split() if text else []


def _hashes(parts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin, with the end."""
    found, owner = word_hashes([t.translate(_WORDS) if t else b"" for t in parts])
    return found, np.searchsorted(owner, np.arange(len(parts) + 1))


def _blocks(found: np.ndarray, width: int) -> np.ndarray:
    """For each word the hash of the block of ``width`` words (one or two) that it ends; the first word's is of no use."""
    if width == 1:
        return mix(found, 5)
    return mix(np.concatenate((found[:1], mix(found[:-1], 5) + found[1:])), 6)


def _runs(found: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of ``length`` words that begin at ``starts``."""
    out = np.zeros(len(starts), _U)
    for j in range(length):
        out = mix(out + found[starts + j], j + 1)
    return out


@dataclass
class WuManber:
    """Patterns of ``length`` words each: their shift table, and by the hash of a pattern where it stands and in which item."""

    length: int
    shift: np.ndarray
    suffix: np.ndarray
    start: np.ndarray
    item: np.ndarray

    @property
    def width(self) -> int:
        return min(2, self.length)

    @classmethod
    def of(cls, length: int, found: np.ndarray, starts: np.ndarray, items: np.ndarray) -> WuManber:
        width = min(2, length)
        bits = min(24, max(12, int(8 * len(starts)).bit_length()))
        shift = np.full(1 << bits, length - width + 1, np.uint8 if length < 256 else np.int64)
        at = (_blocks(found, width) >> _U(64 - bits)).astype(np.int64)
        for end in range(width, length + 1):
            np.minimum.at(shift, at[starts + end - 1], length - end)
        runs = _runs(found, starts, length)
        order = np.lexsort((items, runs))
        new = np.concatenate(([True], (np.diff(runs[order]) != 0) | (np.diff(items[order]) != 0)))  # an item counts once
        order = order[new]
        return cls(length, shift, runs[order], starts[order].astype(np.int32), items[order].astype(np.int32))

    def jumps(self, found: np.ndarray) -> np.ndarray:
        bits = len(self.shift).bit_length() - 1
        return self.shift[(_blocks(found, self.width) >> _U(64 - bits)).astype(np.int64)]


@dataclass
class Block:
    """The searchers of some benchmark items. ``data`` holds their words, one space apart, which begin at ``first``."""

    names: list[str]
    data: bytes
    first: np.ndarray
    searchers: list[WuManber]

    def window(self, start: int, length: int) -> bytes:
        return self.data[self.first[start] : self.first[start + length] - 1]

    def nbytes(self) -> int:
        return len(self.data) + self.first.nbytes + sum(x.nbytes for s in self.searchers for x in (s.shift, s.suffix, s.start, s.item))

    def search(self, parts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """The number of words of each text, the word ranges of all occurrences and the items that occur."""
        found, begun = _hashes(parts)
        out = [(int(b - a), [], set()) for a, b in zip(begun[:-1], begun[1:], strict=True)]
        if not len(found):
            return out
        for s in self.searchers:
            jumps = s.jumps(found)
            for i in np.unique(np.searchsorted(begun, np.flatnonzero(jumps == 0), side="right") - 1):
                self._search(s, parts[i], found[begun[i] : begun[i + 1]], jumps[begun[i] : begun[i + 1]].tolist(), *out[i][1:])
        return out

    def _search(self, s: WuManber, text: bytes, found: np.ndarray, jumps: list[int], spans: list, items: set) -> None:
        m, at, n, ends = s.length, s.length - 1, len(jumps), []
        while at < n:
            if jump := jumps[at]:
                at += jump
            else:
                ends.append(at)
                at += 1
        if not ends:
            return
        starts = np.array(ends) - m + 1
        runs = _runs(found, starts, m)
        lo, hi = np.searchsorted(s.suffix, runs, side="left"), np.searchsorted(s.suffix, runs, side="right")
        ws = None
        for k in np.flatnonzero(hi > lo):
            ws = words(text) if ws is None else ws
            own = b" ".join(ws[starts[k] : starts[k] + m])
            same = [j for j in range(lo[k], hi[k]) if self.window(s.start[j], m) == own]
            if same:
                spans.append((int(starts[k]), int(starts[k]) + m))
                items.update(self.names[s.item[j]] for j in same)


def build(items: list[tuple[str, bytes | None]], window: int = WINDOW) -> Block:
    """The searchers of items, one for each length of pattern."""
    names = sorted({i for i, _ in items})
    number = {x: k for k, x in enumerate(names)}
    lists = [words(t) for _, t in items]
    data = b"".join(w + b" " for ws in lists for w in ws)
    flat, begun = _hashes([t for _, t in items])
    first = np.concatenate(([0], np.cumsum([len(w) + 1 for ws in lists for w in ws], dtype=np.int64)))
    by: dict[int, tuple[list, list]] = {}
    for k, ((name, _), ws) in enumerate(zip(items, lists, strict=True)):
        if ws:
            m = min(window, len(ws))
            starts, own = by.setdefault(m, ([], []))
            starts.append(np.arange(begun[k], begun[k + 1] - m + 1))
            own.append(np.full(len(ws) - m + 1, number[name]))
    return Block(names, data, first, [WuManber.of(m, flat, np.concatenate(a), np.concatenate(b)) for m, (a, b) in sorted(by.items())])


def covered(spans: list[tuple[int, int]]) -> int:
    """How many words lie in the ranges."""
    hit, last = 0, 0
    for a, b in sorted(spans):
        hit += max(0, b - max(a, last))
        last = max(last, b)
    return hit


def _held(shared):
    """The blocks, one at a time: a worker keeps none but the last, the others it reads again from the executor's copy."""
    for block in shared:
        yield block.value
        if len(shared) > 1:
            vars(block).pop("_value", None)


def _scan(shared, batch: pa.RecordBatch) -> list[tuple[int, int, list[str]]]:
    """Per row of a batch its words, how many of them lie in occurrences, and the sorted ids of the items."""
    spans: list[list] = [[] for _ in range(batch.num_rows)]
    items: list[set] = [set() for _ in spans]
    sizes = [0] * len(spans)
    for block in _held(shared):
        for lo in range(0, len(spans), ROWS):
            for i, (size, own, names) in enumerate(block.search(texts(batch.slice(lo, ROWS))), lo):
                sizes[i] = size
                spans[i] += own
                items[i] |= names
    return [(n, covered(s), sorted(x)) for n, s, x in zip(sizes, spans, items, strict=True)]


def _scanner(shared):
    def run(batches):
        for batch in batches:
            n, hit, found = zip(*_scan(shared, batch), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "items"])

    return run, "doc_id bigint, n_words bigint, n_hit bigint, items array<string>"


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast the benchmark's searchers in blocks of bounded size; rows without id or text have no windows."""
    sc, out, part, size = benchmark.sparkSession.sparkContext, [], [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").cast("binary").alias("t")).where("i is not null and t is not null")
    for r in rows.toLocalIterator():
        if part and size + len(r["t"]) > block_bytes:
            out.append(sc.broadcast(build(part, window)))
            part, size = [], 0
        part.append((r["i"], bytes(r["t"])))
        size += len(r["t"])
    return [*out, sc.broadcast(build(part, window))]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, items`` per row of ``docs``: words in occurrences of benchmark windows and the items' ids.

    Null and empty texts have no words; texts of any length are searched whole. Items with the same id count as one; items
    with a null id are left out. Rows keep their number, ids may be null or repeat, and other columns are ignored.
    Without items nothing is hit, without documents there are no rows.
    """
    run, schema = _scanner(benchmark_blocks(benchmark, window))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(run), schema)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with their columns; null texts stay."""
    shared = benchmark_blocks(benchmark, window)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([not hit for _, hit, _ in _scan(shared, batch)], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """``documents`` against all ``benchmark`` items by windows of ten words."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
b as (
  select cast(item_id as varchar) item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark where text is not null),
bw as (
  select distinct item_id, m, array_to_string(w[i : i + m - 1], ' ') g
  from (select item_id, w, least(len(w), 10) m, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from b where len(w) > 0)),
dw as (
  select doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') g
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) i from d, (select distinct m from bw) where len(w) >= m)),
occ as (select dw.doc_id, dw.m, dw.i, bw.item_id from dw join bw on dw.m = bw.m and dw.g = bw.g),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + m)) p from occ) group by doc_id),
its as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) s from occ group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit on d.doc_id = hit.doc_id left join its on d.doc_id = its.doc_id
"""
