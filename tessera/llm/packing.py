"""Vector best-fit packing of tokenised documents into training sequences.

Tokenising happens where the documents lie; only piece lengths travel. White space never lies inside a token
of the vocabulary used, so the ids of a text are those of its white-space separated chunks in a row; each
worker remembers the ids of chunks it has met, within a bound.

Pieces are dealt evenly into blocks of bounded size. In a block, pieces are taken by falling length, and each
goes to the open sequence that it fits best: tokens, documents and attention cost (the sum of squared lengths)
are capacities, every one of which must suffice, and the smallest weighted norm of the residual vector, or the
largest weighted dot product of piece and residual, selects the sequence. Sequences in equal states are
interchangeable, so the search runs over states, not over sequences. A block leaves at most a few sequences
badly filled, whatever the size of the corpus.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import released
from tessera.runtime import Scratch, arrow_rows

TOKENIZER = "word_bpe_49k.json"
END_ID = 0
BLOCK_PIECES = 1 << 14
#: A worker remembers the ids of so many chunks and as many before them: a generation that is full becomes the old
#: one, from which chunks that are met again move on.
REMEMBERED = 250_000
#: Bytes of text whose chunks are told apart and looked up together.
_AT_ONCE = 8 << 20
_IDS: dict[str, tuple] = {}
#: A run of letters that no normalisation changes (a-z and the small letters of U+00DF to U+00FF, in UTF-8), and the run of
#: ASCII punctuation behind it: two words to the tokenizer, whichever letters and signs they hold.
_EASY = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")
#: A text by which a tokenizer of another kind is told.
_PROBE = "The quick, brown Fox's\n\tUNBELIEVABLE den: 12.5% (caf\u00e9) a  b.c"


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. By default documents and cost bind no more than tokens do."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"  # or "dot"


def _tokenizer(path: str):
    """The tokenizer of a file, which of its ids end a word, the two generations of chunks that this worker remembers,
    and the file's model behind a plain split at white space."""
    if path not in _IDS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tok = Tokenizer.from_file(path)
        ends = np.zeros(max(tok.get_vocab().values()) + 1, bool)
        ends[[i for t, i in tok.get_vocab().items() if t.endswith("</w>")]] = True
        bare = Tokenizer(tok.model)
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        encode = lambda t, by=tok: by.encode(t, add_special_tokens=False).ids
        words = _PROBE.lower().split()
        easy = " ".join(w for w in re.findall("[^\\W\\d_]+", _PROBE.lower()) if _EASY.fullmatch(w.encode()))
        if not ends.any() or encode(_PROBE) != [i for w in words for i in encode(w)] or encode(easy) != encode(easy, bare):
            raise ValueError(f"{path}: the ids of a text are not those of its lower-cased chunks with marked ends")
        _IDS[path] = tok, ends, {}, {}, bare
    return _IDS[path]


def _encode_words(tok, ends: np.ndarray, words: list[str]) -> list[bytes | None]:
    """The ids of words, encoded many at a time as one text whose ids are cut at word ends; None where words fell apart."""
    out: list[bytes | None] = [None] * len(words)
    for lo in range(0, len(words), 1024):
        part = words[lo : lo + 1024]
        ids = np.array(tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
        at = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        if len(at) == len(part):
            raw = ids.astype("<u4").tobytes()
            out[lo : lo + 1024] = [raw[a:b] for a, b in zip([0, *at], at)]  # noqa: B905
    return out


def _encode(tok, ends: np.ndarray, chunks: list[bytes]) -> list[bytes]:
    """The ids of any chunks; those of letters alone go together."""
    texts = [w.decode("utf-8", "replace") for w in chunks]  # malformed bytes as U+FFFD
    plain = [i for i, t in enumerate(texts) if t.isalpha()]
    out: list[bytes | None] = [None] * len(chunks)
    for i, x in zip(plain, _encode_words(tok, ends, [texts[i] for i in plain]), strict=True):
        out[i] = x
    alone = [i for i, x in enumerate(out) if x is None]
    if alone:
        for i, e in zip(alone, tok.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
    return out


def _learn(tok, bare, ends: np.ndarray, known: dict[bytes, bytes], new: list[bytes]) -> None:
    """Remember the little-endian ids of new chunks."""
    cut, other = {}, []
    for w in new:
        if m := _EASY.fullmatch(w):
            cut[w] = m.groups()
        else:
            other.append(w)
    stems = list({a for a, _ in cut.values() if a not in known})
    tails = list({b for _, b in cut.values() if b and b not in known})
    ids = _encode_words(bare, ends, [w.decode() for w in stems])
    known.update((w, x) for w, x in zip(stems, ids, strict=True) if x is not None)
    other += [w for w, x in zip(stems, ids, strict=True) if x is None] + tails
    known.update(zip(other, _encode(tok, ends, other), strict=True))
    for w, (a, b) in cut.items():
        if b:
            known[w] = known[a] + known[b]


def token_bytes(texts: list[bytes | None] | pa.Array, path: str):
    """Yield the ids of each text as little-endian unsigned 32-bit numbers."""
    tok, ends, known, old, bare = _tokenizer(path)
    if len(known) > REMEMBERED:
        known, old = {}, known
        _IDS[path] = tok, ends, known, old, bare
    if isinstance(texts, list):
        texts = pa.array(texts, pa.large_binary())
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string(), safe=False), "")))
    chunks = words.flatten().dictionary_encode()
    ws = chunks.dictionary.cast(pa.large_binary()).to_pylist()
    ids = list(map(known.get, ws))
    gaps = []
    for i in [i for i, x in enumerate(ids) if x is None]:
        if (x := old.get(ws[i])) is None:
            gaps.append(i)
        else:
            known[ws[i]] = ids[i] = x
    _learn(tok, bare, ends, known, [ws[i] for i in gaps])
    for i in gaps:
        ids[i] = known[ws[i]]
    joined = pa.array(ids, pa.large_binary()).take(chunks.indices)  # the ids of all texts in a row
    offsets, data = joined.buffers()[1:] if ws else (None, None)
    at = np.frombuffer(offsets, np.int64)[words.offsets.to_numpy()].tolist() if ws else [0] * (len(words) + 1)
    for lo, to in zip(at, at[1:]):  # noqa: B905
        yield data[lo:to].to_pybytes() if to > lo else b""


def _portions(texts: pa.Array):
    """Ranges of texts that hold ``_AT_ONCE`` bytes, or one longer text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(size):
        to = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + _AT_ONCE, side="right")))
        yield lo, to
        lo = to


def _pieces(path: str, most: int, end: int):
    tail = array("I", [end]).tobytes()

    def run(batches):
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            doc, piece, start, length, crc = [], [], [], [], []
            for lo, to in _portions(texts):
                for i, data in zip(ids[lo:to], token_bytes(texts.slice(lo, to - lo), path), strict=True):
                    data += tail
                    for k, at in enumerate(range(0, len(data), 4 * most)):
                        part = data[at : at + 4 * most]
                        doc.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pack_lengths(lengths: np.ndarray, cap: Capacity = Capacity()) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece and its offset there, by vector best fit in order of falling length."""
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if len(lengths) and (lengths.max() > cap.tokens or lengths.max() ** 2 > cap.cost or lengths.min() < 0 or cap.documents < 1):
        raise ValueError("a piece exceeds the capacities of an empty sequence")
    order = np.argsort(-lengths, kind="stable")
    full = np.array([cap.tokens, cap.documents, cap.cost], np.float64)
    scale = np.array(cap.weights) / full**2
    states = np.zeros((1024, 3))
    bins: list[list[int]] = []
    where: dict[tuple, int] = {}
    used, made, at = 0, 0, 0
    live = np.zeros(1024, bool)
    while at < len(order):
        size = int(lengths[order[at]])
        to = at + int(np.searchsorted(-lengths[order[at:]], -size, side="right"))
        item = np.array([size, 1, size * size], np.float64)
        while at < to:
            left = states[:used] - item
            ok = np.flatnonzero(live[:used] & (left >= 0).all(axis=1))
            if len(ok):
                score = (left[ok] ** 2) @ scale if cap.rule == "norm" else -(states[ok] * item) @ scale
                s = int(ok[np.argmin(score)])
                take, rest = bins[s][: to - at], bins[s][to - at :]
                bins[s], live[s], new = rest, bool(rest), left[s]
            else:  # one sequence at a time, so that equal pieces can share it
                take, new, made = [made], full - item, made + 1
            for b in take:
                i = order[at]
                seq[i], offset[i], at = b, cap.tokens - int(new[0]) - size, at + 1
            key = tuple(new)
            if (k := where.get(key)) is None:
                if used == len(states):
                    states, live = np.concatenate((states, np.zeros_like(states))), np.concatenate((live, np.zeros_like(live)))
                k = where[key] = used
                states[k], used = new, used + 1
                bins.append([])
            bins[k].extend(take)
            live[k] = True
        if used > 1024 and live[:used].sum() < used // 2:  # forget states without sequences
            keep = np.flatnonzero(live[:used])
            states[: len(keep)], bins, used = states[keep], [bins[k] for k in keep], len(keep)
            live[:] = False
            live[:used] = True
            where = {tuple(states[k]): k for k in range(used)}
    return seq, offset


def _packer(cap: Capacity):
    def run(batches):
        batches = list(batches)  # one block
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        seq, offset = pack_lengths(table.column("length").to_numpy(), cap)
        seq += TaskContext.get().partitionId() << 32
        table = table.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))
        yield from table.to_batches(max_chunksize=10_000)

    return run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str | None = None, cap: Capacity = Capacity(), end: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece of every row of ``docs``.

    ``tokenizer`` is the path of a tokenizers file that lower-cases, whose tokens lie within white-space separated chunks and
    mark the ends of words by ``</w>``; other kinds are refused. A document is its ids and ``end``; only documents longer than
    a sequence are cut. A null or empty text is ``end`` alone. Ids may be null or repeat: each row is packed for
    itself. Texts of any length are taken whole. Other columns are ignored; no rows give no sequences.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path(TOKENIZER))
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    run, schema = _pieces(tokenizer, cap.tokens, end)
    with arrow_rows(spark, 2000):
        pieces = scratch.table(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(run), schema), "pieces")
    blocks = max(1, -(-pieces.count() // BLOCK_PIECES))
    run, schema = _packer(cap)
    return pieces.repartition(blocks).mapInArrow(released(run), schema)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """``documents`` in sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
