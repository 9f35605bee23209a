"""String similarities without a built-in: Arrow functions that share work between equal pairs of a batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    """Share of matching characters within half the longer length, and of those in the same order."""
    la, lb = len(a), len(b)
    if not la or not lb:
        return float(la == lb)
    reach = max(0, max(la, lb) // 2 - 1)
    used, matched = [False] * lb, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    other = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(matched, other, strict=True)) // 2
    m = len(matched)
    return (m / la + m / lb + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised by up to four equal first characters where it exceeds 0.7; two empty texts are equal."""
    s = jaro(a, b)
    if s <= 0.7:
        return s
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return s + same * 0.1 * (1 - s)


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per character of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Share of characters that insertions and deletions leave in place; 1 for two empty texts."""
    return 2 * _lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio between the shared tokens and either side's shared and own tokens; 0 if a side has none."""
    sa, sb = set(a.split()), set(b.split())
    if not sa or not sb:
        return 0.0
    both = " ".join(sorted(sa & sb))
    only_a, only_b = " ".join(sorted(sa - sb)), " ".join(sorted(sb - sa))
    if both and (not only_a or not only_b):
        return 1.0
    with_a, with_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    best = ratio(with_a, with_b)
    if both:
        best = max(best, ratio(both, with_a), ratio(both, with_b))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a stretch of the longer one, stretches at its ends being shorter."""
    if not a or not b:
        return float(a == b)

    def best(s: str, t: str) -> float:
        n, letters, top = len(s), set(s), 0.0
        for i in range(1 - n, len(t)):
            part = t[max(0, i) : i + n]
            # a stretch counts only where its outer end could match
            if (i <= 0 and part[-1] not in letters) or (i > 0 and part[0] not in letters):
                continue
            top = max(top, ratio(s, part))
            if top == 1.0:
                break
        return top

    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(a, b) if len(a) < len(b) else best(b, a)


#: Texts of so many characters are compared many pairs at a time, each character being a bit; longer ones one by one.
_BITS = 64


def _codes(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points for each text, padded, and the lengths."""
    size = np.array([len(t) for t in texts])
    codes = np.array(texts, f"U{size.max()}").view(np.uint32).reshape(len(texts), -1).copy()
    codes[np.arange(codes.shape[1]) >= size[:, None]] = pad
    return codes, size


def _where(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row the bits of ``a`` that equal the character ``c``."""
    bits = np.zeros((len(a), 8), np.uint8)
    packed = np.packbits(a == c[:, None], axis=1, bitorder="little")
    bits[:, : packed.shape[1]] = packed
    return bits.view("<u8")[:, 0]


def _first(n: np.ndarray) -> np.ndarray:
    """The lowest n bits, n being 0 to 64."""
    return np.where(n > 0, np.uint64(0xFFFFFFFFFFFFFFFF) >> np.where(n > 0, _BITS - n, 0).astype(np.uint64), np.uint64(0))


def _lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """``_lcs`` of texts of 1 to 64 characters."""
    out, order = np.zeros(len(a), np.int64), np.argsort([len(t) for t in b], kind="stable")
    for lo in range(0, len(order), 1024):
        at = order[lo : lo + 1024]
        (ca, na), (cb, _) = _codes([a[i] for i in at], 0xFFFFFFFF), _codes([b[i] for i in at], 0xFFFFFFFE)
        row = full = _first(na)
        for j in range(cb.shape[1]):
            hit = row & _where(ca, cb[:, j])
            row = (row + hit | row - hit) & full
        out[at] = na - np.bitwise_count(row)
    return out


def _ratios(a: list[str], b: list[str]) -> np.ndarray:
    return 2 * _lcs_many(a, b) / np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])


def _token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    ordered = {t: " ".join(sorted(t.split())) for t in {*a, *b}}
    return _many(ratio, _ratios, [ordered[x] for x in a], [ordered[x] for x in b])


def _token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    out, parts, left, right = np.zeros(len(a)), [], [], []
    sets = {t: set(t.split()) for t in {*a, *b}}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        sa, sb = sets[x], sets[y]
        if not sa or not sb:
            continue
        common = sa & sb
        if common and (len(common) == len(sa) or len(common) == len(sb)):
            out[i] = 1.0
            continue
        both = " ".join(sorted(common))
        parts.append((i, len(both)))
        left.append(f"{both} {' '.join(sorted(sa - sb))}".strip())
        right.append(f"{both} {' '.join(sorted(sb - sa))}".strip())
    if parts:
        at, common = np.array(parts).T
        best = _many(ratio, _ratios, left, right)
        for side in (left, right):  # the shared tokens are the beginning of either side
            best = np.maximum(best, np.where(common > 0, 2 * common / (common + np.array([len(t) for t in side])), 0.0))
        out[at] = best
    return out


def _best_stretches(s: list[str], t: list[str]) -> np.ndarray:
    """``partial_ratio`` with stretches of ``t`` only, which is at least as long: all places of a stretch go on together."""
    out, sizes = np.zeros(len(s)), np.array([len(x) for x in s])
    for n in np.unique(sizes).tolist():
        same = np.flatnonzero(sizes == n)
        for lo in range(0, len(same), 256):
            at = same[lo : lo + 256]
            (cs, _), (ct, m) = _codes([s[i] for i in at], 0xFFFFFFFF), _codes([t[i] for i in at], 0xFFFFFFFE)
            width = ct.shape[1]
            where = np.stack([_where(cs, ct[:, j]) for j in range(width)], axis=1)
            full = np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(_BITS - n)
            rows, top = np.full((len(at), width), full), np.zeros(len(at))
            for k in range(n):
                row = rows[:, : width - k]
                hit = row & where[:, k:]
                rows[:, : width - k] = (row + hit | row - hit) & full
                if k < n - 1:  # a stretch that begins before the text
                    top = np.maximum(top, 2 * (n - np.bitwise_count(rows[:, 0]).astype(np.int64)) / (n + k + 1))
            length = np.minimum(n, m[:, None] - np.arange(width))
            score = 2 * (n - np.bitwise_count(rows).astype(np.int64)) / (n + np.maximum(length, 1))
            out[at] = np.maximum(top, np.where(length > 0, score, 0.0).max(axis=1))
    return out


def _partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    short, long = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)), strict=True)
    out = _best_stretches(short, long)
    same = [i for i, (x, y) in enumerate(zip(short, long, strict=True)) if len(x) == len(y)]
    if same:
        out[same] = np.maximum(out[same], _best_stretches([long[i] for i in same], [short[i] for i in same]))
    return out


def _jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    out = np.zeros(len(a))
    for lo in range(0, len(a), 1024):
        (ca, na), (cb, nb) = _codes(a[lo : lo + 1024], 0xFFFFFFFF), _codes(b[lo : lo + 1024], 0xFFFFFFFE)
        reach = np.maximum(0, np.maximum(na, nb) // 2 - 1)
        used, matched = np.zeros(len(ca), np.uint64), np.zeros(ca.shape, bool)
        for i in range(ca.shape[1]):
            near = _first(np.minimum(nb, i + reach + 1)) & ~_first(np.minimum(_BITS, np.maximum(0, i - reach)))
            free = _where(cb, ca[:, i]) & near & ~used
            matched[:, i] = free != 0
            used |= free & (~free + np.uint64(1))
        taken = (used[:, None] >> np.arange(cb.shape[1], dtype=np.uint64) & np.uint64(1)) != 0
        m = matched.sum(axis=1)
        width = min(ca.shape[1], cb.shape[1])
        x = np.take_along_axis(ca, np.argsort(~matched, axis=1, kind="stable"), 1)[:, :width]
        y = np.take_along_axis(cb, np.argsort(~taken, axis=1, kind="stable"), 1)[:, :width]
        swaps = ((x != y) & (np.arange(width) < m[:, None])).sum(axis=1) // 2
        s = np.where(m > 0, (m / na + m / nb + (m - swaps) / np.maximum(1, m)) / 3, 0.0)
        same = np.logical_and.accumulate(ca[:, : min(4, width)] == cb[:, : min(4, width)], axis=1).sum(axis=1)
        out[lo : lo + 1024] = np.where(s <= 0.7, s, s + same * 0.1 * (1 - s))
    return out


def _many(f: Callable[[str, str], float], many: Callable[[list[str], list[str]], np.ndarray], a: list[str], b: list[str]) -> np.ndarray:
    """``f`` of each pair, by ``many`` where both have 1 to 64 characters."""
    easy = np.array([0 < len(x) <= _BITS and 0 < len(y) <= _BITS for x, y in zip(a, b, strict=True)], bool)
    out = np.zeros(len(a))
    if easy.any():
        out[easy] = many([a[i] for i in np.flatnonzero(easy)], [b[i] for i in np.flatnonzero(easy)])
    for i in np.flatnonzero(~easy):
        out[i] = f(a[i], b[i])
    return out


def distinct(a, b) -> tuple[list[tuple[str | None, str | None]], list[int]]:
    """The distinct pairs of two columns, and the place of each row's pair among them."""
    known: dict = {}
    at = [known.setdefault(pair, len(known)) for pair in zip(a, b, strict=True)]
    return list(known), at


def of_pairs(f: Callable[[str, str], float], many: Callable[[list[str], list[str]], np.ndarray], pairs: list[tuple[str | None, str | None]]) -> np.ndarray:
    """``f`` of each pair; NaN where one is null."""
    full = [i for i, (x, y) in enumerate(pairs) if x is not None and y is not None]
    out = np.full(len(pairs), np.nan)
    if full:
        out[full] = _many(f, many, [pairs[i][0] for i in full], [pairs[i][1] for i in full])
    return out


def _arrow(f: Callable[[str, str], float], many: Callable[[list[str], list[str]], np.ndarray]):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs, at = distinct(a, b)
        return pd.Series(of_pairs(f, many, pairs)[at], dtype="float64")

    return run


#: The features that need Python, by the field of both records that they compare.
FUZZY = {
    "folded": {"jaro_winkler": (jaro_winkler, _jaro_winklers), "rf_token_sort": (token_sort_ratio, _token_sort_ratios), "rf_token_set": (token_set_ratio, _token_set_ratios), "rf_partial": (partial_ratio, _partial_ratios)},
    "addr_sq": {"rf_addr_sort": (token_sort_ratio, _token_sort_ratios)},
}
jaro_winkler_udf = _arrow(jaro_winkler, _jaro_winklers)
ratio_udf = _arrow(ratio, _ratios)
token_sort_udf = _arrow(token_sort_ratio, _token_sort_ratios)
token_set_udf = _arrow(token_set_ratio, _token_set_ratios)
partial_udf = _arrow(partial_ratio, _partial_ratios)
