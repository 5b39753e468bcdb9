"""String similarities that Spark has no expression for, over whole Arrow batches.

Many pairs run at once. A table holds, for each pair and character, a 64-bit word of the places where the shorter string
has that character; then a step of the recurrence takes one character of every pair (Hyyro's bit-parallel longest common
subsequence; the matches of Jaro's similarity likewise). Longer strings use Python's integers in the same recurrence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

WORD, STEP, WINDOWS = 64, 1 << 13, 1 << 16


def _long_lcs(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def _points(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, 0 beyond the end, and lengths."""
    out = np.zeros((len(texts), width), np.int32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    out[np.arange(width) < lengths[:, None]] = flat + 1
    return out, lengths


def _tables(x: list[str], y: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of both strings as small numbers (0 beyond the end, and for those of y that no x has), lengths, and the
    places in x of each number, as bits, by pair."""
    a, m = _points(x, max(map(len, x)))
    b, n = _points(y, max(map(len, y)))
    letters = np.unique(a)
    letters = letters[letters > 0]
    of_a = np.searchsorted(letters, a) + 1
    of_a[a == 0] = 0
    at = np.minimum(np.searchsorted(letters, b), len(letters) - 1)
    of_b = np.where(letters[at] == b, at + 1, 0)
    masks = np.zeros((len(x), len(letters) + 1), np.uint64)
    every = np.arange(len(x))
    for i in range(a.shape[1]):
        masks[every, of_a[:, i]] |= np.uint64(1 << i)
    masks[:, 0] = 0
    return of_a, of_b, m, n, masks


def _pieces(chosen: list[int], x: list[str]) -> Iterator[list[int]]:
    """Parts of a list of pairs whose tables have at most about STEP * WORD words."""
    at = 0
    while at < len(chosen):
        step, most = STEP, WORD
        while True:
            part = chosen[at : at + step]
            letters = len(set().union(*[x[i] for i in part]))
            if letters <= most or step <= 64:
                break
            step, most = step // 2, most * 2
        yield part
        at += len(part)


def lcs(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs."""
    out = np.zeros(len(a), np.int64)
    x, y = [p if len(p) <= len(q) else q for p, q in zip(a, b, strict=True)], [q if len(p) <= len(q) else p for p, q in zip(a, b, strict=True)]
    short = [i for i, p in enumerate(x) if 0 < len(p) <= WORD]
    short.sort(key=lambda i: len(y[i]))
    for part in _pieces(short, x):
        _, text, m, _, masks = _tables([x[i] for i in part], [y[i] for i in part])
        s, every = np.full(len(part), ~np.uint64(0)), np.arange(len(part))
        for j in range(text.shape[1]):
            u = s & masks[every, text[:, j]]
            s = (s + u) | (s - u)
        whole = ~np.uint64(0) >> (WORD - m).astype(np.uint64)
        out[part] = m - np.bitwise_count(s & whole)
    for i, p in enumerate(x):
        if len(p) > WORD:
            out[i] = _long_lcs(p, y[i])
    return out


def _below(n: np.ndarray) -> np.ndarray:
    """Words with the n lowest bits set, n from 0 to 64."""
    n = n.astype(np.uint64)
    return np.where(n > 0, ~np.uint64(0) >> ((np.uint64(WORD) - n) & np.uint64(63)), np.uint64(0))


def ratio(a: list[str], b: list[str]) -> np.ndarray:
    """2 * common / both lengths; 1 where both are empty."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    return np.where(total == 0, 1.0, 2 * lcs(a, b) / np.maximum(total, 1))


def token_sort(a: list[str], b: list[str]) -> np.ndarray:
    return ratio([" ".join(sorted(x.split())) for x in a], [" ".join(sorted(x.split())) for x in b])


def _token_parts(a: list[str], b: list[str]) -> list[tuple[str, str, str]]:
    """Common words, words of one only, words of the other only, each sorted and joined."""
    out = []
    for x, y in zip(a, b, strict=True):
        p, q = set(x.split()), set(y.split())
        out.append(tuple(" ".join(sorted(s)) for s in (p & q, p - q, q - p)))
    return out


def token_set(a: list[str], b: list[str]) -> np.ndarray:
    """Best ratio between the common words and those with the rest of either side; 1 where one side has all words of
    the other and they share some; 0 where one side has none."""
    parts = _token_parts(a, b)
    left = [f"{c} {p}".strip() for c, p, _ in parts]
    right = [f"{c} {q}".strip() for c, _, q in parts]
    out = ratio(left, right)
    for i, (c, p, q) in enumerate(parts):
        if not a[i].split() or not b[i].split():
            out[i] = 0.0
        elif c and (not p or not q):
            out[i] = 1.0
        elif c:
            # the common words are a prefix of both, so they are the whole subsequence
            out[i] = max(out[i], 2 * len(c) / (len(c) + len(left[i])), 2 * len(c) / (len(c) + len(right[i])))
    return out


def _best_windows(x: list[str], y: list[str]) -> np.ndarray:
    """For pairs of a string of up to 64 characters and one at least as long: the best ratio with a window."""
    out = np.zeros(len(x))
    by_length = sorted(range(len(x)), key=lambda i: len(x[i]))
    for chosen in _pieces(by_length, x):
        _, text, m, n, masks = _tables([x[i] for i in chosen], [y[i] for i in chosen])
        count = m + n - 1
        owner = np.repeat(np.arange(len(chosen)), count)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + 1 - m[owner]
        low, high = np.maximum(start, 0), np.minimum(start + m[owner], n[owner])
        # a best window begins or ends, where it can be moved, with a character of the shorter string
        first, last = text[owner, low] > 0, text[owner, high - 1] > 0
        tail = (start > 0) & (start + m[owner] > n[owner])
        kept = np.flatnonzero(np.where(tail, first, last) | first & (start > 0) & ~tail)
        best = np.zeros(len(chosen))
        for at in range(0, len(kept), WINDOWS):
            w = kept[at : at + WINDOWS]
            who, begin, end = owner[w], low[w], high[w]
            s, length = np.full(len(w), ~np.uint64(0)), end - begin
            for j in range(int(length.max())):
                code = np.where(j < length, text[who, np.minimum(begin + j, end - 1)], 0)
                u = s & masks[who, code]
                s = (s + u) | (s - u)
            common = m[who] - np.bitwise_count(s & _below(m[who]))
            np.maximum.at(best, who, 2 * common / (m[who] + length))
        out[chosen] = best
    return out


def partial(a: list[str], b: list[str]) -> np.ndarray:
    """Best ratio of the shorter string with a window of the longer one as long as it, or with a shorter one at an end."""
    out = np.zeros(len(a))
    left, right, owner = [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        if not x or not y:
            out[i] = float(not x and not y)
        elif x in y:
            out[i] = 1.0
        elif len(x) <= WORD:
            # of two strings as long as each other either may be the window
            for p, q in ((x, y), (y, x))[: 1 + (len(x) == len(y))]:
                left.append(p)
                right.append(q)
                owner.append(i)
        else:
            out[i] = _long_partial(x, y)
    if left:
        np.maximum.at(out, owner, _best_windows(left, right))
    return out


def _long_partial(x: str, y: str) -> float:
    m, best = len(x), 0.0
    for p, q in ((x, y), (y, x))[: 1 + (m == len(y))]:
        for start in range(1 - m, len(q)):
            window = q[max(0, start) : start + m]
            best = max(best, 2 * _long_lcs(p, window) / (m + len(window)))
    return best


def wratio(a: list[str], b: list[str], known: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """The weighted best of the above, by how much longer one string is. ``known``: those already computed."""
    out, known = np.zeros(len(a)), known or {}

    def get(f, chosen: list[int], x: list[str], y: list[str]) -> np.ndarray:
        return known[f.__name__][chosen] if f.__name__ in known else f(x, y)

    lengths = [(min(len(x), len(y)), max(len(x), len(y))) for x, y in zip(a, b, strict=True)]
    near = [i for i, (s, n) in enumerate(lengths) if s and n < 1.5 * s]
    far = [i for i, (s, n) in enumerate(lengths) if s and n >= 1.5 * s]
    if near:
        x, y = [a[i] for i in near], [b[i] for i in near]
        words = np.maximum(get(token_sort, near, x, y), get(token_set, near, x, y))
        out[near] = np.maximum(get(ratio, near, x, y), 0.95 * words)
    if far:
        x, y = [a[i] for i in far], [b[i] for i in far]
        scale = np.array([0.9 if lengths[i][1] < 8 * lengths[i][0] else 0.6 for i in far])
        in_order = partial([" ".join(sorted(t.split())) for t in x], [" ".join(sorted(t.split())) for t in y])
        parts = _token_parts(x, y)
        in_sets = np.where([bool(c) for c, _, _ in parts], 1.0, partial([p for _, p, _ in parts], [q for _, _, q in parts]))
        in_sets = np.where([not (s.split() and t.split()) for s, t in zip(x, y, strict=True)], 0.0, in_sets)
        words = 0.95 * scale * np.maximum(in_order, in_sets)
        out[far] = np.maximum.reduce([get(ratio, far, x, y), scale * get(partial, far, x, y), words])
    return out


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth for each of up to four equal first characters where it is above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    while prefix < 4 and prefix < min(len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler`` of many pairs; those of up to 64 characters run at once."""
    out = np.zeros(len(a))
    short = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if 0 < len(x) <= WORD and 0 < len(y) <= WORD]
    for part in _pieces(short, b):
        # the places of y's characters; x is read one character after the other
        y_codes, x_codes, n, m, masks = _tables([b[i] for i in part], [a[i] for i in part])
        every, one = np.arange(len(part)), np.uint64(1)
        reach = np.maximum(0, np.maximum(m, n) // 2 - 1)
        taken, mine = np.zeros(len(part), np.uint64), np.zeros(x_codes.shape, bool)
        for i in range(x_codes.shape[1]):
            near = _below(np.minimum(n, i + reach + 1)) & ~_below(np.clip(i - reach, 0, WORD))
            found = masks[every, x_codes[:, i]] & near & ~taken
            found &= ~found + one  # the first place
            taken |= found
            mine[:, i] = found > 0
        theirs = (taken[:, None] >> np.arange(y_codes.shape[1], dtype=np.uint64)) & one > 0
        matches = mine.sum(axis=1)
        row, column = np.nonzero(mine)
        row2, column2 = np.nonzero(theirs)  # as many in each row, in the same order of rows
        swaps = np.bincount(row, x_codes[row, column] != y_codes[row2, column2], len(part)) // 2
        some = np.maximum(matches, 1)
        jaro = np.where(matches > 0, (matches / m + matches / n + (matches - swaps) / some) / 3, 0.0)
        width = min(4, x_codes.shape[1], y_codes.shape[1])
        same = (x_codes[:, :width] == y_codes[:, :width]) & (x_codes[:, :width] > 0)
        prefix = np.cumprod(same, axis=1).sum(axis=1)
        out[part] = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    done = set(short)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            out[i] = 1.0
        elif i not in done:
            out[i] = jaro_winkler(x, y)
    return out


#: In an order in which each may use those before it.
SCORES = {
    "ratio": ratio,
    "token_sort": token_sort,
    "token_set": token_set,
    "partial": partial,
    "wratio": wratio,
    "jaro_winkler": jaro_winklers,
}


def string_scores(left: Column, right: Column, wanted: list[str]) -> Column:
    """A struct of the wanted similarities of two string columns, from 0 to 1; equal pairs in a batch are computed once,
    and what is not asked for is not computed."""

    @F.pandas_udf(StructType([StructField(k, DoubleType()) for k in wanted]))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in batches:
            codes, unique = pd.factorize(pd.MultiIndex.from_arrays([x.fillna(""), y.fillna("")]))
            a, b = ([u[k] for u in unique] for k in (0, 1))
            found: dict[str, np.ndarray] = {}
            for name, f in SCORES.items():
                if name in wanted:
                    found[name] = wratio(a, b, found) if f is wratio else f(a, b)
            yield pd.DataFrame({k: found[k][codes] if len(a) else [] for k in wanted}, dtype=float)

    return run(left, right)


@F.pandas_udf(DoubleType())
def string_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series(ratio(left.fillna("").tolist(), right.fillna("").tolist()))
