"""Benchmark decontamination by suffix arrays over the training texts.

The documents are taken in shards of about ``shard_words`` words (at least one whole document). Each shard gets a
suffix array over its words: positions sorted by the words that follow, by prefix tripling, with documents kept apart
by marks that no test word equals. Every suffix of every test item is searched in it by binary search. Two things follow:

* the suffixes that begin a window have an interval of places that begin with that window: the hits;
* each place lies between two test suffixes in their common order, and its longest verbatim match is the longer of what it
  shares with those two. A document's longest match is the longest of its places, of one word or more; ties go to the
  first place and then to the least item. It does not depend on the other documents of the shard.

No row is shuffled; a shard lives in one task and its memory is bounded by its words or by its longest document.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. A document
word inside any occurrence is hit, and a document is contaminated where ``n_hit > 0 and 20 * n_hit >= n_words``.

The test items are broadcast as numbers, in blocks of about ``block_bytes`` of text, next to one list of their distinct
words; a shard searches one block after the other, dropping each before the next. The driver holds the test texts, so
they are refused above ``benchmark_bytes``: that bound is on the given benchmark, not on the corpus, and a larger one is
split over calls, each on the documents that the one before kept.

Nulls: a null text has no words; a null item_id appears as an empty string in the list of ids; a null doc_id is kept.
Texts without words are clean. Repeated items count each, repeated documents are judged each for itself. An empty
benchmark or table is no special case. Columns named like a result are replaced by it.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import ALNUM, blocks

SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "longest_match long, longest_at long, longest_item string"
)


class Vocabulary(dict):
    """The numbers of the test items' words, from 1 on; 0 for any other word."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Tests:
    """A block of test items as numbers of words, each item ended by a 0, with its suffixes in their order."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, vocabulary: Vocabulary):
        texts = [t.translate(ALNUM).split() for _, t in items]
        self.names = [n for n, _ in items]
        for t in texts:
            for w in t:
                vocabulary.setdefault(w, len(vocabulary) + 1)
        flat = [i for t in texts for i in [*map(vocabulary.__getitem__, t), 0]]
        self.words = np.array([*flat, 0], np.int32)
        sizes = np.array([len(t) for t in texts], np.int64)
        item = np.repeat(np.arange(len(texts)), sizes + 1)
        starts = np.cumsum(sizes + 1) - sizes - 1
        left = np.repeat(starts + sizes, sizes + 1) - np.arange(len(flat))
        order = suffix_array(self.words[:-1])
        #: suffixes in their order: start, words left, item, and the length of the window that begins there or 0
        self.start = order[self.words[order] > 0].astype(np.int32)
        self.left, self.item = left[self.start].astype(np.int32), item[self.start].astype(np.int32)
        size = sizes[self.item]
        begins = (self.left >= window) | ((self.left == size) & (size < window))
        self.window = np.where(begins, np.minimum(window, size), 0).astype(np.int32)


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Positions in the order of the words from each on; a shorter suffix before its continuations.

    Ranks of k words become ranks of 3k words by one sort of three ranks packed into 64 bits. Only positions whose rank
    is still shared are sorted again."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    if n >= (1 << 21) - 2:
        return _suffix_array_wide(words)
    rank, step = words.astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable")
    while True:
        padded = np.concatenate([rank, np.zeros(2 * step, np.int64)])
        if step == 1:
            members = order = np.arange(n)
            at = None
        else:
            same = np.zeros(n + 1, bool)
            ordered = rank[order]
            same[1:n] = ordered[1:] == ordered[:-1]
            at = np.flatnonzero(same[:-1] | same[1:])  # places in the order that are not settled
            if not len(at):
                return order
            members = order[at]
        key = padded[members] << 42 | padded[members + step] << 21 | padded[members + 2 * step]
        by = np.argsort(key, kind="stable")
        key = key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        if at is None:
            order, rank = by, np.empty(n, np.int64)
            rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
        else:
            order[at] = members[by]
            rank = rank.copy()
            rank[order[at]] = at[np.flatnonzero(new)[np.cumsum(new) - 1]] + 1
        step *= 3


def _suffix_array_wide(words: np.ndarray) -> np.ndarray:
    """The same by doubling, for one document of over two million words."""
    rank, step, n = words.astype(np.int64) + 1, 1, len(words)
    while True:
        second = np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])[:n]
        order = np.lexsort((second, rank))
        new = np.concatenate([[True], (np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            return order
        step *= 2


def _before(text: np.ndarray, order: np.ndarray, query: np.ndarray, start: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
    """For each query (its first ``size`` words) how many suffixes sort before it; ``upper``: or begin with it.
    One binary search for all queries together; a comparison looks at words until the first difference."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) >> 1
        at, less = order[middle], np.full(len(open_), upper)
        todo, k = np.arange(len(open_)), 0
        while todo.size:
            todo = todo[size[open_[todo]] > k]
            a, b = text[np.minimum(at[todo] + k, len(text) - 1)], query[start[open_[todo]] + k]
            differ = a != b
            less[todo[differ]] = a[differ] < b[differ]
            todo, k = todo[~differ], k + 1
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
    return low


def _common(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """How many words two texts share from the given places on; a 0 ends both."""
    out, todo, k = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while todo.size:
        x = a[at[todo] + k]
        todo = todo[(x == b[bt[todo] + k]) & (x > 0)]
        out[todo] += 1
        k += 1
    return out


def search(texts: list[bytes], vocabulary: Vocabulary, tests: list[Callable[[], Tests]]) -> list[tuple]:
    """n_words, n_hit, n_items, digest of the items, contaminated, longest match, its place and its item, per text."""
    split = [t.translate(ALNUM).split() for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    flat = np.fromiter((i for x in split for i in [*map(vocabulary.__getitem__, x), 0]), np.int64, int(sizes.sum()) + len(split))
    del split
    starts = np.cumsum(sizes + 1) - sizes - 1
    # each word that no test has gets a number of its own, above theirs: it equals nothing and needs no sorting
    other = flat == 0
    other[starts + sizes] = False
    flat[other] = len(vocabulary) + 1 + np.arange(int(other.sum()))
    dense = flat if len(vocabulary) + len(flat) < 1 << 20 else np.unique(flat, return_inverse=True)[1]
    order = suffix_array(dense)
    del dense
    order = order[(flat[order] > 0) & ~other[order]]  # places that begin with a word of the tests
    hit = np.zeros(len(flat) + 1, np.int64)
    items: defaultdict[int, set[str]] = defaultdict(set)
    # the longest match of each document, its place there, and its item by the number over all blocks, which are in the
    # order of names
    longest, place = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    named = np.zeros(len(texts), np.int64)
    name: list[str | None] = [None] * len(texts)
    before = 0
    for load in tests if len(order) else []:
        t = load()
        if not len(t.start):
            before += len(t.names)
            continue
        # the windows: all their places
        w = np.flatnonzero(t.window)
        low = _before(flat, order, t.words, t.start[w], t.window[w], False)
        high = _before(flat, order, t.words, t.start[w], t.window[w], True)
        for k in np.flatnonzero(high > low):
            at, n, item = order[low[k] : high[k]], t.window[w[k]], t.item[w[k]]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + n, -1)
            for d in np.unique(np.searchsorted(starts, at, "right") - 1):
                items[int(d)].add(t.names[item])
        # every suffix: its place in the order; then the two suffixes around each place of the shard
        above = _before(flat, order, t.words, t.start, t.left, False)
        last = np.searchsorted(above, np.arange(len(order)), "right") - 1
        match = np.zeros(len(flat), np.int64)
        for side in (last, last + 1):
            near = np.flatnonzero((side >= 0) & (side < len(t.start)))
            shared = _common(flat, order[near], t.words, t.start[side[near]])
            match[order[near]] = np.maximum(match[order[near]], shared)
        most = np.maximum.reduceat(match, starts)
        of = np.repeat(np.arange(len(texts)), sizes + 1)
        first = np.flatnonzero((match == most[of]) & (match > 0))
        docs, at = np.unique(of[first], return_index=True)
        at = first[at]
        # the least item that holds this match: those suffixes are an interval
        text = t.words
        low = _before(text, t.start, flat, at, most[docs], False)
        high = _before(text, t.start, flat, at, most[docs], True)
        ends = np.stack([low, high], axis=1).ravel()
        least = np.minimum.reduceat(np.append(t.item, np.iinfo(np.int32).max), ends)[::2] if len(docs) else ends
        where, number = at - starts[docs], before + least
        old = (-longest[docs], place[docs], named[docs])
        better = (-most[docs] < old[0]) | (-most[docs] == old[0]) & (
            (where < old[1]) | (where == old[1]) & (number < old[2])
        )
        for d, x, p, i in zip(docs[better], most[docs][better], where[better], least[better], strict=True):
            longest[d], place[d], named[d], name[d] = x, p, before + i, t.names[i]
        before += len(t.names)
        del t
    inside = np.cumsum(hit)[:-1] > 0
    out = []
    for d, (start, n) in enumerate(zip(starts, sizes, strict=True)):
        n_hit = int(inside[start : start + n].sum()) if d in items else 0
        names = ",".join(sorted(items[d])) if d in items else ""
        digest = hashlib.sha256(names.encode()).hexdigest()
        n_items = len(items[d]) if d in items else 0
        bad = n_hit > 0 and 20 * n_hit >= n
        best = (int(longest[d]), int(place[d]), name[d]) if name[d] is not None else (0, None, None)
        out.append((int(n), n_hit, n_items, digest, bad, *best))
    return out


def load_benchmark(
    benchmark: DataFrame, window: int, block_bytes: int, benchmark_bytes: int
) -> tuple[Broadcast, list[Broadcast]]:
    """The words and the items in broadcast blocks. Items with equal ids stay apart while searched and count once by
    their id."""
    size = benchmark.agg(F.sum(F.octet_length("text") + 32).alias("n")).first()["n"] or 0
    if size > benchmark_bytes:
        raise ValueError(f"the benchmark has {size} bytes; split it into parts of {benchmark_bytes}")
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).collect()
    parts, held = [[]], 0
    for name, text in sorted((n, bytes(t)) for n, t in rows):
        if held > block_bytes:
            parts.append([])
            held = 0
        parts[-1].append((name, text))
        held += len(text) + 32
    context, vocabulary = benchmark.sparkSession.sparkContext, Vocabulary()
    blocks_ = []
    for part in parts:
        blocks_.append(context.broadcast(Tests(part, window, vocabulary)))
        if len(parts) > 1:  # the driver needs the block no more; executors read the file that it was written to
            blocks_[-1].__dict__.pop("_value", None)
    return context.broadcast(vocabulary), blocks_


def _loader(block: Broadcast) -> Callable[[], Tests]:
    def load() -> Tests:
        value = block.value
        if getattr(block, "_path", None):  # on an executor: read again for the next shard, so one block is held
            block.__dict__.pop("_value", None)
        return value

    return load


def judged(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    shard_words: int = 1 << 19,
    block_bytes: int = 8 << 20,
    benchmark_bytes: int = 64 << 20,
    keep: bool = False,
) -> DataFrame:
    """Documents with what the benchmark shares with them; see SCHEMA. ``keep``: instead the documents that stay, with
    their own columns."""
    vocabulary, tests = load_benchmark(benchmark, window, block_bytes, benchmark_bytes)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # with one block, as usual, the worker keeps it
        loaders = [_loader(b) for b in tests] if len(tests) > 1 else [lambda: tests[0].value]
        held: list[tuple[pa.RecordBatch, list[bytes]]] = []
        words = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = search([t for _, texts in held for t in texts], vocabulary.value, loaders)
            start = 0
            for batch, texts in held:
                rows = found[start : start + len(texts)]
                start += len(texts)
                if keep:
                    yield batch.filter(pa.array([not r[4] for r in rows], pa.bool_()))
                else:
                    kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

        for batch, texts in blocks(batches, "text", 1 << 20):
            texts = [t or b"" for t in texts]
            held.append((batch, texts))
            words += sum(len(t) for t in texts) // 6
            if words >= shard_words:
                yield from flush()
                held, words = [], 0
        if held:
            yield from flush()

    if keep:
        return docs.mapInArrow(run, docs.schema)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return judged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), g AS (
  SELECT DISTINCT item_id, n, list_slice(ws, i, i + n - 1) AS w FROM (
    SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i
    FROM b WHERE len(ws) > 0)
), s AS (SELECT DISTINCT n FROM g), p AS (
  SELECT r, i, n, list_slice(ws, i, i + n - 1) AS w FROM (
    SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, s WHERE len(ws) >= n)
), m AS (SELECT p.r, p.i, p.n, g.item_id FROM p JOIN g USING (n, w)),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
t AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r
), dw AS (SELECT r, i, ws[i] AS w, ws[i + 1] AS x, ws[i + 2] AS y FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
bw AS (
  SELECT q, name, i, ws[i] AS w, ws[i + 1] AS x, ws[i + 2] AS y FROM (
    SELECT row_number() OVER () AS q, coalesce(CAST(item_id AS VARCHAR), '') AS name, ws, unnest(range(1, len(ws) + 1)) AS i FROM b)
), run AS (
  SELECT r, q, name, dw.i, dw.i - bw.i AS diagonal,
    dw.i - row_number() OVER (PARTITION BY r, q, dw.i - bw.i ORDER BY dw.i) AS island
  FROM dw JOIN bw USING (w, x, y) WHERE y IS NOT NULL
), found AS (
  SELECT r, name, count(*) + 2 AS n, min(i) AS i FROM run GROUP BY r, q, name, diagonal, island
  UNION ALL SELECT r, name, 2, i FROM dw JOIN (SELECT w, x, min(name) AS name FROM bw GROUP BY ALL) USING (w, x) WHERE x IS NOT NULL
  UNION ALL SELECT r, name, 1, i FROM dw JOIN (SELECT w, min(name) AS name FROM bw GROUP BY ALL) USING (w)
), best AS (SELECT r, arg_min({'n': n, 'i': i - 1, 'name': name}, (-n, i, name)) AS m FROM found GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated,
  CAST(coalesce(m.n, 0) AS BIGINT) AS longest_match, CAST(m.i AS BIGINT) AS longest_at, m.name AS longest_item
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r) LEFT JOIN best USING (r)
"""
