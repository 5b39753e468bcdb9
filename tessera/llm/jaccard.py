"""Jaccard join of word shingles by T-occurrence search.

A document's set holds its distinct ``width``-word shingles as 64-bit hashes (a shorter text: its words as one). Two
sets link where ``100 * intersection >= percent * union``. The steps:

1. Equal sets are one class, by a 128-bit digest; all that follows works on classes, so copies cost nothing more.
2. Candidate groups. A pair that links differs in at most ``3 / 37`` (at 85 %) of its two sizes together. The hash range
   is cut into so many parts that nearly every set has more parts of two or more shingles than that bound; then one of
   them must be the same in both. Each set sends one hash for each such part; sets with an equal hash are joined by star
   edges (never all pairs), and the components of these edges are the groups. Parts of one shingle are not sent: texts
   of one language share single shingles by chance. Sets with too few larger parts also send their prefix (the least
   hashes, one by one), which two such sets must share. This loses no pair: it is a bound, not a chance.
3. Search. The sets of a group meet in one task and each is looked up in the inverted lists of the others. A partner
   must occur on T of the lists. DivideSkip: the L longest lists are put aside, the short ones are merged by a heap that
   skips ahead (T - L occurrences make a candidate), and candidates are looked up in the long ones by binary search.
   Candidates already known to be connected are not looked up again, so a group of copies costs about one check per set.
4. Passages that many texts share chain sets that never link into one group. A group of more than ``block_shingles`` is
   narrowed first: its shingles are ordered by how many of its sets have them, and a set sends its first ones, of which
   sets that link share at least one (the prefix bound); the components of these are the groups then. One that is still
   larger is dealt into blocks and every pair of blocks is searched in a task of its
   own; the links found are joined by components again. For components the search finds a spanning set of links only;
   ``links`` verifies every candidate and gives every link between classes, and ``link_counts`` each document's number.

Nulls and texts without words have empty sets: n_shingles 0, linked with nothing, component their own doc_id. Rows with
a null doc_id take no part in links and have a null component. Repeated rows link as equal sets do. An empty table gives
no rows. Columns beyond doc_id and text are ignored. The number of links counts rows: a row with a null doc_id or an empty
set has none.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from math import exp, log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, blocks, delete, release, scratch, small_batches
from tessera.llm.components import components

#: Ids that are broadcast at most (some 100 MB in memory); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: The ratio of the bounds of size classes.
RATIO = 1.2
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits look random (the SplitMix64 finalizer)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: list[bytes | None], width: int = 4) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    split = [(t or b"").translate(LOWER).split() for t in texts]
    sizes = [len(x) for x in split]
    flat = np.fromiter((i for x in split for i in map(number.__getitem__, x)), np.int64, sum(sizes))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), U, len(number))[flat]
    rolled = np.zeros(max(0, len(flat) - width + 1), U)
    for k in range(width):
        rolled += hashes[k : k + len(rolled)] * U(0x9E3779B97F4A7C15 ** (k + 1) % 2**64)
    rolled = mixed(rolled)
    out, at = [], 0
    for n in sizes:
        if n >= width:
            x = np.sort(rolled[at : at + n - width + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif n:
            short = U(n)
            for k in range(n):
                short = mixed((short + hashes[at + k : at + k + 1]) * U(0xD6E8FEB86659FD93))
            out.append(short)
        else:
            out.append(np.zeros(0, U))
        at += n
    return out


def digest(x: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a set as two signed integers."""
    d = xxhash.xxh3_128_digest(x.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Scheme:
    """Size classes and their numbers of parts at a threshold."""

    def __init__(self, percent: int):
        self.percent = percent
        # the least size that can link with another set: one more element in the partner
        first = 1
        while 100 * first < percent * (first + 1):
            first += 1
        bounds = [first]
        while bounds[-1] < 1 << 40:
            bounds.append(int(bounds[-1] * RATIO) + 1)
        self.bounds = np.array(bounds, np.int64)
        largest = self.bounds[1:] - 1
        #: how many shingles may differ, and the number of parts
        self.differ = (largest + largest * 100 // percent) * (100 - percent) // (100 + percent)
        self.parts = np.array([self._parts(int(n), int(d)) for n, d in zip(self.bounds, self.differ)], np.int64)

    @staticmethod
    def _parts(n: int, differ: int) -> int:
        """As many parts as leave the smallest sets of a class, by their mean less three deviations, enough parts of two
        shingles or more."""
        parts = differ + 3
        while parts < 3 * differ + 20:
            few = parts * exp(-n / parts) * (1 + n / parts)
            if parts - few - 3 * sqrt(few) >= differ + 1:
                break
            parts += max(1, parts // 100)
        return parts

    def least(self, n: np.ndarray) -> np.ndarray:
        """The least size of a partner."""
        return -(-self.percent * n // 100)

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the set) of all sets."""
        keep = [i for i, x in enumerate(sets) if len(x) >= self.bounds[0]]
        if not keep:
            return np.zeros(0, U), np.zeros(0, np.int64)
        sizes = np.array([len(sets[i]) for i in keep], np.int64)
        home = np.searchsorted(self.bounds, sizes, "right") - 1
        lower = np.maximum(np.searchsorted(self.bounds, self.least(sizes), "right") - 1, 0)
        sigs, owners = [], []
        which = home.copy()
        while len(chosen := np.flatnonzero(which >= lower)):
            for piece in np.array_split(chosen, max(1, int(sizes[chosen].sum()) >> 20)):
                if len(piece):
                    s, o = self._scheme([sets[keep[k]] for k in piece], which[piece])
                    sigs.append(s)
                    owners.append(np.array(keep)[piece[o]])
            which = which - 1  # as the larger of two sets
        return np.concatenate(sigs), np.concatenate(owners)

    def _scheme(self, sets: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        parts = self.parts[which]
        # hashes are sorted, so the parts of a set are runs of them
        part = ((flat >> U(32)) * parts[owner].astype(U)) >> U(32)
        new = np.concatenate([[True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])])
        at = np.flatnonzero(new)
        salt = which[owner[at]].astype(U) << U(48) ^ part[at]
        sig = mixed(np.add.reduceat(mixed(flat ^ U(0xA5A5A5A5)), at) ^ mixed(salt + U(1)))
        large = np.diff(at, append=len(flat)) > 1
        sigs, owners = [sig[large]], [owner[at[large]]]
        enough = np.bincount(owners[0], minlength=len(sets)) > self.differ[which]
        for k in np.flatnonzero(~enough):
            prefix = sets[k][: sizes[k] - self.least(sizes[k]) + 1]
            sigs.append(mixed(prefix ^ mixed(np.array([(int(which[k]) << 48) + (1 << 47)], U))))
            owners.append(np.full(len(prefix), k))
        return np.concatenate(sigs), np.concatenate(owners)


PLACE = 0xFFFFFFFF


def linked(
    sets: list[np.ndarray], percent: int, side: list[int] | None = None, links: array | None = None
) -> list[int]:
    """The root of each set's component, as an index. ``side``: only pairs of unequal sides are looked up. ``links`` takes
    the two indices and the intersection of every link, one after the other.

    Sets are looked up in the order of their sizes among those before them. One likely partner is tried first; then
    places already connected to the set leave the short lists, which are merged by a heap. Where every link is asked for,
    neither is done."""
    n = len(sets)
    by_size = sorted(range(n), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in by_size], np.int64)
    sides = np.array([side[i] for i in by_size], np.int64) if side else None
    _, rank = np.unique(np.concatenate([sets[i] for i in by_size]), return_inverse=True)
    rank = rank.astype(np.int64) << 32
    # the inverted lists, one after the other: shingle in the upper half, place in the order of sizes in the lower
    lists = np.sort(rank + np.repeat(np.arange(n), sizes))
    ends = np.cumsum(sizes)
    label = np.arange(n)  # the component of each place

    def on(keys: np.ndarray) -> int:
        """How many of the keys are in the lists, by binary search."""
        return int((lists[np.minimum(np.searchsorted(lists, keys), len(lists) - 1)] == keys).sum())

    def unite(q: int, y: int, common: int) -> None:
        if 100 * common >= percent * (int(sizes[q]) + int(sizes[y]) - common):
            if links is not None:
                links.extend((by_size[q], by_size[y], common))
            label[label == label[q]] = label[y]

    for q in range(1, n):
        size = int(sizes[q])
        first = int(np.searchsorted(sizes, -(-percent * size // 100)))  # smaller partners cannot link
        if first >= q:
            continue
        least = -(-percent * (size + int(sizes[first])) // (100 + percent))
        own = rank[ends[q] - size : ends[q]]
        low, high = np.searchsorted(lists, own + first), np.searchsorted(lists, own + q)
        length = high - low
        order = np.flatnonzero(length)
        if len(order) < least:
            continue
        order = order[np.argsort(length[order], kind="stable")]
        aside = min(least - 1, int(least / (0.0085 * log(int(length[order[-1]])) + 1)))
        short, long = order[: len(order) - aside], own[order[len(order) - aside :]]
        need = least - aside
        for y in {int(lists[high[short[0]] - 1]) & PLACE, q - 1} if links is None else ():
            if label[y] != label[q] and (sides is None or sides[y] != sides[q]):
                unite(q, y, on(own + y))
        places = np.concatenate([lists[low[i] : high[i]] for i in short]) & PLACE
        of = np.repeat(np.arange(len(short)), length[short])
        open_ = np.full(len(places), True) if links is not None else label[places] != label[q]
        if sides is not None:
            open_ &= sides[places] != sides[q]
        places, of = places[open_], of[open_]
        if not len(places):
            continue
        merged = [x.tolist() for x in np.split(places, np.flatnonzero(np.diff(of)) + 1)]
        at = [0] * len(merged)
        heap = [(x[0], k) for k, x in enumerate(merged)]
        heapq.heapify(heap)
        while heap:
            y, popped = heap[0][0], []
            while heap and heap[0][0] == y:
                popped.append(heapq.heappop(heap)[1])
            target = y + 1
            if len(popped) >= need:
                if links is not None or label[q] != label[y]:
                    unite(q, y, len(popped) + (on(long + y) if aside else 0))
            else:  # no candidate below the place where enough lists can meet
                for _ in range(need - 1 - len(popped)):
                    if heap:
                        popped.append(heapq.heappop(heap)[1])
                if not heap:
                    break
                target = max(target, heap[0][0])
            for k in popped:
                at[k] = bisect_left(merged[k], target, at[k])
                if at[k] < len(merged[k]):
                    heapq.heappush(heap, (merged[k][at[k]], k))
    out = [0] * n
    for place, i in enumerate(by_size):
        out[i] = by_size[label[place]]
    return out


def set_table(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (the digest; null for an empty set) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text", 2 << 20):
            sets = shingle_sets(texts, width)
            pairs = [digest(x) if len(x) else (None, None) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    *(pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)),
                ],
                ["doc_id", "n_shingles", "h1", "h2"],
            )

    chosen = docs.select(F.col("doc_id").cast("long"), "text")
    return chosen.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long")


def candidate_edges(docs: DataFrame, percent: int, width: int = 4) -> DataFrame:
    """Star edges (a, b) between the first halves of the digests of sets that share a part."""
    scheme = Scheme(percent)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()  # sets of this task, which send once
        for _, texts in blocks(batches, "text", 2 << 20):
            fresh = {}
            for x in shingle_sets(texts, width):
                if len(x) and (h := digest(x)[0]) not in known:
                    fresh[h] = x
            known.update(fresh)
            sig, owner = scheme.signatures(list(fresh.values()))
            ids = np.fromiter(fresh, np.int64, len(fresh))
            for a in range(0, len(sig), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig[part].view(np.int64)), pa.array(ids[owner[part]])], ["sig", "id"]
                )

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, centre = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            s, i = (c.to_numpy() for c in batch.columns)
            new = np.concatenate([[s[0] != sig], s[1:] != s[:-1]])
            first = np.flatnonzero(new)
            centres = np.concatenate([[centre], i[first]])[np.cumsum(new)]
            sig, centre = s[-1], centres[-1]
            far = np.flatnonzero(centres != i)
            if len(far):
                pairs = np.unique(np.stack([centres[far], i[far]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    sent = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(signed, "sig long, id long")
    sorted_ = sent.repartition("sig").sortWithinPartitions("sig", "id")
    return sorted_.mapInArrow(stars, "a long, b long").distinct()


def narrowed_edges(members: DataFrame, percent: int, width: int = 4) -> DataFrame:
    """Star edges (a, b) between sets of one component that share one of the shingles each of them sends; members
    (component, h1, text). Rows of other texts, and all but one of repeated rows, make no difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text", 2 << 20):
            component, h1 = (batch.column(c).to_numpy() for c in ("component", "h1"))
            sets = [x if len(x) and digest(x)[0] == h else x[:0] for x, h in zip(shingle_sets(texts, width), h1, strict=True)]
            sizes = np.array([len(x) for x in sets], np.int64)
            flat, owner = np.concatenate(sets).view(np.int64), np.repeat(np.arange(len(sets)), sizes)
            for a in range(0, len(flat), 1 << 16):
                part = slice(a, a + (1 << 16))
                o = owner[part]
                columns = [component[o], h1[o], sizes[o], flat[part]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["component", "h1", "n", "shingle"])

    same = Window.partitionBy("component", "shingle")
    rows = members.select("component", "h1", "text").mapInArrow(run, "component long, h1 long, n long, shingle long")
    shared = rows.withColumn("sets", F.count(F.lit(1)).over(same)).where("sets > 1")
    held = shared.groupBy("component", "h1", "n").agg(F.array_sort(F.collect_set(F.struct("sets", "shingle"))).alias("held"))
    # shingles that no other set has are the first in order, and need not be sent
    first = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - (F.col("n") - F.size("held"))
    sent = held.withColumn("first", first.cast("int")).where("first > 0")
    sent = sent.select("component", "h1", F.explode(F.slice("held", F.lit(1), F.col("first"))).alias("x"))
    sent = sent.select("component", "h1", F.col("x.shingle").alias("shingle")).withColumn("a", F.min("h1").over(same))
    return sent.where("a <> h1").select("a", F.col("h1").alias("b")).distinct()


LINKS = ["doc_a", "doc_b", "common", "total", "key_a", "key_b", "copies_a", "copies_b"]


def _searched(members: DataFrame, percent: int, width: int, every: bool = False) -> DataFrame:
    """(a, b) from documents to roots in each task, or ``every`` link as LINKS; members (task, side, crossed, doc_id, h1,
    copies, text)."""

    def edges(held: list[tuple], roots: list[int]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for (doc_id, *_), r in zip(held, roots, strict=True):
            least[r] = min(doc_id, least.get(r, doc_id))
        rows = [(d, least[r]) for (d, *_), r in zip(held, roots, strict=True) if d != least[r]]
        if rows:
            a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(a, pa.int64())], ["a", "b"])

    def pairs(held: list[tuple], links: array) -> Iterator[pa.RecordBatch]:
        found = np.frombuffer(links, np.int64).reshape(-1, 3)
        doc, key, copies = (np.array([h[k] for h in held], np.int64) for k in (0, 3, 4))
        n = np.array([len(h[2]) for h in held], np.int64)
        for at in range(0, len(found), 1 << 16):
            x, y, common = found[at : at + (1 << 16)].T
            swap = (doc[x] > doc[y]) | ((doc[x] == doc[y]) & (key[x] > key[y]))
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            columns = [doc[x], doc[y], common, n[x] + n[y] - common, key[x], key[y], copies[x], copies[y]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, crossed = None, False
        sets: dict[tuple[int, int, int], tuple] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            held = list(sets.values())
            if len(held) > 1:
                links = array("q") if every else None
                roots = linked([h[2] for h in held], percent, [h[1] for h in held] if crossed else None, links)
                yield from edges(held, roots) if links is None else pairs(held, links)

        for batch, texts in blocks(batches, "text", 2 << 20):
            columns = (batch.column(c).to_pylist() for c in ("task", "side", "crossed", "doc_id", "h1", "copies"))
            for t, side, cross, doc_id, h1, copies, x in zip(*columns, shingle_sets(texts, width), strict=True):
                if t != task:
                    yield from flush()
                    sets, task, crossed = {}, t, cross
                key = digest(x)
                if key[0] == h1:  # else another text under the same doc_id
                    sets.setdefault((*key, side), (doc_id, side, x, h1, copies))
        yield from flush()

    schema = ", ".join(f"{c} long" for c in (LINKS if every else ["a", "b"]))
    return members.repartition("task").sortWithinPartitions("task", "side", "doc_id").mapInArrow(run, schema)


class _Join:
    """The tables of one join: sets, classes of equal sets, groups above the limit, links."""

    def __init__(self, docs: DataFrame, percent: int, width: int, block_shingles: int, every: bool):
        self.spark, self.made = docs.sparkSession, []
        self.sets = self.table(set_table(docs, width), "sets")
        self.classes = (
            self.sets.where("h1 IS NOT NULL AND doc_id IS NOT NULL")
            .groupBy("h1", "h2")
            .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
        )
        with small_batches(self.spark):
            groups = components(candidate_edges(docs, percent, width))
        grouped = self.table(
            self.classes.join(groups, F.col("h1") == F.col("node")).select(
                F.col("rep").alias("doc_id"), "h1", "n", "copies", "component"
            ),
            "grouped",
        )
        release(self.spark)  # the parts' shuffle is the largest, and done
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.large = self.above(grouped, block_shingles, "large")
        if not self.large.isEmpty():
            members = grouped.join(self.large, "component", "left_semi")
            members = members.join(self.texts_of(members, texts), "doc_id")
            with small_batches(self.spark):
                narrow = components(narrowed_edges(members, percent, width)).withColumnRenamed("component", "narrow")
            inside = grouped.join(self.large.select("component", F.lit(True).alias("inside")), "component", "left")
            inside = inside.join(narrow, F.col("h1") == F.col("node"), "left").where("inside IS NULL OR narrow IS NOT NULL")
            group = F.when(F.col("inside"), F.col("narrow")).otherwise(F.col("component")).alias("component")
            grouped = self.table(inside.select("doc_id", "h1", "n", "copies", group), "narrowed")
            release(self.spark)
            self.large = self.above(grouped, block_shingles, "larger")
        # groups above the limit are dealt into blocks; a task for each pair of blocks
        dealt = grouped.join(self.large, "component", "left").withColumn(
            "count", F.coalesce(F.ceil(2 * F.col("total") / block_shingles), F.lit(1)).cast("int")
        )
        side = F.pmod(F.xxhash64("h1", F.lit("side")), F.col("count")).cast("int")
        dealt = dealt.withColumn("side", side)
        low, high = F.least("side", "other"), F.greatest("side", "other")
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("count") - 1))).select(
            "doc_id",
            "h1",
            "copies",
            "side",
            (F.col("side") != F.col("other")).alias("crossed"),
            F.xxhash64("component", low, high).alias("task"),
        )
        self.found = self.table(_searched(dealt.join(self.texts_of(grouped, texts), "doc_id"), percent, width, every), "links")
        release(self.spark)  # and that of the texts

    def texts_of(self, members: DataFrame, texts: DataFrame) -> DataFrame:
        """The texts under the members' ids. Up to ``BROADCAST_ROWS`` ids go to the texts, so that no other text is
        shuffled; more meet all of them by a shuffle."""
        if members.count() > BROADCAST_ROWS:
            return texts
        return texts.join(F.broadcast(members.select("doc_id")), "doc_id", "left_semi")

    def above(self, grouped: DataFrame, limit: int, name: str) -> DataFrame:
        """The groups of more shingles than the limit."""
        total = grouped.groupBy("component").agg(F.sum("n").alias("total"))
        return self.table(total.where(F.col("total") > limit), name)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(scratch(self.spark, name))
        with small_batches(self.spark):
            df.write.parquet(self.made[-1])
        return self.spark.read.schema(df.schema).parquet(self.made[-1])

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """The table written, and all the others removed."""
        out = self.table(df, name)
        for path in self.made[:-1]:
            delete(self.spark, path)
        return out


def link_components(
    docs: DataFrame, percent: int = 85, width: int = 4, block_shingles: int = 1 << 18
) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    join = _Join(docs, percent, width, block_shingles, every=False)
    if join.large.isEmpty():
        roots = join.found.select(F.col("b").alias("rep"), F.col("a").alias("root"))
    else:
        roots = join.table(components(join.found), "roots")
        roots = roots.select(F.col("node").alias("rep"), F.col("component").alias("root"))
    named = join.classes.join(roots, "rep", "left").where("copies > 1 OR root IS NOT NULL")
    named = named.select("h1", "h2", F.coalesce("root", "rep").alias("component"))
    out = join.sets.join(named, ["h1", "h2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )
    return join.result(out, "components")


def links(docs: DataFrame, percent: int = 85, width: int = 4, block_shingles: int = 1 << 18) -> DataFrame:
    """Every link between two classes of equal sets, once: doc_a and doc_b (the least ids of the classes), common and total
    (sizes of intersection and union), key_a and key_b (the classes' digests), copies_a and copies_b. Documents of one
    class, which ``link_counts`` names, are linked too and not listed."""
    join = _Join(docs, percent, width, block_shingles, every=True)
    return join.result(join.found, "pairs")


def link_counts(docs: DataFrame, percent: int = 85, width: int = 4, block_shingles: int = 1 << 18) -> DataFrame:
    """doc_id, n_shingles, class_id (the least id with an equal set) and n_links (the documents linked with this one, those
    of its own class among them) of every document."""
    join = _Join(docs, percent, width, block_shingles, every=True)
    ends = [join.found.select(F.col(f"key_{x}").alias("h1"), F.col(f"copies_{y}").alias("n")) for x, y in ("ab", "ba")]
    far = ends[0].unionByName(ends[1]).groupBy("h1").agg(F.sum("n").alias("far"))
    named = join.classes.join(far, "h1", "left").where("copies > 1 OR far IS NOT NULL")
    named = named.select("h1", "h2", "rep", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("linked"))
    own = F.col("doc_id").isNotNull()
    out = join.sets.join(named, ["h1", "h2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(own, F.coalesce("rep", "doc_id")).alias("class_id"),
        F.when(own, F.coalesce("linked", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
    return join.result(out, "counts")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component, and those that link with none."""
    found = link_components(docs)
    rest = found.where("component_id <> doc_id").select("doc_id").distinct()
    if rest.count() <= BROADCAST_ROWS:
        rest = F.broadcast(rest)
    kept = docs.join(rest, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(again.dropDuplicates(["doc_id", "text"]))


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT r, hash(list_slice(ws, i, i + 3)) AS w FROM (
    SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
both_ AS (
  SELECT a.r AS x, b.r AS y, count(*) AS k FROM g a JOIN g b ON a.w = b.w AND a.r < b.r GROUP BY ALL
), e AS (
  SELECT x, y FROM both_ JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (
  SELECT r AS x, r AS y FROM d UNION SELECT reach.x, u.y FROM reach JOIN u ON reach.y = u.x
)
SELECT a.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(b.doc_id) AS component_id
FROM reach JOIN d a ON a.r = reach.x JOIN d b ON b.r = reach.y LEFT JOIN n ON n.r = a.r
GROUP BY a.r, a.doc_id
"""
