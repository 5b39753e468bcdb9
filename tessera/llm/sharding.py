"""Shards by a hierarchical weighted hash tree, in DataFrame functions only.

Every row descends from the root through region and rack to a shard. At each node each child draws ``-ln(u) / weight``,
where u is a hash of the key and of the child's name, and the least draw wins: a child gets rows in proportion to its
weight, and when one weight changes, rows only move into or out of the subtree that holds it.

A tree is planned in whole regions, of which the last may have shards that are not open yet. Planned weights decide the
draws, so opening a shard changes no weight. A child's draw counts on from its node's: the winner has the node's draw and
another child that plus its distance to the winner, which makes every shard's draw an exponential of its own weight. In a
whole subtree the least of them is found by following the winners; in one that is partly open the open children are
compared. So a new shard takes only rows that draw it, and takes them into itself alone (``even(n)`` to ``even(n + 1)``).

Law ``key``: doc_id and the tree alone decide, so equal ids lie together, and any task finds a row's place alone.
Nulls: a null doc_id is a key of its own; a null text has no bytes. Empty tables give no rows. Rows with equal doc_id
share a shard and get different slots, in the order of their checksum and size. Other columns are ignored. A tree without
an open shard of positive weight is an error.

Slots are numbered without bringing a shard into one task: rows are dealt to ``buckets`` parts of each shard by a hash
of the key, counted by bucket from the key column alone, and numbered inside the bucket after the counts of the
buckets before. Those counts, shards times buckets rows, are all that is broadcast. One bucket holds all rows of one
doc_id, so an id that repeats without end would make a long bucket; ids are unique in a table of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """region -> rack -> shard number -> planned weight, and the shards that are open (None: all)."""

    regions: dict[str, dict[str, dict[int, float]]]
    opened: int | None = None

    @staticmethod
    def even(shards: int, per_rack: int = 2, per_region: int = 4) -> Tree:
        """Shards 0 to ``shards - 1`` of equal weight; the last region is planned whole."""
        regions: dict[str, dict[str, dict[int, float]]] = {}
        for k in range(-(-shards // per_region) * per_region):
            racks = regions.setdefault(f"region{k // per_region}", {})
            racks.setdefault(f"rack{k % per_region // per_rack}", {})[k] = 1.0
        return Tree(regions, shards)

    def shards(self) -> list[int]:
        """The open shards; one without weight gets no rows and is none."""
        every = (s for racks in self.regions.values() for rack in racks.values() for s, w in rack.items() if w > 0)
        return sorted(s for s in every if self.opened is None or s < self.opened)


def _draws(key: Column, children: list[tuple[str, float]]) -> list[Column]:
    """An exponential draw for each child with its weight as rate; 52 bits of the hash make u, never 0."""
    out = []
    for name, weight in children:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 12).cast("double") + 0.5) / float(2**52)
        out.append(-F.log(u) / weight)
    return out


def _weight(node: dict | float) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else node


def _leaves(node: dict | float, name: int | str) -> list[int]:
    """The shards below a node that have weight."""
    return [s for k, child in node.items() for s in _leaves(child, k)] if isinstance(node, dict) else [name] if node > 0 else []


def _least(columns: list[Column]) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


def _winner(key: Column, path: str, node: dict) -> Column:
    """The shard that a row reaches in a subtree whose shards are all open: each row descends into one child only."""
    children = [(k, c) for k, c in node.items() if _weight(c) > 0]
    below = [_winner(key, f"{path}/{k}", c) if isinstance(c, dict) else F.lit(k) for k, c in children]
    if len(children) == 1:
        return below[0]
    draws = _draws(key, [(f"{path}/{k}", _weight(c)) for k, c in children])
    first = F.least(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(draws)])["i"]
    out = below[-1]
    for i in reversed(range(len(below) - 1)):
        out = F.when(first == i, below[i]).otherwise(out)
    return out


def _reached(key: Column, path: str, node: dict, draw: Column, opened: set[int]) -> Column:
    """struct(draw, shard) of the open shard of least draw below a node whose own draw is ``draw``."""
    if set(_leaves(node, path)) <= opened:
        return F.struct(draw.alias("d"), _winner(key, path, node).cast("int").alias("s"))
    children = [(k, c) for k, c in node.items() if _weight(c) > 0]
    draws = _draws(key, [(f"{path}/{k}", _weight(c)) for k, c in children])
    least, out = _least(draws), []
    for (k, child), own in zip(children, draws, strict=True):
        later = draw + (own - least)
        if isinstance(child, dict):
            if opened & set(_leaves(child, k)):
                out.append(_reached(key, f"{path}/{k}", child, later, opened))
        elif k in opened:
            out.append(F.struct(later.alias("d"), F.lit(k).cast("int").alias("s")))
    return _least(out)


def shard_of(tree: Tree, *key: Column) -> Column:
    """The shard number of a key."""
    hashed, opened = F.xxhash64(F.lit("shard"), *key), set(tree.shards())
    if not opened:
        raise ValueError("the tree has no open shard with a weight")
    regions = [(name, node) for name, node in tree.regions.items() if opened & set(_leaves(node, name))]
    if len(regions) == 1 and set(_leaves(regions[0][1], "")) <= opened:
        return _winner(hashed, *regions[0]).cast("int")
    draws = _draws(hashed, [(name, _weight(node)) for name, node in regions])
    return _least([_reached(hashed, name, node, d, opened) for (name, node), d in zip(regions, draws, strict=True)])["s"]


def with_shards(docs: DataFrame, tree: Tree, grown: Tree, buckets: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard) and grown_shard (that in the tree ``grown``);
    slots are numbered over narrow rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    place = {
        "shard": shard_of(tree, F.col("doc_id")),
        "bucket": F.pmod(F.xxhash64(F.lit("bucket"), F.col("doc_id")), F.lit(buckets)).cast("int"),
    }
    counts = docs.select("doc_id").withColumns(place).groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        narrow.withColumns(place)
        .withColumn("row", F.row_number().over(inside))
        .join(F.broadcast(first), ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            (F.col("first") + F.col("row") - 1).cast("long").alias("slot"),
            shard_of(grown, F.col("doc_id")).alias("grown_shard"),
        )
    )


def write_shards(docs: DataFrame, tree: Tree, path: str, files: int = 16) -> None:
    """Writes whole rows to ``path/shard=K``, each shard in ``files`` files of about equal rows."""
    part = F.pmod(F.xxhash64(F.lit("file"), F.col("doc_id")), F.lit(files)).cast("int")
    placed = docs.withColumn("shard", shard_of(tree, F.col("doc_id")))
    count = len(tree.shards()) * files
    placed.repartition(count, "shard", part).write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = with_shards(docs, Tree.even(8), Tree.even(9))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
