"""Records of equal contents as one class, so that work on pairs is done once for each pair of classes.

A class frame is read as a frame of records: entity_id is the class, n its number of records, least the first of their
ids. An id with several rows is in the class of the ids with the same rows, which has a row for each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Records in one list of a class, about; pairs of lists are what tasks share out.
LIST = 1024


def kept(df: DataFrame) -> DataFrame:
    """Computed once and read from there. A persisted frame would keep its plan, and frames that many joins read make a plan
    that the driver plans for longer than the tasks run: so it is a checkpoint where the cluster has a folder for it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir():
        return df.checkpoint()
    return df.localCheckpoint() if context.master.startswith("local[") else df.persist()


def _contents(records: DataFrame) -> list[str]:
    return [c for c in records.columns if c != "entity_id"]


def _digest(records: DataFrame) -> Column:
    return F.md5(F.to_json(F.struct(*_contents(records))))


def members(records: DataFrame, source: str) -> DataFrame:
    """(entity_id, class): a class is named by its source and the 128-bit digests of its rows."""
    rows = records.select("entity_id", _digest(records).alias("row")).groupBy("entity_id")
    digests = F.array_join(F.array_sort(F.collect_list("row")), " ")
    return rows.agg(F.concat(F.lit(f"{source}-"), digests).alias("class"))


def representatives(records: DataFrame, of: DataFrame) -> DataFrame:
    """The class frame of records and their ``members``: entity_id, n, least and the other columns of the records."""
    contents = records.select(_digest(records).alias("row"), *_contents(records)).distinct()
    each = of.groupBy(F.col("class").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("least"))
    rows = F.split(F.substring_index("entity_id", "-", -1), " ")
    return each.withColumn("row", F.explode(rows)).join(contents, "row").drop("row")


def with_sizes(pairs: DataFrame, c1: DataFrame, cx: DataFrame) -> DataFrame:
    """Pairs of classes with n and least of both sides."""
    for side, found in (("s1", c1), ("sx", cx)):
        names = {"entity_id": f"{side}_id", "n": f"{side}_n", "least": f"{side}_least"}
        pairs = pairs.join(found.select(*names).distinct().withColumnsRenamed(names), f"{side}_id")
    return pairs


def expand_side(pairs: DataFrame, of: DataFrame, side: str) -> DataFrame:
    """One side's class replaced by its records, a row for each."""
    name = f"{side}_id"
    ids = of.select(F.col("class").alias(name), F.col("entity_id").alias("_id"))
    return pairs.join(ids, name).drop(name).withColumnRenamed("_id", name).select(*pairs.columns)


def listed(frame: DataFrame, of: DataFrame) -> DataFrame:
    """A class frame with the ids of its records in lists: part and ids, a row for each list."""
    count = of.groupBy("class").agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64("entity_id"), F.ceil(F.col("_n") / LIST)).alias("part")
    lists = of.join(count, "class").groupBy("class", part).agg(F.collect_list("entity_id").alias("ids"))
    return frame.join(lists.withColumnRenamed("class", "entity_id"), "entity_id")


def parted(edges: DataFrame, l1: DataFrame, lx: DataFrame) -> DataFrame:
    """Pairs of classes as pairs of lists of their records, which tasks can share out; see ``features.attach_text``."""
    for side, found in (("s1", l1), ("sx", lx)):
        parts = found.select(F.col("entity_id").alias(f"{side}_id"), F.col("part").alias(f"{side}_part")).distinct()
        edges = edges.join(parts, f"{side}_id")
    return edges


def unlisted(pairs: DataFrame) -> DataFrame:
    """Each pair of lists as its pairs of records."""
    columns = [c for c in pairs.columns if c not in ("s1_ids", "sx_ids")]
    for side in ("s1", "sx"):
        pairs = pairs.withColumn(f"{side}_id", F.explode(f"{side}_ids")).drop(f"{side}_ids")
    return pairs.select(*columns)
