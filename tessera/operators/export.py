"""Result lists: export, import, validation and checks after writing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_lists(pairs: DataFrame, name: str) -> DataFrame:
    """One sorted list of distinct targets per record, comma-joined."""
    ids = F.array_join(F.array_sort(F.collect_set("sx_id")), ",")
    return pairs.groupBy(F.col("s1_id").alias("source1_entity_id")).agg(ids.alias(name))


def export_lists(s1: DataFrame, by_source: list[DataFrame], name: str = "matched_entity_ids") -> DataFrame:
    """A row for every record, with its targets of all sources in their order; empty where there is none."""
    out = s1.select(F.col("entity_id").alias("source1_entity_id")).distinct()
    for k, pairs in enumerate(by_source):
        out = out.join(id_lists(pairs, f"_{k}"), "source1_entity_id", "left")
    parts = [F.nullif(F.coalesce(f"_{k}", F.lit("")), F.lit("")) for k in range(len(by_source))]
    return out.select("source1_entity_id", F.concat_ws(",", *parts).alias(name))


def import_lists(lists: DataFrame, name: str = "candidate_entity_ids") -> DataFrame:
    """(s1_id, sx_id, source) of all lists; each source is a filter, or a partition when written."""
    ids = F.explode(F.split(F.coalesce(name, F.lit("")), ","))
    pairs = lists.select(F.col("source1_entity_id").alias("s1_id"), ids.alias("sx_id"))
    pairs = pairs.withColumn("sx_id", F.trim("sx_id")).where("sx_id <> ''")
    return pairs.distinct().withColumn("source", F.split_part("sx_id", F.lit("-"), F.lit(1)))


RULES = [
    "duplicate_s1", "duplicate_id", "self_match", "wrong_prefix", "unknown_id", "missing_s1", "extra_s1",
]


def validate(lists: DataFrame, s1: DataFrame, name: str = "matched_entity_ids", known: DataFrame | None = None) -> DataFrame:
    """(rule, findings): a row for each rule, 0 where nothing is wrong. ``known``: entity_id of all targets."""
    rows = lists.select(F.col("source1_entity_id").alias("s1_id"), F.coalesce(name, F.lit("")).alias("ids"))
    each = rows.where("ids <> ''").select("s1_id", F.posexplode(F.split("ids", ",")).alias("_at", "id"))
    ids = s1.select(F.col("entity_id").alias("s1_id")).distinct()
    found = {
        "duplicate_s1": rows.groupBy("s1_id").count().where("count > 1"),
        "duplicate_id": each.groupBy("s1_id", "id").count().where("count > 1"),
        "self_match": each.where("s1_id = id"),
        "wrong_prefix": each.where(~F.col("id").rlike("^S[23]-")),
        "missing_s1": ids.join(rows, "s1_id", "left_anti"),
        "extra_s1": rows.join(ids, "s1_id", "left_anti"),
    }
    if known is not None:
        found["unknown_id"] = each.join(known.select(F.col("entity_id").alias("id")), "id", "left_anti")
    counted = [d.agg(F.count(F.lit(1)).alias("findings")).select(F.lit(k).alias("rule"), "findings") for k, d in found.items()]
    return reduce(DataFrame.unionByName, counted)


def not_contained(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links that were no candidates."""
    return matches.select("s1_id", "sx_id").distinct().join(candidates.select("s1_id", "sx_id"), ["s1_id", "sx_id"], "left_anti")


def target_conflicts(matches: DataFrame) -> DataFrame:
    """Targets that more than one record has, and how many."""
    counted = matches.groupBy("sx_id").agg(F.countDistinct("s1_id").alias("n_s1"))
    return counted.where("n_s1 > 1")


def summary(lists: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """Rows, empty rows, links by source and in all."""
    ids = F.filter(F.split(F.coalesce(name, F.lit("")), ","), lambda x: x != "")
    of = lambda k: F.coalesce(F.sum(F.size(F.filter("ids", lambda x: x.startswith(f"S{k}-")))), F.lit(0)).cast("long")
    return lists.select(ids.alias("ids")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.size("ids") == 0, 1)).alias("empty_rows"),
        of(2).alias("s2_links"),
        of(3).alias("s3_links"),
        F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long").alias("links"),
    )
