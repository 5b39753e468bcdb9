"""Whole runs: ingest, block, score, assign, export, check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import assign, blocking, classes, export, features, metrics
from tessera.sources import files


def ingest(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Raw records to normalized records in Parquet, and these read back."""
    files.write_parquet(T.normalized(files.read_records(spark, path)), out)
    return files.read_parquet(spark, out)


def block(s1: DataFrame, sx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct candidates, and a row of diagnostics for each view and for their union."""
    passes = {name: view(s1, sx) for name, view in blocking.PASSES.items()}
    union = reduce(DataFrame.unionByName, passes.values()).distinct()
    rows = [blocking.diagnostics(pairs, name) for name, pairs in {**passes, "union": union}.items()]
    return union, reduce(DataFrame.unionByName, rows)


def split_of(identity: Column) -> Column:
    """Validation, training or rest, by the bucket of the id."""
    k = T.bucket(identity, "v1")
    return F.when(k < 5, "val1").when((k >= 10) & (k < 25), "train_gate").when((k >= 25) & (k < 30), "val2").otherwise("rest")


Sources = dict[str, tuple[DataFrame, DataFrame]]


def score_classes(sources: Sources, target: str) -> DataFrame:
    """(s1_id, sx_id, score) of the candidate pairs of classes, with sizes and first ids of both; kept, since a plan that
    goes on from here would repeat the score's expression wherever it is named."""
    c1, cx = sources["S1"][0], sources[target][0]
    pairs = features.proxy_score(features.attach_text(blocking.block_union(c1, cx), c1, cx))
    return classes.kept(classes.with_sizes(pairs.select("s1_id", "sx_id", "score"), c1, cx))


def match_classes(sources: Sources, thresholds: dict[str, float] = assign.THRESHOLDS, recover: bool = True) -> DataFrame:
    """``match`` of the classes and members of S1 and of all targets."""
    targets = [k for k in sources if k in thresholds]
    pairs = reduce(DataFrame.unionByName, (score_classes(sources, k) for k in targets))
    members = reduce(DataFrame.unionByName, (sources[k][1] for k in targets))
    links = assign.linked(assign.exclusive(assign.above_by_target(pairs, thresholds)), members)
    if not recover:
        return links
    links = classes.kept(links)
    again = assign.recovered(pairs, links, of=sources["S1"][1])
    again = assign.exclusive(again.join(links.select("sx_id"), "sx_id", "left_anti"))
    return links.unionByName(again.select(*links.columns))


def match(s1: DataFrame, targets: dict[str, DataFrame], thresholds: dict[str, float] = assign.THRESHOLDS) -> DataFrame:
    """(s1_id, sx_id, score): candidates of all targets, scored, above their thresholds, one record per target, and the
    recovered pairs of records left without one. Records of equal contents are compared once, as a class."""
    sources = {}
    for name, records in {"S1": s1, **targets}.items():
        members = classes.kept(classes.members(records, name))
        sources[name] = (classes.kept(classes.representatives(records, members)), members)
    return match_classes(sources, thresholds)


def report(links: DataFrame, s1: DataFrame, gold: DataFrame) -> DataFrame:
    """The metric of a run on a universe of records."""
    return metrics.macro_f(links, gold, s1.select(F.col("entity_id").alias("s1_id")))


def export_run(links: DataFrame, s1: DataFrame) -> DataFrame:
    """The result list of all records, targets of source 2 before those of source 3."""
    return export.export_lists(s1, [links.where(F.col("sx_id").startswith(f"S{k}-")) for k in (2, 3)])
