"""From scores to links: thresholds, blends, one record per target, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import classes

# Final thresholds of the two targets and the rule for records left without a link.
THRESHOLDS = {"S2": 0.44, "S3": 0.47}
RECOVERY_SCORE, RECOVERY_MARGIN = 0.85, 0.15


def above(pairs: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return pairs.where(F.col(score) >= threshold)


def above_by_target(pairs: DataFrame, thresholds: dict[str, float] = THRESHOLDS, score: str = "score") -> DataFrame:
    """Each target source against its own threshold."""
    limit = F.lit(None).cast("double")
    for source, value in thresholds.items():
        limit = F.when(F.col("sx_id").startswith(f"{source}-"), F.lit(value)).otherwise(limit)
    return pairs.where(F.col(score) >= limit)


def blend(pairs: DataFrame, first: str, second: str, alpha: float = 0.5, name: str = "score") -> DataFrame:
    return pairs.withColumn(name, (1 - alpha) * F.col(first) + alpha * F.col(second))


def _placed(pairs: DataFrame, of: str, other: str, score: str, second: bool = True) -> DataFrame:
    """Adds _p, the place of a pair among those of one side, and _second, the runner-up's score or 0. The records of a class
    on the other side have equal scores, so the best class is its own runner-up where it has two or more."""
    window, grouped = Window.partitionBy(f"{of}_id"), f"{other}_least" in pairs.columns
    first = f"{other}_least" if grouped else f"{other}_id"
    placed = pairs.withColumn("_p", F.row_number().over(window.orderBy(F.desc(score), first)))
    if not second:
        return placed
    runner = F.col("_p") == 2
    if grouped:
        runner = runner | ((F.col("_p") == 1) & (F.col(f"{other}_n") > 1))
    return placed.withColumn("_second", F.coalesce(F.max(F.when(runner, F.col(score))).over(window), F.lit(0.0)))


def linked(best: DataFrame, of: DataFrame, side: str = "sx", score: str = "score") -> DataFrame:
    """The pairs of records of the best pairs of classes: each record of one side's class with the first of the other's."""
    other = "s1" if side == "sx" else "sx"
    ids = {side: F.col(f"{side}_id"), other: F.col(f"{other}_least").alias(f"{other}_id")}
    return classes.expand_side(best.select(ids["s1"], ids["sx"], score), of, side)


def exclusive(pairs: DataFrame, score: str = "score", margin: float = 0.0) -> DataFrame:
    """The best pair of each target, ties to the least s1_id; with a margin, only where the runner-up is that far below
    or there is none. Of pairs of classes with their sizes: the best pair of each record of a target class, see ``linked``."""
    placed = _placed(pairs, "sx", "s1", score, second=bool(margin))
    if margin:
        placed = placed.where((F.col(score) - F.col("_second") >= margin) | (F.col("_second") == 0)).drop("_second")
    return placed.where("_p = 1").drop("_p")


def recovered(pairs: DataFrame, links: DataFrame, score: str = "score", of: DataFrame | None = None) -> DataFrame:
    """For records without a link: their best pair, if it is good and far above the next. ``of``: the members of the classes
    of records, where pairs are pairs of classes with their sizes."""
    placed = _placed(pairs, "s1", "sx", score)
    good = (F.col("_p") == 1) & (F.col(score) >= RECOVERY_SCORE) & (F.col(score) - F.col("_second") >= RECOVERY_MARGIN)
    best = placed.where(good).drop("_p", "_second")
    return (linked(best, of, "s1", score) if of else best).join(links.select("s1_id").distinct(), "s1_id", "left_anti")


def apply_delta(matches: DataFrame, delta: DataFrame) -> DataFrame:
    """Lists of a delta for records whose list is empty; a filled list is never overwritten."""
    new = delta.select("source1_entity_id", F.col("matched_entity_ids").alias("_new"))
    old = F.coalesce("matched_entity_ids", F.lit(""))
    return matches.join(new, "source1_entity_id", "left").select(
        "source1_entity_id", F.when(old == "", F.coalesce("_new", F.lit(""))).otherwise(old).alias("matched_entity_ids")
    )


def keep_best(frames: list[DataFrame], score: str = "score") -> DataFrame:
    """Rows of several frames, one per pair: the best score, else the earlier frame."""
    rows = None
    for k, frame in enumerate(frames):
        tagged = frame.withColumn("_k", F.lit(k))
        rows = tagged if rows is None else rows.unionByName(tagged, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("s1_id", "sx_id").orderBy(F.desc(score), "_k"))
    return rows.withColumn("_p", place).where("_p = 1").drop("_p", "_k")


def delta_faults(before: DataFrame, delta: DataFrame, after: DataFrame) -> DataFrame:
    """(rule, findings) of an applied delta: rows more or fewer than before, filled lists that changed, lists of the delta
    for records that are not there, and empty lists whose delta did not arrive."""
    key, ids = "source1_entity_id", "matched_entity_ids"
    sides = [d.select(key, F.coalesce(ids, F.lit("")).alias(n)) for d, n in ((before, "_b"), (delta, "_d"), (after, "_a"))]
    one = sides[0].join(sides[1], key, "full").join(sides[2], key, "full")
    counts = {
        "rows": F.abs(F.count("_b") - F.count("_a")),
        "overwritten": F.count(F.when((F.col("_b") != "") & ~F.col("_a").eqNullSafe(F.col("_b")), 1)),
        "unknown_record": F.count(F.when(F.col("_d").isNotNull() & F.col("_b").isNull(), 1)),
        "not_applied": F.count(F.when((F.col("_b") == "") & ~F.col("_a").eqNullSafe(F.coalesce("_d", F.lit(""))), 1)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("rule"), v.cast("long").alias("findings")) for k, v in counts.items()])
    return one.agg(rows.alias("x")).select(F.explode("x").alias("x")).select("x.*")
