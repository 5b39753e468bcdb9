"""Evidence from competing and sibling pairs, as windows over the record or the target; ties go by ids.

The windows of one key share one exchange and sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(key: str, score: str):
    return Window.partitionBy(key), Window.partitionBy(key).orderBy(F.desc(score), "s1_id", "sx_id")


def _second(rank: Column, score: str, window) -> Column:
    return F.coalesce(F.max(F.when(rank == 2, F.col(score))).over(window), F.lit(0.0))


def _mean(score: Column, window) -> Column:
    """The mean of scores of six digits, summed as integers: no order of rows changes it."""
    return F.sum(F.round(score * 1e6).cast("long")).over(window) / F.count(F.lit(1)).over(window) / 1e6


def competition(pairs: DataFrame, score: str = "score") -> DataFrame:
    """How a pair stands among the pairs of its record and of its target."""
    s1, by_s1 = _over("s1_id", score)
    sx, by_sx = _over("sx_id", score)
    own, n, rank = F.col(score), F.col("cand_count"), F.col("cand_rank")
    ranked = pairs.withColumns({"cand_rank": F.row_number().over(by_s1).cast("long"), "cand_count": F.count(F.lit(1)).over(s1)})
    ranked = ranked.withColumns(
        {"top1_score": F.max(own).over(s1), "_mean": _mean(own, s1), "target_rank": F.row_number().over(by_sx).cast("long")}
    ).withColumns(
        {
            "score_diff_top1": F.col("top1_score") - own,
            "score_ratio_top1": own / (F.col("top1_score") + 1e-6),
            "score_diff_mean": own - F.col("_mean"),
            "score_percentile": F.when(n == 1, F.lit(1.0)).otherwise((n - rank) / (n - 1)),
            "target_candidate_count": F.count(F.lit(1)).over(sx),
            "target_best_base_score": F.max(own).over(sx),
            "target_second_best_base_score": _second(F.col("target_rank"), score, sx),
        }
    )
    best, second = F.col("target_best_base_score"), F.col("target_second_best_base_score")
    return ranked.withColumns(
        {
            "target_margin": best - second,
            "target_score_ratio": own / (best + 1e-6),
            "target_is_best_candidate": (F.col("target_rank") == 1).cast("int"),
        }
    ).drop("_mean")


def collective(pairs: DataFrame, score: str = "score", support: float = 0.6) -> DataFrame:
    """Siblings of a pair under its record, copies of its target, and its rivals for the target."""
    s1, by_s1 = _over("s1_id", score)
    sx, by_sx = _over("sx_id", score)
    own = F.col(score)
    key = F.concat(F.lower(F.trim("sx_name")), F.lit("___"), F.trim("sx_post"))
    cluster, both = Window.partitionBy("cluster"), Window.partitionBy("cluster", "s1_id")
    placed = pairs.withColumns({"_r": F.row_number().over(by_s1), "cluster": key})
    placed = placed.withColumns(
        {
            "sibling_support_count": F.sum((own >= support).cast("int")).over(s1) - (own >= support).cast("int"),
            "_top": F.max(own).over(s1),
            "_next": _second(F.col("_r"), score, s1),
        }
    ).withColumn("best_sibling_score", F.when(F.col("_r") == 1, F.col("_next")).otherwise(F.col("_top")))
    placed = placed.withColumns(
        {
            "sibling_margin": own - F.col("best_sibling_score"),
            "has_sibling_support": (F.col("best_sibling_score") >= support).cast("int"),
            "_t": F.row_number().over(by_sx),
        }
    ).withColumns({"_best": F.max(own).over(sx), "_runner": _second(F.col("_t"), score, sx)})
    placed = placed.withColumns(
        {
            "target_stage1_margin": F.when(F.col("_t") == 1, F.col("_best") - F.col("_runner")).otherwise(own - F.col("_best")),
            "target_stage1_is_best": (F.col("_t") == 1).cast("int"),
            "cluster_size": F.count(F.lit(1)).over(cluster),
            "cluster_s1_agreement": F.count(F.lit(1)).over(both) / F.count(F.lit(1)).over(cluster),
            "cluster_max_score": F.max(own).over(cluster),
        }
    )
    return placed.withColumnsRenamed({"_best": "target_stage1_top1", "_runner": "target_stage1_runner_up"}).drop(
        "_r", "_t", "_top", "_next", "cluster"
    )


def secondary(pairs: DataFrame, label: str = "label") -> DataFrame:
    """Marks the true pairs of records that have more than one."""
    count = F.sum(F.col(label)).over(Window.partitionBy("s1_id"))
    return pairs.withColumn("is_secondary", ((F.col(label) == 1) & (count > 1)).cast("int"))


def hard_negatives(pairs: DataFrame, score: str = "score", label: str = "label", most: int = 6) -> DataFrame:
    """All true pairs and the best false ones of each record."""
    place = F.row_number().over(Window.partitionBy("s1_id", label).orderBy(F.desc(score), "sx_id"))
    return pairs.withColumn("_p", place).where((F.col(label) == 1) | (F.col("_p") <= most)).drop("_p")


def shuffled(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """The rows in a random order that the keys and the seed fix, by ``shuffle_key``; a range sort, so no task holds all."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))
    return df.withColumn("shuffle_key", key).orderBy("shuffle_key", *keys)
