"""Evaluation of links against gold pairs. Pairs are counted and joined, never collected into sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["s1_id", "sx_id"]


def _size(pairs: DataFrame, *sides: str) -> Column:
    """The pairs of records that a row stands for: 1, or for pairs of classes the product of their sizes."""
    return reduce(lambda x, side: x * F.col(side) if side in pairs.columns else x, sides, F.lit(1)).cast("long")


def explode_gold(truth: DataFrame) -> DataFrame:
    """(s1_id, sx_id) from lists of ids; empty lists give no pair."""
    ids = F.explode(F.split("matched_entity_ids", ","))
    pairs = truth.where(F.col("matched_entity_ids") != "").select(F.col("source1_entity_id").alias("s1_id"), ids.alias("sx_id"))
    return pairs.withColumn("sx_id", F.trim("sx_id")).where("sx_id <> ''")


def clean_gold(gold: DataFrame, source: str) -> DataFrame:
    """Pairs whose target lies in one source, filtered after the lists are taken apart."""
    return gold.where(F.col("sx_id").startswith(f"{source}-"))


def labelled(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds label: 1 for gold pairs, else 0."""
    marked = gold.select(*PAIR).distinct().withColumn("_g", F.lit(1))
    return pairs.join(marked, PAIR, "left").withColumn("label", F.coalesce("_g", F.lit(0))).drop("_g")


def _f_beta(tp: Column, predicted: Column, true: Column, beta: float) -> tuple[Column, Column, Column]:
    p = F.when((predicted == 0) & (true == 0), F.lit(1.0)).when(predicted == 0, F.lit(0.0)).otherwise(tp / predicted)
    r = F.when((predicted == 0) & (true == 0), F.lit(1.0)).when(true == 0, F.lit(0.0)).otherwise(tp / true)
    weight = beta * beta
    f = F.when(p + r == 0, F.lit(0.0)).otherwise((1 + weight) * p * r / (weight * p + r))
    return p, r, f


def per_entity(predicted: DataFrame, gold: DataFrame, universe: DataFrame, beta: float = 0.5) -> DataFrame:
    """Precision, recall and F of every record of the universe; both sides empty is a right answer."""
    marked = predicted.select(*PAIR).distinct().withColumn("p", F.lit(1)).join(
        gold.select(*PAIR).distinct().withColumn("t", F.lit(1)), PAIR, "full"
    )
    counted = marked.groupBy("s1_id").agg(
        F.count("p").alias("n_pred"), F.count("t").alias("n_true"), F.count(F.when(F.col("p") == F.col("t"), 1)).alias("tp")
    )
    joined = universe.select("s1_id").distinct().join(counted, "s1_id", "left").fillna(0)
    p, r, f = _f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true"), beta)
    return joined.withColumns({"precision": p, "recall": r, "f": f})


def macro_f(predicted: DataFrame, gold: DataFrame, universe: DataFrame, beta: float = 0.5) -> DataFrame:
    """Means over records, the share of records without gold that stay empty, and the number of predicted pairs."""
    single = F.col("n_true") == 0
    right = F.count(F.when(single & (F.col("n_pred") == 0), 1))
    return per_entity(predicted, gold, universe, beta).agg(
        F.round(F.avg("f"), 5).alias("macro_f05"),
        F.round(F.avg("precision"), 5).alias("macro_precision"),
        F.round(F.avg("recall"), 5).alias("macro_recall"),
        F.count(F.lit(1)).alias("total_s1"),
        F.count(F.when(single, 1)).alias("total_singletons"),
        right.alias("singletons_correct"),
        F.when(F.count(F.when(single, 1)) == 0, F.lit(1.0)).otherwise(F.round(right / F.count(F.when(single, 1)), 5)).alias("singleton_accuracy"),
        F.sum("n_pred").alias("predicted_matches"),
    )


def threshold_sweep(pairs: DataFrame, gold: DataFrame, universe: DataFrame, thresholds: list[float], score: str = "score") -> DataFrame:
    """Macro scores at every threshold, in one pass.

    Per record the pairs are taken in descending score: at a threshold the record's counts are those of its last pair
    above it. So each pair goes to one step of the list, steps are summed per record, and running sums over the few
    steps give all thresholds; pairs are not repeated for each of them.

    Of classes of records, ``sx_n`` in pairs and gold and ``n`` in the universe are the records that a row stands for."""
    steps = sorted(thresholds, reverse=True)
    step = F.lit(len(steps))
    for k in reversed(range(len(steps))):
        step = F.when(F.col(score) >= steps[k], F.lit(k)).otherwise(step)
    marked = labelled(pairs.select(*PAIR, score, _size(pairs, "sx_n").alias("_n")), gold).withColumn("step", step).where(F.col("step") < len(steps))
    counts = marked.groupBy("s1_id").agg(
        *[F.sum(F.when(F.col("step") <= k, F.col("_n")).otherwise(0)).alias(f"p{k}") for k in range(len(steps))],
        *[F.sum(F.when((F.col("step") <= k) & (F.col("label") == 1), F.col("_n")).otherwise(0)).alias(f"t{k}") for k in range(len(steps))],
    )
    each = gold.select(*PAIR, _size(gold, "sx_n").alias("_n")).distinct()
    true = each.groupBy("s1_id").agg(F.sum("_n").alias("n_true"))
    joined = universe.select("s1_id", _size(universe, "n").alias("n")).distinct().join(counts, "s1_id", "left").join(true, "s1_id", "left").fillna(0)
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(float(t)).alias("threshold"), F.col(f"p{k}").alias("n_pred"), F.col(f"t{k}").alias("tp"))
                for k, t in enumerate(steps)
            ]
        )
    )
    long = joined.select("n", "n_true", rows.alias("x")).select("n", "n_true", "x.*")
    p, r, f = _f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true"), 0.5)
    return (
        long.withColumns({"p": p, "r": r, "f": f})
        .groupBy("threshold")
        .agg(
            F.round(F.sum(F.col("f") * F.col("n")) / F.sum("n"), 5).alias("macro_f05"),
            F.round(F.sum(F.col("p") * F.col("n")) / F.sum("n"), 5).alias("macro_precision"),
            F.round(F.sum(F.col("r") * F.col("n")) / F.sum("n"), 5).alias("macro_recall"),
            F.sum(F.col("n_pred") * F.col("n")).alias("predicted_matches"),
        )
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The least threshold of the best F."""
    return sweep.orderBy(F.desc("macro_f05"), "threshold").limit(1)


def candidate_recall(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold pairs, those among the candidates, their share, candidates, and records with candidates; of records, or of
    classes with their sizes."""
    pairs = candidates.select(*PAIR, _size(candidates, "s1_n", "sx_n").alias("c"), _size(candidates, "s1_n").alias("n")).distinct()
    both = gold.select(*PAIR, _size(gold, "s1_n", "sx_n").alias("g")).distinct().join(pairs, PAIR, "full")
    each = both.groupBy("s1_id").agg(
        F.sum("g").alias("g"), F.sum(F.when(F.col("c").isNotNull(), F.col("g"))).alias("b"), F.sum("c").alias("c"), F.max("n").alias("n")
    )
    total, found = (F.coalesce(F.sum(x), F.lit(0)) for x in "gb")
    return each.agg(
        total.alias("total_gold"),
        found.alias("gold_covered"),
        F.round(found / F.greatest(total, F.lit(1)), 6).alias("recall"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("candidates"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("s1_with_candidates"),
    )


def retrieval_report(baseline: DataFrame, retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """For the baseline, the retrieval and their union: candidates, gold pairs among them and their share of all; for the
    last two also the gold pairs that the baseline lacks, and new candidates for each of them (null where there is none)."""
    marked = [d.select(*PAIR).distinct().withColumn(n, F.lit(1)) for d, n in ((baseline, "b"), (retrieved, "r"), (gold, "g"))]
    one = marked[0].join(marked[1], PAIR, "full").join(marked[2], PAIR, "full")
    b, r, g = (F.col(c).isNotNull() for c in "brg")
    counted = one.agg(
        F.count(F.when(g, 1)).alias("total"),
        F.count(F.when(r & ~b, 1)).alias("new"),
        F.count(F.when(r & ~b & g, 1)).alias("recovered"),
        *[F.count(F.when(x, 1)).alias(f"n_{k}") for k, x in enumerate((b, r, b | r))],
        *[F.count(F.when(x & g, 1)).alias(f"g_{k}") for k, x in enumerate((b, r, b | r))],
    )
    each = [
        F.struct(
            F.lit(name).alias("candidates_of"),
            F.col(f"n_{k}").alias("candidates"),
            F.col(f"g_{k}").alias("gold_covered"),
            F.round(F.col(f"g_{k}") / F.greatest("total", F.lit(1)), 6).alias("recall"),
            (F.col("recovered") if k else F.lit(0).cast("long")).alias("recovered"),
            (F.when(F.col("recovered") > 0, F.round(F.col("new") / F.col("recovered"), 6)) if k else F.lit(None).cast("double")).alias(
                "candidates_per_recovered"
            ),
        )
        for k, name in enumerate(("baseline", "retrieval", "union"))
    ]
    return counted.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def compare(systems: dict[str, DataFrame], gold: DataFrame, universe: DataFrame) -> DataFrame:
    """The metric of several systems' links over the same records, a row for each."""
    rows = [macro_f(links, gold, universe).withColumn("system", F.lit(name)) for name, links in systems.items()]
    return reduce(DataFrame.unionByName, rows)


def secondary_recall(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Of gold pairs of records with more than one, how many are candidates."""
    window = Window.partitionBy("s1_id")
    several = gold.select(*PAIR).distinct().withColumn("n", F.count(F.lit(1)).over(window)).where("n > 1")
    found = several.join(candidates.select(*PAIR).distinct().withColumn("c", F.lit(1)), PAIR, "left")
    return found.agg(
        F.count(F.lit(1)).alias("secondary_gold"),
        F.count("c").alias("secondary_found"),
        F.round(F.count("c") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("secondary_recall"),
    )


def set_new(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.select(*PAIR).distinct().join(old.select(*PAIR), PAIR, "left_anti")


def set_common(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.select(*PAIR).distinct().join(other.select(*PAIR), PAIR, "left_semi")


def set_union(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.select(*PAIR).unionByName(other.select(*PAIR)).distinct()


def prediction_diff(old: DataFrame, new: DataFrame, gold: DataFrame) -> DataFrame:
    """Pairs only in the old, only in the new and in both, and how many of each are gold. Of classes, the old pairs and the
    gold pairs are those of all their records; a new one has one record of the first class for each of the second."""
    sides = [d.select(*PAIR, n.alias(k)).distinct() for d, n, k in ((old, _size(old, "s1_n", "sx_n"), "o"), (new, _size(new, "sx_n"), "n"))]
    marked = gold.select(*PAIR).distinct().withColumn("g", F.lit(1))
    joined = sides[0].join(sides[1], PAIR, "full").fillna(0, ["o", "n"]).join(marked, PAIR, "left")
    kept = F.least("o", "n")
    kinds = {"removed": F.col("o") - kept, "added": F.col("n") - kept, "kept": kept}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("change"), v.alias("pairs")) for k, v in kinds.items()]))
    long = joined.select("g", rows.alias("x")).select("g", "x.*").where("pairs > 0")
    gold_pairs = F.coalesce(F.sum(F.when(F.col("g") == 1, F.col("pairs"))), F.lit(0))
    return long.groupBy("change").agg(F.sum("pairs").alias("pairs"), gold_pairs.alias("gold_pairs"))


def recovered_trace(recovered: DataFrame, scored: DataFrame, final: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """What became of recovered gold pairs: kept, below the threshold, or lost to another record."""
    traced = recovered.select(*PAIR).distinct().join(scored.select(*PAIR, score), PAIR, "left")
    traced = traced.join(final.select(*PAIR).distinct().withColumn("f", F.lit(1)), PAIR, "left")
    outcome = (
        F.when(F.col("f") == 1, "kept")
        .when(F.coalesce(F.col(score), F.lit(0.0)) < threshold, "below_threshold")
        .otherwise("lost_to_exclusivity")
    )
    return traced.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("pairs"))


def score_quantiles(pairs: DataFrame, score: str = "score", over: float = 0.1) -> DataFrame:
    """Mean, median, 90th and 95th percentile, largest, and the share above a value."""
    return pairs.agg(
        F.round(F.avg(score), 6).alias("mean"),
        F.round(F.percentile(score, F.lit(0.5)), 6).alias("median"),
        F.round(F.percentile(score, F.lit(0.9)), 6).alias("p90"),
        F.round(F.percentile(score, F.lit(0.95)), 6).alias("p95"),
        F.max(score).alias("largest"),
        F.round(F.avg((F.col(score) > over).cast("int")), 6).alias("share_over"),
    )


def rescore_gate(pairs: DataFrame, score: str = "score", least: float = 0.01) -> DataFrame:
    """The share of scores above zero, and whether it is enough to go on."""
    share = F.avg((F.col(score) > 0).cast("int"))
    return pairs.agg(F.round(share, 6).alias("non_zero"), (share >= least).alias("passed"))
