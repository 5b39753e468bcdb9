"""Learned scoring with gradient-boosted trees: stages, folds by record, and batch scoring.

Training reads at most the labelled pairs of the training split; scoring is a transform of all pairs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import boosting, metrics
from tessera.operators.boosting import Boosted

FOLDS = 3


def train(pairs: DataFrame, columns: list[str], label: str = "label", positive: float = 3.0, rounds: int = 20, depth: int = 5, rate: float = 0.1, validation: str | None = None) -> Boosted:
    """A model of the label, true pairs weighing ``positive`` each. ``validation`` names a boolean column: its rows are not
    trained on, and training ends early where rounds no longer lessen their error."""
    return boosting.fit(pairs, columns, label, positive, rounds, depth, rate, validation)


def predict(model: Boosted, pairs: DataFrame, columns: list[str], name: str) -> DataFrame:
    return boosting.scored(model, pairs, columns, name)


def out_of_fold(pairs: DataFrame, columns: list[str], name: str = "stage1_score", **options) -> DataFrame:
    """Scores of training pairs by models that saw no pair of the same record."""
    folded = pairs.withColumn("_fold", T.bucket(F.col("s1_id"), "_fold", FOLDS))

    def part(k: int) -> DataFrame:
        model = train(folded.where(F.col("_fold") != k), columns, **options)
        return predict(model, folded.where(F.col("_fold") == k), columns, name)

    parts = [part(k) for k in range(FOLDS)]  # each model's tasks take the whole cluster
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("_fold")


def better(first: tuple[float, object], second: tuple[float, object]) -> object:
    """The model with the better metric; ties to the first."""
    return first[1] if first[0] >= second[0] else second[1]


def save(model: Boosted, path: str) -> None:
    boosting.save(model, path)


def load(path: str) -> Boosted:
    return boosting.load(path)


def rescore(model: Boosted, pairs: DataFrame, columns: list[str], name: str, absent: Iterable[str] = ("tfidf_score",)) -> DataFrame:
    """Scores of new pairs by a model that stays as it is; columns that new pairs lack count 0."""
    lacking = {c: F.lit(0.0) for c in absent if c in columns and c not in pairs.columns}
    return predict(model, pairs.withColumns(lacking), columns, name) if lacking else predict(model, pairs, columns, name)


def choose_threshold(scored: DataFrame, gold: DataFrame, universe: DataFrame, score: str, steps: Iterable[float] = range(5, 96)) -> float:
    """The least threshold (in percent) of the best metric over the universe, as a share."""
    sweep = metrics.threshold_sweep(scored, gold, universe, [k / 100 for k in steps], score)
    return metrics.best_threshold(sweep).first().threshold
