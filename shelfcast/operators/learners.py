"""Tree forecasters over a feature table."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Protocol

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.scalar import clip
from shelfcast.operators import growing as gr
from shelfcast.operators.grown_trees import GrownTrees, prefix_errors, raised, stored_trees
from shelfcast.operators.metrics import aggregate, forecaster_metrics

FEATURES = "_features"
LABEL = "_label"
_KEPT = StorageLevel.MEMORY_AND_DISK


class Forecaster(Protocol):
    """What every forecaster offers: train on one table, score another, predict a third."""

    def train(
        self, train: DataFrame, validation: DataFrame, features: list[str], target: str = "sales"
    ) -> TrainedForecaster: ...


@dataclass(frozen=True)
class TrainedForecaster:
    name: str
    model: PipelineModel
    features: list[str]
    target: str
    metrics: dict[str, dict[str, float]] = field(default_factory=dict)
    training_seconds: float = 0.0
    curve: list[float] = field(default_factory=list)  # squared error on the validation rows of 0, 1, ... trees

    @property
    def trees(self) -> int:
        """Trees beyond the constant that boosting starts from."""
        return len(self.model.stages[-1].treeWeights) - (len(self.curve) > 0)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Add the forecast, floored at 0."""
        scored = self.model.transform(df)
        return scored.withColumn(out, clip(F.col("_raw"), 0.0)).drop("_raw", FEATURES)

    def importance(self) -> DataFrame:
        """(feature, importance) rows, one per feature."""
        values = self.model.stages[-1].featureImportances.toArray()
        rows = [(f, float(v)) for f, v in zip(self.features, values)]
        spark = SparkSession.getActiveSession()
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(
            F.desc("importance"), "feature"
        )

    def top_features(self, n: int | None) -> DataFrame:
        """The n most important features, or all in order (None)."""
        return self.importance() if n is None else self.importance().limit(n)

    def save(self, folder: str) -> None:
        """The model, and one row with what else belongs to it."""
        spark = SparkSession.getActiveSession()
        grown = self.model.stages[-1]
        grown.save_trees(f"{folder}/trees")
        about = [self.name, self.features, self.target, self.metrics, self.training_seconds, self.curve, grown.about()]
        spark.createDataFrame([(json.dumps(about),)], "about string").write.mode("overwrite").parquet(f"{folder}/about")

    @staticmethod
    def load(folder: str) -> TrainedForecaster:
        """A stored model; one without the seventh part was written by MLlib."""
        spark = SparkSession.getActiveSession()
        about = json.loads(spark.read.parquet(f"{folder}/about").first()["about"])
        name, features, target, metrics, seconds, curve = about[:6]
        if len(about) == 6:
            model = PipelineModel.load(f"{folder}/model")
        else:
            model = PipelineModel([_assembled(features), GrownTrees.load_trees(spark, f"{folder}/trees", features, **about[6])])
        return TrainedForecaster(name, model, features, target, metrics, seconds, curve)


def _assembled(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=FEATURES, handleInvalid="keep")


def _labelled(df: DataFrame, features: list[str], target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull()).select(*features, F.col(target).cast("double").alias(LABEL))


def _known(train: DataFrame, features: list[str], target: str) -> tuple[DataFrame, int, float]:
    """The rows with a target, their number and the mean."""
    rows = _labelled(train, features, target)
    n, mean = rows.agg(F.count(F.lit(1)), F.avg(LABEL)).first()
    if n == 0:
        raise ValueError(f"no training row has {target}")
    return rows, n, mean


def _score(trained: TrainedForecaster, df: DataFrame) -> dict[str, float]:
    spread = df.select(*trained.features, trained.target).repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
    scored = trained.predict(spread)
    return aggregate(scored, forecaster_metrics(trained.target, "prediction")).first().asDict()


def _finish(
    name: str,
    stages: list,
    train: DataFrame,
    validation: DataFrame,
    features: list[str],
    target: str,
    started: float,
    curve: list[float] | None = None,
) -> TrainedForecaster:
    trained = TrainedForecaster(name, PipelineModel(stages), features, target)
    seconds = time.time() - started
    scores = {"train": _score(trained, train), "validation": _score(trained, validation)}
    return TrainedForecaster(name, trained.model, features, target, scores, seconds, curve or [])


@dataclass(frozen=True)
class BoostedTrees:
    """Gradient-boosted trees on squared error, from the mean, every tree shrunk by the learning rate.

    The error on the validation rows is taken for every number of trees. Training stops when `patience` more
    trees have not lowered it, and the model keeps the number of trees with the lowest error. Without
    validation rows all trees are grown and kept. Rows without a target are left out. The running forecast is
    kept beside the binned rows and raised by each tree; every `chunk` trees both are stored, so that the
    lineage does not grow with the number of trees.
    """

    name: str = "xgboost"
    trees: int = 1000
    depth: int = 8
    learning_rate: float = 0.05
    row_share: float = 0.8
    feature_share: float = 0.8
    min_rows_per_leaf: int = 5
    patience: int = 50
    chunk: int = 25
    seed: int = 42

    def train(
        self, train: DataFrame, validation: DataFrame, features: list[str], target: str = "sales"
    ) -> TrainedForecaster:
        started = time.time()
        spark = train.sparkSession
        rows, n, mean = _known(train, features, target)
        cuts = gr.all_cut_points(rows, features, n, self.seed)
        growth = gr.Growth(
            self.depth, self.min_rows_per_leaf, gr.features_per_node(str(self.feature_share), len(features)), self.seed,
            self.row_share, False, len(features),
        )
        fit = gr.to_blocks(rows, features, LABEL, cuts, mean)
        held = gr.to_blocks(_labelled(validation, features, target), features, LABEL, cuts, mean).persist(_KEPT)
        grown = [gr.Growing(len(features), mean).done()]
        curve = prefix_errors(held, [], [])
        while True:
            fit.persist(_KEPT)
            chunk, behind = [], []
            for _ in range(min(self.chunk, self.trees - len(grown) + 1)):
                tree = growth.by_levels(fit, len(grown) + len(chunk))
                chunk.append(tree)
                for old in behind:
                    old.unpersist()
                behind, fit = [fit], raised(fit, [tree], self.learning_rate).persist(_KEPT)
            grown += chunk
            last = len(grown) > self.trees
            curve += prefix_errors(held, chunk, [self.learning_rate] * len(chunk))
            best = min(range(len(curve)), key=lambda i: curve[i]) if curve else len(grown) - 1
            last = last or bool(curve) and len(curve) - 1 - best >= self.patience
            if not last:
                behind += [fit, held]
                fit = gr.stored(fit, spark)
                held = gr.stored(raised(held, chunk, self.learning_rate), spark).persist(_KEPT)
            for old in [*behind, *([fit, held] if last else [])]:
                old.unpersist()
            if last:
                break
        model = GrownTrees(features, cuts, grown[: best + 1], [1.0] + [self.learning_rate] * best)
        return _finish(self.name, [_assembled(features), model], train, validation, features, target, started, curve)


@dataclass(frozen=True)
class RandomForest:
    """Random forest over all training rows, each tree on rows drawn again and again. A node of fewer than
    twice `min_rows_per_leaf` rows is never split. If all rows fit a task, the tasks store the trees they grow;
    else the trees are grown in `parts` shares at once, as trees do not wait for each other. Rows without a target
    are left out."""

    name: str = "random_forest"
    trees: int = 500
    depth: int = 15
    min_rows_per_leaf: int = 5
    features_per_split: str = "sqrt"
    parts: int = 4
    seed: int = 42

    def train(
        self, train: DataFrame, validation: DataFrame, features: list[str], target: str = "sales"
    ) -> TrainedForecaster:
        started = time.time()
        rows, n, mean = _known(train, features, target)
        cuts = gr.all_cut_points(rows, features, n, self.seed)
        growth = gr.Growth(
            self.depth, self.min_rows_per_leaf, gr.features_per_node(self.features_per_split, len(features)), self.seed, 1.0, True, len(features)
        )
        blocks = gr.to_blocks(rows, features, LABEL, cuts, mean).persist(_KEPT)

        def grow(part: int) -> list:
            numbers = list(range(part, self.trees, self.parts))
            return list(zip(numbers, growth.by_groups(blocks, n, numbers, mean), strict=True))

        if n <= growth.group_rows:
            trees = stored_trees(train.sparkSession, growth.whole(blocks, list(range(self.trees)), mean), 1.0 / self.trees)
        else:
            parts = range(min(self.parts, self.trees))
            with ThreadPool(len(parts)) as pool:
                grown = pool.map(inheritable_thread_target(train.sparkSession)(grow), parts)
            trees = [t for _, t in sorted((x for part in grown for x in part), key=lambda x: x[0])]
        blocks.unpersist()
        model = GrownTrees(features, cuts, trees, [1.0 / self.trees] * self.trees, by_tree=True)
        return _finish(self.name, [_assembled(features), model], train, validation, features, target, started)


def split_by_date(df: DataFrame, holdout_days: int) -> tuple[DataFrame, DataFrame]:
    """Rows before and within the last `holdout_days` days."""
    cutoff = F.date_sub(df.agg(F.max("date")).scalar(), holdout_days)
    return df.where(F.col("date") <= cutoff), df.where(F.col("date") > cutoff)


def split_three_ways(df: DataFrame, stop_days: int, holdout_days: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to train on, rows of the `stop_days` days after them to stop on, and the last `holdout_days` days
    to judge on."""
    earlier, held_out = split_by_date(df, holdout_days)
    cutoff = F.date_sub(df.agg(F.max("date")).scalar(), holdout_days + stop_days)
    return earlier.where(F.col("date") <= cutoff), earlier.where(F.col("date") > cutoff), held_out
