"""Weighted sums of grown trees: forecasts, importances, storage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import RDD, SparkFiles
from pyspark.ml import Transformer
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.growing import Block, Tree, binned, to_blocks
from shelfcast.sources.storage import new_path

_TREE = "number int, feature binary, cut binary, left binary, value binary, depth int, gains binary, weight double"
_KINDS = {"feature": np.uint16, "cut": np.uint8, "left": np.int32, "value": np.float64, "gains": np.float64}
SLICE_BYTES = 1 << 24  # trees that go into one task when a model is stored


def raised(blocks: RDD, trees: list[Tree], rate: float) -> RDD:
    """The blocks with the trees' forecasts, shrunk, added to the running ones."""

    def add(block: Block) -> Block:
        total = block.total
        for tree in trees:
            total = total + rate * tree.forecast(block.bins)
        return Block(block.id, block.bins, block.label, total)

    return blocks.map(add)


def prefix_errors(blocks: RDD, trees: list[Tree], weights: list[float]) -> list[float]:
    """The mean squared error after each of the trees; without trees, that of the running forecast. Empty if
    there are no rows."""

    def partial(part: Iterable[Block]) -> Iterator[np.ndarray]:
        out = np.zeros(1 + max(len(trees), 1))
        for block in part:
            total = block.total
            out[0] += len(total)
            if not trees:
                out[1] += ((block.label - total) ** 2).sum()
            for i, (tree, weight) in enumerate(zip(trees, weights, strict=True), 1):
                total = total + weight * tree.forecast(block.bins)
                out[i] += ((block.label - total) ** 2).sum()
        yield out

    n, *errors = sum(blocks.mapPartitions(partial).collect(), np.zeros(1 + max(len(trees), 1))).tolist()
    return [e / n for e in errors] if n else []


def _row(number: int, tree: Tree, weight: float) -> tuple:
    arrays = (getattr(tree, k).tobytes() for k in ("feature", "cut", "left", "value"))
    return number, *arrays, tree.depth, tree.gains.tobytes(), weight


def stored_trees(spark: SparkSession, grown: RDD, weight: float) -> DataFrame:
    """(number, tree) pairs as rows, written by the tasks that grow them. They stay as long as the application, as
    executors that come late fetch them too."""
    folder = new_path(spark, "trees")
    spark.createDataFrame(grown.map(lambda g: _row(*g, weight)), _TREE, verifySchema=False).write.parquet(folder)
    return spark.read.schema(_TREE).parquet(folder)


def _in_order(tables: Iterable[pa.Table]) -> list[Tree]:
    """The trees of some tables by number; their arrays lie in the tables."""
    found: dict[int, Tree] = {}
    for table in tables:
        columns = {k: table[k].combine_chunks() for k in _KINDS}
        for i, (number, depth) in enumerate(zip(table["number"].to_pylist(), table["depth"].to_pylist(), strict=True)):
            found[number] = Tree(depth=depth, **{k: np.frombuffer(columns[k][i].as_buffer(), kind) for k, kind in _KINDS.items()})
    return [found[number] for number in sorted(found)]


@lru_cache(maxsize=1)
def _fetched(names: tuple[str, ...]) -> list[Tree]:
    """The trees of files that Spark has brought to this task's machine; a worker reads them once."""
    return _in_order(pq.read_table(SparkFiles.get(n), columns=["number", "depth", *_KINDS]) for n in names)


class GrownTrees(Transformer):
    """The last stage of a tree forecaster: adds `_raw`, the weighted sum of the trees, from the feature columns.
    The importance of a feature is the squared error its splits take away, over all trees, or (`by_tree`) each
    tree's share of it. The trees are a list, or the rows of a stored table, of which the driver reads no more than
    it needs."""

    def __init__(self, features: list[str], cuts: list[np.ndarray], trees: list[Tree] | DataFrame, weights: list[float], by_tree: bool = False):
        super().__init__()
        self.features, self.cuts, self.treeWeights, self.by_tree = features, cuts, weights, by_tree
        self._trees, self._sent = trees, None

    @property
    def trees(self) -> list[Tree]:
        if isinstance(self._trees, list):
            return self._trees
        return _in_order([self._trees.toArrow()])

    def _send(self, spark: SparkSession) -> Callable[[], list[Tree]]:
        """A function that gives a task the trees: those of a list are broadcast, the files of a table fetched by the
        executors from where they lie."""
        if self._sent is None:
            if isinstance(self._trees, list):
                self._sent = spark.sparkContext.broadcast(self._trees)
            else:
                files = sorted(self._trees.inputFiles())
                for file in files:
                    spark.sparkContext.addFile(file)
                self._sent = tuple(file.rsplit("/", 1)[1] for file in files)
        sent = self._sent
        return (lambda: _fetched(sent)) if isinstance(sent, tuple) else lambda: sent.value

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, cuts, weights = self._send(df.sparkSession), self.cuts, self.treeWeights

        @F.pandas_udf("double")
        def total(rows: pd.DataFrame) -> pd.Series:
            bins = binned((rows[c].to_numpy(np.float64) for c in rows.columns), cuts)
            out = np.zeros(len(rows))
            for tree, weight in zip(trees(), weights, strict=True):
                out += weight * tree.forecast(bins)
            return pd.Series(out)

        named = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(self.features)]
        return df.withColumn("_raw", total(F.struct(*named)))

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the name MLlib gives it
        if isinstance(self._trees, list):
            all_gains = [t.gains for t in self._trees]
        else:
            rows = self._trees.select("number", "gains").collect()
            all_gains = [np.frombuffer(r["gains"]) for r in sorted(rows, key=lambda r: r["number"])]
        found = np.zeros(len(self.features))
        for gains in all_gains:
            found += gains / (gains.sum() or 1.0) if self.by_tree else gains
        return DenseVector(found / (found.sum() or 1.0))

    def evaluateEachIteration(self, df: DataFrame, loss: str = "squared", label: str = "label") -> list[float]:  # noqa: N802
        """The error on these rows of the first tree, the first two, and so on."""
        if loss != "squared":
            raise ValueError(f"no loss {loss}")
        return prefix_errors(to_blocks(df, self.features, label, self.cuts), self.trees, self.treeWeights)

    def about(self) -> dict:
        return {"cuts": [c.tolist() for c in self.cuts], "by_tree": self.by_tree}

    def save_trees(self, folder: str) -> None:
        """One row per tree, written by the tasks that have them."""
        spark = SparkSession.getActiveSession()
        rows = self._trees
        if isinstance(rows, list):
            trees, weights, size = self._send(spark), self.treeWeights, sum(t.value.nbytes * 2 for t in rows)
            numbers = spark.sparkContext.parallelize(range(len(rows)), 1 + size // SLICE_BYTES)
            rows = spark.createDataFrame(numbers.map(lambda i: _row(i, trees()[i], weights[i])), _TREE, verifySchema=False)
        rows.write.mode("overwrite").parquet(folder)

    @staticmethod
    def load_trees(spark: SparkSession, folder: str, features: list[str], cuts: list[list[float]], by_tree: bool) -> GrownTrees:
        rows = spark.read.schema(_TREE).parquet(folder)
        weights = [r["weight"] for r in sorted(rows.select("number", "weight").collect(), key=lambda r: r["number"])]
        return GrownTrees(features, [np.array(c, np.float64) for c in cuts], rows, weights, by_tree)
