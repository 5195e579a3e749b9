"""Trained models kept under what they were trained from, so that a model is trained once."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.learners import BoostedTrees, RandomForest, TrainedForecaster
from shelfcast.sources.commits import claim, read_text

FORMAT = 2  # raised when models of one key come to be trained or written otherwise


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> str:
    """A digest of the rows whatever their order and partitions: their number and the sums of two hashes
    of each row. One pass, pre-aggregated."""
    values = [F.col(c) for c in columns]
    # a NULL does not change a hash, so which columns are NULL is hashed as well
    absent = F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in values])
    one = F.xxhash64(absent, *values).cast("decimal(38,0)")
    two = F.xxhash64(F.lit(1), *reversed(values), absent).cast("decimal(38,0)")
    return ":".join(str(x) for x in rows.agg(F.count(F.lit(1)), F.sum(one), F.sum(two)).first())


def model_key(learner: BoostedTrees | RandomForest, train: DataFrame, validation: DataFrame, features: Sequence[str], target: str) -> str:
    """A digest of the learner, its parameters, the features in order and the rows, and of what trains it."""
    columns = [*features, target]
    about = [FORMAT, pyspark.__version__, type(learner).__name__, asdict(learner), list(features), target, fingerprint(train, columns), fingerprint(validation, columns)]
    return hashlib.sha256(json.dumps(about, sort_keys=True).encode()).hexdigest()


def train_once(
    folder: str, learner: BoostedTrees | RandomForest, train: DataFrame, validation: DataFrame, features: list[str], target: str = "sales"
) -> TrainedForecaster:
    """The model of this learner over these rows: read from the store in `folder`, or trained and put there.
    Sessions that train the same model at once each write a copy of their own, and the first to finish is
    the one that all read from then on."""
    spark = train.sparkSession
    key = model_key(learner, train, validation, features, target)
    entry = f"{folder}/{key}"
    known = read_text(spark, f"{entry}/current")
    if known is None:
        copy = f"{entry}/{uuid.uuid4().hex}"
        trained = learner.train(train, validation, features, target)
        trained.save(copy)
        if claim(spark, f"{entry}/current", copy):
            return trained
        known = read_text(spark, f"{entry}/current")
    return TrainedForecaster.load(known)
