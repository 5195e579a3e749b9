"""Model versions: commits that name the metrics, models and parameters that belong together.

A version's metrics and models are written first, under an id of their own. The version comes to be when a
commit file `v<number>` is created, which never overwrites one that is there: a session that finds the
number taken takes the next. Readers go by the commits, so they never see half a version, nor the metrics of
one version beside the models of another.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.learners import TrainedForecaster
from shelfcast.operators.seasonal import TrainedSeasonal
from shelfcast.sources.commits import claim, names_in, read_text

_METRICS = "model string, metric string, value double"
SCHEMA = (
    "version_nr int, version string, model string, metric string, value double, ensemble_rmse double, "
    "description string, created_at timestamp, parameters_digest string, models array<string>"
)
_KINDS = {"trees": TrainedForecaster, "seasonal": TrainedSeasonal}


@dataclass(frozen=True)
class Version:
    """What one commit holds."""

    version: str
    description: str
    parameters: dict[str, Any]
    metrics: DataFrame
    models: dict[str, Any]


def _commit_number(name: str) -> int:
    return int(name.removeprefix("v"))


def _commits(spark: SparkSession, path: str) -> list[dict]:
    """The commits in order: a few kilobytes each, one per version."""
    names = sorted(names_in(spark, f"{path}/commits"), key=_commit_number)
    return [json.loads(read_text(spark, f"{path}/commits/{n}")) | {"version_nr": _commit_number(n), "version": n} for n in names]


def _metrics_of(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    folders = [f"{path}/metrics/id={i}" for i in ids]
    return spark.read.schema(f"{_METRICS}, id string").option("basePath", f"{path}/metrics").parquet(*folders)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of all versions, one row per version, model and metric. Metrics without a commit are not
    read."""
    found = _commits(spark, path)
    if not found:
        return spark.createDataFrame([], SCHEMA)
    rows = [
        (c["id"], c["version_nr"], c["version"], c["ensemble_rmse"], c["description"], datetime.fromisoformat(c["created_at"]), c["parameters_digest"], sorted(c["models"]))
        for c in found
    ]
    known = spark.createDataFrame(
        rows,
        "id string, version_nr int, version string, ensemble_rmse double, description string, created_at timestamp, parameters_digest string, models array<string>",
    )
    return _metrics_of(spark, path, [c["id"] for c in found]).join(F.broadcast(known), "id").select(*spark.createDataFrame([], SCHEMA).columns)


def parameters_digest(parameters: Mapping[str, Any]) -> str:
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()


def register_version(
    spark: SparkSession,
    path: str,
    metrics: Mapping[str, Mapping[str, float]] | DataFrame,
    description: str = "",
    models: Mapping[str, TrainedForecaster | TrainedSeasonal] | None = None,
    parameters: Mapping[str, Any] | None = None,
) -> str:
    """Add a version and return its name, `v` and a number that no other version has, however many sessions
    register at once. Metrics, rounded to 6 decimals, are a mapping by model or a table (model, metric,
    value); models are stored with them."""
    if not isinstance(metrics, DataFrame):
        rows = [(m, k, float(v)) for m, each in metrics.items() for k, v in each.items()]
        metrics = spark.createDataFrame(rows, _METRICS)
    own = uuid.uuid4().hex
    # a folder of its own: jobs that append to one folder at once take each other's unfinished files away
    metrics.select("model", "metric", F.round("value", 6).alias("value")).write.parquet(f"{path}/metrics/id={own}")
    rmse = _metrics_of(spark, path, [own]).where((F.col("model") == "ensemble") & (F.col("metric") == "rmse")).agg(F.max("value")).first()[0]
    kinds = {}
    for name, model in (models or {}).items():
        kinds[name] = next(k for k, c in _KINDS.items() if isinstance(model, c))
        model.save(f"{path}/models/{own}/{name}")
    commit = {
        "id": own, "ensemble_rmse": rmse, "description": description, "created_at": datetime.now(UTC).isoformat(), "models": kinds,
        "parameters": json.loads(json.dumps(dict(parameters or {}), default=str)), "parameters_digest": parameters_digest(parameters or {}),
    }
    number = max([_commit_number(n) for n in names_in(spark, f"{path}/commits")], default=0) + 1
    while not claim(spark, f"{path}/commits/v{number}", json.dumps(commit)):
        number += 1
    return f"v{number}"


def load_version(spark: SparkSession, path: str, version: str | None = None, best: bool = False) -> Version:
    """A version by name, the one of lowest ensemble RMSE (`best`; the first of equals, and the latest if none
    has one), or the latest: metrics, parameters and models of that one commit."""
    found = _commits(spark, path)
    if version is not None:
        found = [c for c in found if c["version"] == version]
    if not found:
        raise LookupError(f"no version {version}" if version else "no versions yet")
    scored = [c for c in found if c["ensemble_rmse"] is not None]
    commit = min(scored, key=lambda c: (c["ensemble_rmse"], c["version_nr"])) if best and scored else found[-1]
    metrics = _metrics_of(spark, path, [commit["id"]]).drop("id")
    models = {name: _KINDS[kind].load(f"{path}/models/{commit['id']}/{name}") for name, kind in commit["models"].items()}
    return Version(commit["version"], commit["description"], commit["parameters"], metrics, models)


def compare_versions(registry: DataFrame) -> DataFrame:
    """One row per version with a column per model and metric. The column names are the
    distinct model/metric pairs of the registry, a handful."""
    keys = ["version_nr", "version", "description"]
    wide = (
        registry.withColumn("_column", F.concat_ws("_", "model", "metric"))
        .groupBy(*keys)
        .pivot("_column")
        .agg(F.first("value"))
    )
    facts = registry.groupBy("version_nr").agg(
        F.countDistinct("model").alias("n_models"), F.max("ensemble_rmse").alias("_rmse")
    )
    return (
        wide.drop("ensemble_rmse").join(facts, "version_nr").withColumnRenamed("_rmse", "ensemble_rmse")
    )


def ranked_versions(registry: DataFrame) -> DataFrame:
    return compare_versions(registry).orderBy(F.col("ensemble_rmse").asc_nulls_last(), "version_nr")


def best_and_latest(registry: DataFrame) -> DataFrame:
    """One row: version of lowest ensemble RMSE (first of equals) and the last registered."""
    key = F.struct("ensemble_rmse", "version_nr")
    scored = F.when(F.col("ensemble_rmse").isNotNull(), key)
    return registry.agg(
        F.min_by("version", scored).alias("best_version"),
        F.max_by("version", "version_nr").alias("latest_version"),
    )
