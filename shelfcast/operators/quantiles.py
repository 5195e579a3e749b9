"""Exact quantiles of any number of groups, without sorting or collecting a whole column in one task.

A mergeable sketch brackets every wanted rank. The brackets are a table with a row per group; joined to the
rows it lets one pass count what lies below each bracket and keep, pre-aggregated to (value, count), only what
lies inside (about 6 / ACCURACY of the rows per quantile). The counts show whether a bracket holds its rank;
one that does not is widened and counted again in a further round, until the last bracket, which spans the
group. Then the values inside are ordered, each bracket by itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.operators.joins import null_safe_join
from shelfcast.sources.storage import stage

ACCURACY = 50_000
SLACK = 3.0  # ranks, in units of rows / accuracy, by which a bracket reaches beyond what it looks for
WIDER = (1, 8, 64)  # times that, round by round; after the last comes the whole range


@dataclass(frozen=True)
class Quantiles:
    n: int
    values: list[float]


def exact_quantiles(df: DataFrame, value: str | Column, probs: Sequence[float]) -> Quantiles:
    """Linearly interpolated quantiles of all non-NULL values; the driver gets one row."""
    found = exact_quantiles_by(df, F.lit(0), value, probs).first()
    return Quantiles(found["n"], list(found["values"])) if found else Quantiles(0, [float("nan")] * len(probs))


def exact_quantiles_by(
    df: DataFrame, group: str | Column, value: str | Column, probs: Sequence[float], accuracy: int = ACCURACY, slack: float = SLACK
) -> DataFrame:
    """(g, n, values): for each group, NULL among them, the number of its values and its quantiles, linearly
    interpolated, in the order of `probs`. Groups without a value that is not NULL have no row."""
    group = F.col(group) if isinstance(group, str) else group
    value = F.col(value) if isinstance(value, str) else value
    data = df.select(group.alias("g"), value.cast("double").alias("v")).where("v IS NOT NULL")
    wanted = stage(_brackets(data, probs, accuracy, slack), "brackets")
    found, wanted_sizes = None, wanted.select("g", "n")
    for level in range(len(WIDER) + 1):
        counted = stage(_counted(data, wanted, level, len(probs)), "counted")
        here = _picked(counted, wanted, level)
        held = here.where("held").select("g", "i", "value")
        found = held if found is None else found.unionByName(held)
        missed = here.where("not held").groupBy("g").agg(F.collect_set("i").alias("open"))
        if level == len(WIDER) or missed.isEmpty():
            break
        wanted = stage(null_safe_join(wanted.drop("open"), missed, ["g"], "inner"), "brackets")
    values = F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"])
    return null_safe_join(found, wanted_sizes, ["g"]).groupBy("g").agg(F.max("n").alias("n"), values.alias("values"))


def _brackets(data: DataFrame, probs: Sequence[float], accuracy: int, slack: float) -> DataFrame:
    """One row per group: g, n, open (the numbers of the quantiles still looked for), ranks (first, last and
    fraction of each), and lows and highs, for each level of width an array over the quantiles."""
    probes = sorted({min(1.0, max(0.0, p + side * w * slack / accuracy)) for p in probs for w in WIDER for side in (-1, 1)} | {0.0, 1.0})
    at = {x: i for i, x in enumerate(probes)}
    sketched = data.groupBy("g").agg(
        F.percentile_approx("v", probes, accuracy).alias("cuts"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("v").alias("n")
    )
    few = F.col("n") <= accuracy / slack if slack > 0 else F.lit(False)  # a bracket would be a few ranks wide: order all values

    def bound(p: float, side: int, width: int | None) -> Column:
        end = F.col("least") if side < 0 else F.col("most")
        probe = None if width is None else min(1.0, max(0.0, p + side * width * slack / accuracy))
        if probe is None or (side < 0 and probe == 0.0) or (side > 0 and probe == 1.0):
            return end
        return F.when(few, end).otherwise(F.col("cuts")[at[probe]])

    def bounds(side: int) -> Column:
        return F.array(*[F.array(*[bound(p, side, w) for p in probs]) for w in (*WIDER, None)])

    ranks = []
    for p in probs:
        place = F.lit(p) * (F.col("n") - 1)
        ranks.append(F.struct(F.floor(place).alias("first"), F.ceil(place).alias("last"), (place - F.floor(place)).alias("part")))
    return sketched.select(
        "g", "n", F.array(*[F.lit(i) for i in range(len(probs))]).alias("open"), F.array(*ranks).alias("ranks"), bounds(-1).alias("lows"), bounds(1).alias("highs")
    )


def _counted(data: DataFrame, wanted: DataFrame, level: int, n: int) -> DataFrame:
    """g, x (a value inside an open bracket, or NULL for all others), c (rows) and below0, below1, ...: how many
    of the rows lie below each open bracket."""
    rows = null_safe_join(data, wanted.select("g", "open", F.col("lows")[level].alias("low"), F.col("highs")[level].alias("high")), ["g"], "inner")
    value, inside = F.col("v"), F.lit(False)
    for i in range(n):
        inside = inside | (F.array_contains("open", i) & value.between(F.col("low")[i], F.col("high")[i]))
    below = [F.sum((value < F.col("low")[i]).cast("long")).alias(f"below{i}") for i in range(n)]
    return rows.withColumn("x", F.when(inside, value)).groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"), *below)


def _picked(counted: DataFrame, wanted: DataFrame, level: int) -> DataFrame:
    """g, i, value and held (whether the bracket holds both ranks) for every open quantile."""
    i = F.col("i")
    each = wanted.select("g", F.explode("open").alias("i"), "ranks", F.col("lows")[level].alias("lows"), F.col("highs")[level].alias("highs")).select(
        "g", "i", F.col("lows")[i].alias("low"), F.col("highs")[i].alias("high"), F.col("ranks")[i].alias("rank")
    )
    belows = F.array(*[c for c in counted.columns if c.startswith("below")])
    # a bracket holds few values, or a group of few rows
    own = Window.partitionBy("g", "i")
    met = null_safe_join(counted.select("g", "x", "c", belows.alias("below")), each, ["g"], "inner").select(
        "g", "i", "x", "rank", F.when(F.col("x").between(F.col("low"), F.col("high")), F.col("c")).otherwise(0).alias("c"),
        F.sum(F.col("below")[i]).over(own).alias("under"),
    )
    upto = F.col("under") + F.sum("c").over(own.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    run = met.withColumn("upto", F.when(F.col("c") > 0, upto))

    def at(rank: str) -> Column:
        return F.min(F.when(F.col("upto") > F.col(f"rank.{rank}"), F.col("x")))

    rank = F.any_value("rank")
    held = (rank["first"] >= F.any_value("under")) & (rank["last"] < F.max("upto"))
    value = at("first") + (at("last") - at("first")) * rank["part"]
    return run.groupBy("g", "i").agg(value.alias("value"), F.coalesce(held, F.lit(False)).alias("held"))
