"""Mixing sources by temperature, realised as budgeted block permutations.

The token shares of the sources are raised to an exponent; bisection finds the exponent that gives the
target entropy or keeps the most repeated source within a limit. The normalised weights times the budget
are each source's quota. A source is dealt into blocks; every pass visits its blocks in an order of its
own, and the last pass stops where the quota ends. Blocks are visited in the order of a hash, so where a
pass stops is one threshold per source, and admitting a document needs no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.sources.storage import stage

BLOCK_TOKENS = 100_000
CELLS = 1024  # ranges of the block order that are summed up first
SECTIONS = 64  # one aggregate does six bisections
ROUNDS = 5
MOST_EXPONENT = 8.0
RESULT = ("mix_pass", "mix_block", "mix_position")


@dataclass
class Mix:
    """exponent, budget in tokens, entropy as a share of the largest, and how often the most repeated
    source is seen."""

    exponent: float
    budget: float
    entropy: float
    repetition: float


def token_count(text: Column) -> Column:
    """Words between white space; a text without words counts as one token, so that quotas bound rows."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)), F.lit(1)).cast("long")


def _measures(sources: DataFrame, total: float, exponents: list[float], budget: float | None) -> list[Mix]:
    """What each exponent gives; one aggregate over the sources."""
    p, a = F.col("tokens") / F.lit(total), F.col("a")
    rows = (
        sources.select("tokens", F.explode(F.array(*[F.lit(x) for x in sorted(set(exponents))])).alias("a"))
        .groupBy("a")
        .agg(F.sum(p**a).alias("z"), F.sum(p**a * F.log(p)).alias("zl"), F.max(p ** (a - 1)).alias("most"), F.min(p ** (a - 1)).alias("least"), F.count("*").alias("n"))
        .collect()
    )
    out = []
    for r in rows:
        # without a budget, the smallest that shows every document once
        tokens = budget if budget is not None else total * r["z"] / r["least"]
        entropy = math.log(r["z"]) - r["a"] * r["zl"] / r["z"]
        out.append(Mix(r["a"], tokens, entropy / math.log(r["n"]) if r["n"] > 1 else 1.0, tokens * r["most"] / (r["z"] * total)))
    return sorted(out, key=lambda m: exponents.index(m.exponent))


def _bisect(sources: DataFrame, total: float, budget: float | None, start: float, end: float, met: Callable[[Mix], bool]) -> Mix:
    """The first mix that meets a condition on the way from `start` to `end`; the end if none does. On
    the way the condition turns true once."""
    for _ in range(ROUNDS):
        step = (end - start) / SECTIONS
        points = [start + step * i for i in range(SECTIONS)] + [end]
        tried = _measures(sources, total, points, budget)
        at = next((i for i, m in enumerate(tried) if met(m)), SECTIONS)
        best = tried[at]
        if at == 0:
            break
        start, end = points[at - 1], points[at]
    return best


def choose_exponent(
    sources: DataFrame, total: float, target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None
) -> Mix:
    """The exponent from 0 to MOST_EXPONENT whose entropy is the target, a share of the largest possible
    (out of reach: the nearest); without a target, 0, which is the flattest mix. If it repeats a source
    more than the limit allows, it moves towards the proportional mix until it keeps the limit, or
    becomes that mix. Entropy falls as the exponent grows, repetition grows away from 1."""
    if target_entropy is None:
        mix = _measures(sources, total, [0.0 if repetition_limit is not None else 1.0], budget)[0]
    else:
        mix = _bisect(sources, total, budget, 0.0, MOST_EXPONENT, lambda m: m.entropy <= target_entropy)
    if repetition_limit is not None and mix.repetition > repetition_limit:
        mix = _bisect(sources, total, budget, mix.exponent, 1.0, lambda m: m.repetition <= repetition_limit)
    return mix


def mix_sources(
    docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", target_entropy: float | None = None,
    repetition_limit: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0,
) -> DataFrame:
    """The mix: one row per document and pass, with mix_pass (from 1), mix_block and mix_position (0 to 1,
    its place in the mix; sort by it to interleave the sources).

    `budget` is in tokens; by default it is the smallest at which every document is seen at least once.
    No source exceeds its quota; it falls short by less than one document. Null is a source like any
    other, empty and null texts count as one token, equal rows are admitted together. Columns named like
    a result column are replaced; an empty table gives an empty result.
    """
    kept = docs.select(*[c for c in docs.columns if c not in RESULT])
    key = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    narrow = stage(docs.select(F.col(source).alias("source"), token_count(F.col(text)).alias("tokens"), key.alias("key")), "tokens")
    sources = stage(narrow.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return kept.select("*", F.lit(1).alias("mix_pass"), F.lit(0).cast("long").alias("mix_block"), F.lit(0.0).alias("mix_position"))
    mix = choose_exponent(sources, float(total), target_entropy, repetition_limit, budget)
    norm = _weight_sum(sources, total, mix.exponent)
    weight = (F.col("tokens") / F.lit(float(total))) ** F.lit(mix.exponent) / F.lit(norm)
    passes = F.round(weight * F.lit(mix.budget) / F.col("tokens"), 9)
    plan = stage(
        sources.withColumn("full", F.floor(passes).cast("int")).select(
            "source", "full", F.floor((passes - F.col("full")) * F.col("tokens")).alias("rest"),
            F.ceil(F.col("tokens") / block_tokens).alias("blocks"),
        ),
        "plan",
    )

    def block() -> Column:
        return F.pmod("key", "blocks")

    def order(number: Column) -> Column:
        """The place of a block in a pass, from 0 to 1."""
        return F.pmod(F.xxhash64(F.lit(seed), number, F.col("source"), F.col("block")), F.lit(1 << 52)) / F.lit(float(1 << 52))

    # where the last, partial pass of each source stops: cell, then block, then document
    last = F.col("full") + 1
    blocks = (
        _by_source(narrow, plan).where("rest > 0").withColumn("block", block()).groupBy("source", "full", "rest", "block").agg(F.sum("tokens").alias("tokens"))
        .withColumn("at", order(last)).withColumn("cell", F.floor(F.col("at") * CELLS))
    )
    blocks = stage(blocks, "blocks")
    cells = blocks.groupBy("source", "cell").agg(F.sum("tokens").alias("cell_tokens"))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = stage(cells.withColumn("before", F.coalesce(F.sum("cell_tokens").over(upto), F.lit(0))), "cells")
    within = Window.partitionBy("source", "cell").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        _null_safe(blocks, cells, ["source", "cell"]).where("before <= rest and rest < before + cell_tokens")
        .withColumn("before", F.col("before") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        .where("before <= rest and rest < before + tokens")
        .select("source", F.col("at").alias("cut_at"), F.col("block").alias("cut_block"), (F.col("rest") - F.col("before")).alias("left"))
    )
    plan = stage(_null_safe(plan, cut, ["source"], "left"), "cuts")
    growing = Window.partitionBy("source").orderBy("key")  # equal keys are admitted together
    inside = (
        _by_source(narrow, plan).where(block() == F.col("cut_block")).withColumn("sum", F.sum("tokens").over(growing)).where("sum <= left")
        .groupBy("source").agg(F.max("key").alias("cut_key"))
    )
    plan = stage(_null_safe(plan, inside, ["source"], "left"), "admission")

    named = plan.select(*[F.col(c).alias(f"_mix_{c}") for c in plan.columns])
    rows = kept.join(named, kept[source].eqNullSafe(F.col("_mix_source"))).withColumn("_mix_key", key)
    rows = rows.withColumn("mix_block", F.pmod("_mix_key", "_mix_blocks"))

    def place(number: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), number, F.col("_mix_source"), F.col("mix_block")), F.lit(1 << 52)) / F.lit(float(1 << 52))

    at = place(F.col("_mix_full") + 1)
    admitted = (F.col("_mix_rest") > 0) & F.coalesce(
        (at < F.col("_mix_cut_at"))
        | ((at == F.col("_mix_cut_at")) & ((F.col("mix_block") < F.col("_mix_cut_block")) | ((F.col("mix_block") == F.col("_mix_cut_block")) & (F.col("_mix_key") <= F.col("_mix_cut_key"))))),
        F.lit(False),
    )
    seen = F.col("_mix_full") + F.when(admitted, 1).otherwise(0)
    rows = rows.withColumn("_mix_seen", seen).where("_mix_seen > 0").withColumn("mix_pass", F.explode(F.sequence(F.lit(1), F.col("_mix_seen"))))
    passes = F.col("_mix_full") + F.when(F.col("_mix_rest") > 0, 1).otherwise(0)
    position = (F.col("mix_pass") - 1 + place(F.col("mix_pass"))) / passes
    return rows.withColumn("mix_position", position).select(*kept.columns, *RESULT)


def _weight_sum(sources: DataFrame, total: float, exponent: float) -> float:
    return sources.agg(F.sum((F.col("tokens") / F.lit(float(total))) ** F.lit(exponent))).first()[0]


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    same = [left[c].eqNullSafe(F.col(f"_r_{c}")) for c in on]
    joined = left.join(other, same, how)
    return joined.drop(*[f"_r_{c}" for c in on])


def _by_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return _null_safe(rows, plan, ["source"])
