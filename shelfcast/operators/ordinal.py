"""Row positions and row lags in a stated order, without a whole group in one task.

A position is (rows in earlier blocks) + (place within the block): block sizes come from a
pre-aggregated count, so neither a hot segment nor the whole table is ever sorted as one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.operators.joins import null_safe_join
from shelfcast.sources.storage import stage


def with_position(
    df: DataFrame, scope: Sequence[str], order: Sequence[str], out: str = "pos"
) -> DataFrame:
    """Add the zero-based position of each row among the rows of the same `scope` (empty: the
    whole table), ordered by `order`, one column or more. All but the last order column form the
    counting blocks; a single one is both. NULL is a key like any other and sorts first."""
    scope = list(scope)
    order = [c for c in dict.fromkeys(order) if c not in scope]  # a scope column orders nothing within it
    if not order:
        raise ValueError("the order needs a column that is not in the scope")
    blocks = order[:-1] or order
    offsets = df.groupBy(*scope, *blocks).agg(F.count(F.lit(1)).alias("_rows"))

    def rows_before(prefix: list[str], block: str) -> Column:
        w = Window.partitionBy(*prefix).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_rows").over(w), F.lit(0))

    total = F.lit(0).cast("bigint")
    for depth in range(len(blocks) - 1):
        prefix = scope + blocks[:depth]
        level = offsets.groupBy(*prefix, blocks[depth]).agg(F.sum("_rows").alias("_rows"))
        start = level.select(*prefix, blocks[depth], rows_before(prefix, blocks[depth]).alias(f"_start{depth}"))
        offsets = null_safe_join(offsets, start, prefix + [blocks[depth]], "inner")
        total = total + F.col(f"_start{depth}")
    innermost = rows_before(scope + blocks[:-1], blocks[-1])
    offsets = offsets.select(*scope, *blocks, (total + innermost).alias("_start"))
    inner = Window.partitionBy(*scope, *blocks).orderBy(order[-1])
    placed = df.withColumn("_place", F.row_number().over(inner))
    return (
        null_safe_join(placed, offsets, scope + blocks, "inner")
        .withColumn(out, (F.col("_start") + F.col("_place") - 1).cast("bigint"))
        .drop("_place", "_start")
    )


def with_global_position(df: DataFrame, order: Sequence[str], out: str = "pos") -> DataFrame:
    """Add the zero-based position of each row in the order of the whole table, whatever its first
    column holds: the rows are stored sorted by ranges, and the sizes of the ranges give where each
    begins. Rows that are equal in `order` may take each other's place."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stage(ranged.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("_id", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # one row per range, of which there are as many as shuffle partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    joined = numbered.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(out, F.col("_start") + place).drop("_part", "_start", "_id")


def lag_by_position(
    df: DataFrame,
    scope: Sequence[str],
    pos: str,
    value: str | Column,
    lag: int,
    out: str,
    block_rows: int = 100_000,
) -> DataFrame:
    """Value `lag` rows earlier in the scope. Rows are windowed in fixed-size position blocks;
    the last `lag` rows of each block are also sent to the next block, so a scope holding a
    large share of all rows spreads over many tasks."""
    if not 0 < lag <= block_rows:
        raise ValueError(f"the lag must lie in 1..{block_rows}")
    value = F.col(value) if isinstance(value, str) else value
    block = F.floor(F.col(pos) / block_rows).cast("bigint")
    in_tail = F.pmod(F.col(pos), F.lit(block_rows)) >= block_rows - lag
    spread = df.withColumn("_own", block).withColumn(
        "_block",
        F.explode(F.when(in_tail, F.array(block, block + 1)).otherwise(F.array(block))),
    )
    w = Window.partitionBy(*scope, "_block").orderBy(pos)
    return (
        spread.withColumn(out, F.lag(value, lag).over(w))
        .where(F.col("_own") == F.col("_block"))
        .drop("_own", "_block")
    )
