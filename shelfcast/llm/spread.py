"""Places within groups and joins on keys, for groups and keys that may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from shelfcast.sources.storage import stage

SALTS = 16  # parts that the rows of one key are dealt to


def group_key(column: Column) -> Column:
    """A text that is never null: empty for null, else `=` and the value. It sorts as the texts do, null first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def key_value(key: Column, kind: DataType) -> Column:
    """The value that group_key was given."""
    return F.when(key != "", F.substring(key, 2, 2**31 - 1)).cast(kind)


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Rows with pos, their place in their group from 0, and n, the size of the group; stored. `group` has
    no nulls; in `order` null comes first, and rows that are equal there may take each other's place.

    The rows are stored sorted by ranges; the sizes of a group's parts give where each part begins, so a
    group is never ordered in one task. The order columns go to the driver as bounds: keep them short."""
    by = [group, *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    kept = stage(ranged, "ordered").withColumn("_part", F.shiftrightunsigned("_id", 33))
    parts = kept.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select(
        group, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_begin"),
        F.sum("_rows").over(Window.partitionBy(group)).alias("n"),
    )
    pos = F.col("_begin") + F.col("_id") - F.col("_first")
    found = kept.join(begins, [group, "_part"]).withColumn("pos", pos)
    return stage(found.select(*rows.columns, "pos", "n"), "placed")


def salted_left_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Column, salts: int = SALTS) -> DataFrame:
    """left ⟕ right on columns that are unique in `right` but may be those of many rows of `left`: the rows
    of a key are dealt to `salts` parts by `spread`, a whole number, and each part gets a copy of the match."""
    dealt = left.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, "_salt"], "left").drop("_salt")
