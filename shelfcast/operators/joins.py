"""Equi-joins in which a NULL key meets a NULL key, so that no row is lost over one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal or both-NULL keys; the result has the keys of `left` once. Spark picks the join:
    adaptive execution broadcasts a side that is small at run time and splits hot keys of a large one."""
    named = right.select(*[F.col(c).alias(f"_right_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(and_, [left[c].eqNullSafe(named[f"_right_{c}"]) for c in on])
    return left.join(named, same, how).drop(*[f"_right_{c}" for c in on])
