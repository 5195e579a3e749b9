"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

Frequent digests are found with Spark's frequent-items sketch (`approx_top_k`, the mergeable form of
the Misra-Gries summary), counted exactly, and the verified winners are broadcast, so that a group of
copies holding a third of all rows is settled map-side. All other digests take an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEAVY = 1000  # a digest is heavy from one row in HEAVY on, so there are at most HEAVY winners
TRACKED = 8192  # counters of the summary; its error stays below one row in HEAVY

RESULT = ("text_sha256", "keep_id", "group_size", "kept")


def heavy_digests(rows: DataFrame, digest: str, order: str, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """Digests that hold at least one row in `heavy`: digest, _size, _top (largest `order`).
    At most `heavy` rows, whatever the data."""
    summary = rows.agg(
        F.expr(f"approx_top_k({digest}, {int(heavy)}, {int(tracked)})").alias("_top"), F.count("*").alias("_rows")
    )
    candidates = summary.select(F.explode(F.col("_top.item")).alias(digest), "_rows")
    return (
        rows.join(F.broadcast(candidates), digest)
        .groupBy(digest)
        .agg(F.count("*").alias("_size"), F.max(order).alias("_top"), F.max("_rows").alias("_rows"))
        .where(F.col("_size") * F.lit(heavy) >= F.col("_rows"))
        .select(digest, "_size", "_top")
    )


def mark_exact_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", heavy: int = HEAVY, tracked: int = TRACKED
) -> DataFrame:
    """Every row of `docs` with text_sha256, keep_id, group_size and kept.

    Texts are equal when identical; null counts as empty. Of equal texts one row is kept, that with
    the largest id (null ids come last, among rows with one id and one text any one is kept). Input
    columns named like a result column are replaced. An empty table gives an empty result.
    """
    rows = docs.select(*[c for c in docs.columns if c not in RESULT]).withColumn(
        "text_sha256", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    )
    winners = heavy_digests(rows.select("text_sha256", F.col(doc_id).alias("_id")), "text_sha256", "_id", heavy, tracked)
    split = rows.join(F.broadcast(winners), "text_sha256", "left")
    lost = F.coalesce(F.col("_top").isNotNull() & ~F.col(doc_id).eqNullSafe(F.col("_top")), F.lit(False))
    settled = split.where(lost).select(
        *rows.columns, F.col("_top").alias("keep_id"), F.col("_size").alias("group_size"), F.lit(False).alias("kept")
    )
    group = Window.partitionBy("text_sha256")
    rest = split.where(~lost).select(
        *rows.columns,
        F.max(doc_id).over(group).alias("keep_id"),
        F.coalesce(F.col("_size"), F.count("*").over(group)).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col(doc_id).desc_nulls_last())) == 1).alias("kept"),
    )
    return rest.unionByName(settled)


def drop_exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with the columns of `docs`."""
    return mark_exact_duplicates(docs, **options).where("kept").select(*docs.columns)
