"""Nearest neighbours by multi-index hashing.

Vectors get binary codes from learned rotations. A code is split into substrings, and every shard of
the data keeps one table per substring. If two codes differ in at most r bits, then by the pigeonhole
principle one of the m substrings differs in at most r // m bits (and all but r % m + 1 of the tables
need one bit less), so probing the tables retrieves every code within radius r. What they retrieve is
checked on the whole code and reranked by exact inner products.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.sources.storage import stage

SAMPLE_ROWS = 4096  # rows that rotations and radius are learned from
SAMPLE_QUERIES = 256
CODE_BITS = 256
SUBSTRING_BITS = 16
COVER = 0.97  # share of the sample's nearest neighbours that the radius must take in
ROUNDS = 25
SHARD_ROWS = 4096
QUERY_ROWS = 2048


@dataclass
class Codes:
    """mean and largest norm place a vector on a sphere; bits are signs after `rotation`."""

    mean: np.ndarray
    norm: float
    rotation: np.ndarray | None = None
    lift: float = 0.0
    radius: int = 0

    def on_sphere(self, x: np.ndarray) -> np.ndarray:
        """Indexed vectors with a component that makes all norms equal, so that the largest inner
        product is the smallest angle; its mean is removed like that of the others."""
        c = (x - self.mean) / self.norm
        return np.column_stack([c, np.sqrt(np.maximum(0.0, 1.0 - (c * c).sum(1))) - self.lift])

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._bits(self.on_sphere(x))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        """Codes of queries; their added component is zero, so it does not change an inner product."""
        return self._bits(np.column_stack([q - self.mean, np.zeros(len(q))]))

    def _bits(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.rotation > 0, axis=1, bitorder="little")


def _rotation(x: np.ndarray, bits: int, rng: np.random.Generator) -> np.ndarray:
    """Rotations that move the principal axes so that signs lose least, side by side until there are
    enough bits."""
    axes = np.linalg.svd(x, full_matrices=False)[2].T
    v = x @ axes
    parts: list[np.ndarray] = []
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (left @ right).T
        parts.append(axes @ r)
    return np.hstack(parts)[:, :bits]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= kth)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))][:k]


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64) ^ code.view(np.uint64)).sum(1, dtype=np.int32)


def fit_codes(sample: np.ndarray, norm: float, mean: np.ndarray, k: int, bits: int = CODE_BITS, seed: int = 0) -> Codes:
    """Rotations from the sample, and the radius that takes in COVER of the k nearest rows of sample
    queries. Neighbours within a sample are farther than those in the whole table, so the radius errs
    on the wide side."""
    codes = Codes(mean, norm)
    codes.lift = float(codes.on_sphere(sample)[:, -1].mean())
    codes.rotation = _rotation(codes.on_sphere(sample), bits, np.random.default_rng(seed))
    rows, queries = codes.of_rows(sample), codes.of_queries(sample[:SAMPLE_QUERIES])
    found = []
    for i in range(len(queries)):
        score = sample @ sample[i]
        score[i] = -np.inf
        near = np.argsort(-score)[: min(k, len(sample) - 1)]
        found.append(distances(rows[near], queries[i]))
    every = np.concatenate(found) if found else np.zeros(0)
    codes.radius = int(np.quantile(every, COVER, method="higher")) if len(every) else bits
    return codes


class Shard:
    """The substring tables of some rows."""

    def __init__(self, codes: np.ndarray, substring_bits: int = SUBSTRING_BITS):
        self.codes = codes
        self.parts = codes.view({8: np.uint8, 16: np.uint16}[substring_bits])
        self.tables = [np.unique(self.parts[:, t], return_inverse=True) for t in range(self.parts.shape[1])]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of all rows whose code is within the radius."""
        parts, m = code.view(self.parts.dtype), len(self.tables)
        hit = np.zeros(len(self.codes), bool)
        for t, (values, bucket) in enumerate(self.tables):
            reach = radius // m - (t > radius % m)
            if reach >= 0:
                hit |= (np.bitwise_count(values ^ parts[t]) <= reach)[bucket]
        near = np.flatnonzero(hit)
        return near[distances(self.codes[near], code) <= radius]

    def nearest(self, code: np.ndarray, radius: int, least: int) -> np.ndarray:
        """All rows within the radius; if they are fewer than `least`, the radius grows until there are
        as many, or all."""
        found = self.within(code, radius)
        if len(found) >= min(least, len(self.codes)):
            return found
        far = distances(self.codes, code)
        return np.flatnonzero(far <= np.partition(far, min(least, len(far)) - 1)[min(least, len(far)) - 1])


def usable(vector: Column) -> Column:
    """Not null, not all zero, and free of null and non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    bits: int = CODE_BITS, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The k rows with the largest inner product found for every query row: query_id, rank, vec_id, score.

    `is_query` is a condition on the id column. Ties go to the smaller id, a query is not its own
    neighbour, and a query with fewer than k other rows gets them all. Rows without an id, with an
    unusable vector or one of another length than the commonest take no part; of rows that share an id
    the one with the smallest vector does. Rotations and radius are learned from SAMPLE_ROWS rows; every
    row is indexed. An empty table gives an empty result. Other columns are ignored.
    """
    spark, name = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q")).where(
        F.col("id").isNotNull() & usable(F.col("v"))
    )
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], name)
    rows = rows.where(F.size("v") == size["d"]).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    sample = np.stack([np.asarray(v, np.float64) for v in drawn])
    mean = sample.mean(0)
    centre = F.array(*[F.lit(float(m)) for m in mean])
    norm2 = F.aggregate(F.zip_with("v", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    known = rows.agg(F.max(norm2).alias("norm2"), F.count("*").alias("rows"), F.count_if("q").alias("queries")).first()
    codes = fit_codes(sample, math.sqrt(known["norm2"]) or 1.0, mean, k, bits)

    def encode(frames):
        for frame in frames:
            x = np.stack(frame["v"].to_numpy()).astype(np.float64) if len(frame) else np.zeros((0, len(mean)))
            frame["code"] = [c.tobytes() for c in codes.of_rows(x)]
            yield frame

    index = stage(rows.mapInPandas(encode, rows.select("*", F.lit(b"").alias("code")).schema), "codes")
    shards, blocks = math.ceil(known["rows"] / shard_rows), max(1, math.ceil(known["queries"] / query_rows))
    place = F.xxhash64("id")
    held = index.select(
        "id", "v", "code", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )
    asked = index.where("q").select(
        "id", "v", F.pmod(place, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    )

    def search(mine: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(queries):
            ids, x = mine["id"].to_numpy(), np.stack(mine["v"].to_numpy()).astype(np.float64)
            shard = Shard(np.frombuffer(b"".join(mine["code"]), np.uint8).reshape(len(mine), -1))
            q = np.stack(queries["v"].to_numpy()).astype(np.float64)
            for query, vec, code in zip(queries["id"], q, codes.of_queries(q), strict=True):
                near = shard.nearest(code, codes.radius, k + 1)
                near = near[ids[near] != query]
                score = x[near] @ vec
                best = _best(score, ids[near], k)
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[near][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    found = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
