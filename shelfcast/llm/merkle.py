"""Merkle manifest of a table as a persistent tree.

Rows of a group, in order, are leaves; every eight consecutive nodes have a common parent, level by level
until one node is left, and the groups' roots are the leaves of one more tree. A tree is built in tiers:
a task takes an aligned block of 512 nodes, builds the three levels above them, and hands one node to the
next tier, so no task holds more than a block. On the way back down a block gets one row, the siblings on
the path from its own root to the root of the table.

A changed row makes a new version of the tree. It copies the row's ancestors and shares all other nodes:
within the leaf's block the copies are made next to the block's own nodes, and the path goes on from the
copied block root through the siblings above. Versions of different rows do not see each other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.spread import group_key, key_value, placed
from shelfcast.sources.storage import stage

FAN_OUT = 8
TIER_LEVELS = 3  # levels that one task builds
BLOCK = FAN_OUT**TIER_LEVELS

_NODE = "g string, pos long, n long, digest binary"
_ABOVE = "g string, block long, lefts array<string>, rights array<string>, subroot string, root string"
_RESULT = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "copied")


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256, as bytes, over the values in turn: `-` for null, else UTF-8 byte count, `:` and the value as text."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256))


def _hex_of(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def levels_above(nodes: list[str], n: int) -> list[list[str]]:
    """The nodes of a block (hex digests) and up to TIER_LEVELS levels above them; `n` is how many nodes
    the whole group has on the level of `nodes`. There is no level above a group's only node."""
    levels = [nodes]
    while n > 1 and len(levels) <= TIER_LEVELS:
        below = levels[-1]
        levels.append([_hex_of("".join(below[i : i + FAN_OUT])) for i in range(0, len(below), FAN_OUT)])
        n = -(-n // FAN_OUT)
    return levels


def siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """For each level of a block that has one above it: the digests left and right of the node on the
    path from node `at`, joined."""
    lefts, rights = [], []
    for level in levels[:-1]:
        first = at - at % FAN_OUT
        lefts.append("".join(level[first:at]))
        rights.append("".join(level[at + 1 : first + FAN_OUT]))
        at //= FAN_OUT
    return lefts, rights


def copied_path(digest: str, lefts: Sequence[str], rights: Sequence[str]) -> list[str]:
    """The nodes that a version with this digest below copies, from the lowest to the highest."""
    path = []
    for left, right in zip(lefts, rights, strict=True):
        digest = _hex_of(left + digest + right)
        path.append(digest)
    return path


def _climb(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("pos")
    n = int(group["n"].iloc[0])
    top = levels_above([d.hex() for d in group["digest"]], n)[-1][0]
    return pd.DataFrame({"g": [group["g"].iloc[0]], "pos": [int(group["pos"].iloc[0]) // BLOCK], "n": [-(-n // BLOCK)], "digest": [bytes.fromhex(top)]})


def _descend(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    if not len(group) or not len(above):
        raise ValueError("a block of the tree has lost its path")
    group, up = group.sort_values("pos"), above.iloc[0]
    levels = levels_above([d.hex() for d in group["digest"]], int(group["n"].iloc[0]))
    paths = [siblings(levels, i) for i in range(len(group))]
    return pd.DataFrame(
        {
            "g": group["g"], "block": group["pos"], "subroot": up["subroot"], "root": up["root"],
            "lefts": [[*left, *up["lefts"]] for left, _ in paths], "rights": [[*right, *up["rights"]] for _, right in paths],
        }
    )


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK).cast("long").alias("block")


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, and above them one node for each block, until each group has one."""
    tiers = [nodes]
    while len(tiers) < 2 or (tiers[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tiers.append(stage(tiers[-1].select("g", "pos", "n", "digest").groupBy("g", _block()).applyInPandas(_climb, _NODE), "tier"))
    return tiers


def _down(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The paths of the blocks of the lowest tier, given those of the groups' roots."""
    for nodes in reversed(tiers[1:-1]):
        above = stage(nodes.groupBy("g", _block()).cogroup(above.groupBy("g", "block")).applyInPandas(_descend, _ABOVE), "paths")
    return above


def manifest(
    table: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "lang",
    order: str = "doc_id",
    changed: Mapping[str, Column] | None = None,
    where: Column | None = None,
    paths: bool = False,
) -> DataFrame:
    """One row per row of `table`: the order and group columns, leaf, subroot (of the row's group), root (of
    the table), proof_sha256, folded_root and verified, and with `paths` copied, the digests of the nodes
    that the row's version has copied, from the leaf to the root.

    `changed` gives new values for some columns and `where` the rows that are so tampered with; the tree is
    that of the table as it is. folded_root is the root of the row's version: its leaf, with the changes if
    it is tampered with, carried up past its siblings. verified says whether that is the root. The proof is
    over all siblings from the leaf to the root, left to right on each level; that of a table's only row is
    over nothing.

    Groups ascend as texts, leaves as values, null first; rows that repeat an order value are ordered by their digests, and
    equal rows are leaves of their own. A null `where` means not tampered with. Columns not named in
    `columns` are ignored, whatever their names. An empty table gives an empty result.
    """
    if {group, order} & set(_RESULT):
        raise ValueError(f"group and order may not be named like a result column: {_RESULT}")
    now = {c: F.col(c) for c in columns}
    then = now | {c: v for c, v in (changed or {}).items()}
    tampered = F.when(where, leaf_digest([then[c] for c in columns])) if where is not None else F.lit(None).cast("binary")
    leaves = table.select(
        F.col(order).alias("at"), group_key(F.col(group)).alias("g"),
        leaf_digest([now[c] for c in columns]).alias("digest"), tampered.alias("changed"),
    )
    leaves = placed(stage(leaves, "leaves"), "g", ["at", "digest"])
    tiers = _tiers(leaves)
    roots = tiers[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "digest")
    top = placed(roots, "g", ["name"])
    tops = _tiers(top)
    nothing = F.array().cast("array<string>")
    whole = tops[-1].select("g", F.col("pos").alias("block"), nothing.alias("lefts"), nothing.alias("rights"), F.lit("").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    steps = top.select("g", "pos", "n", "digest").groupBy("g", _block()).cogroup(_down(tops, whole).groupBy("g", "block")).applyInPandas(_descend, _ABOVE)
    above = steps.join(top.select(F.col("pos").alias("block"), "name", "digest"), "block").select(
        F.col("name").alias("g"), F.lit(0).cast("long").alias("block"), "lefts", "rights", F.lower(F.hex("digest")).alias("subroot"), "root"
    )
    above = _down(tiers, stage(above, "paths"))

    def prove(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(above):
            raise ValueError("a block of the tree has lost its path")
        group, up = group.sort_values("pos"), above.iloc[0]
        own = [d.hex() for d in group["digest"]]
        levels = levels_above(own, int(group["n"].iloc[0]))
        rest = "".join(left + right for left, right in zip(up["lefts"], up["rights"], strict=True))
        onward: dict[str, list[str]] = {}  # block root -> the nodes that a version with it copies above
        rows = []
        for i, (leaf, new) in enumerate(zip(own, group["changed"], strict=True)):
            lefts, rights = siblings(levels, i)
            proof = _hex_of("".join(left + right for left, right in zip(lefts, rights, strict=True)) + rest)
            path = [leaf if new is None else new.hex()]
            path += copied_path(path[0], lefts, rights)
            if path[-1] not in onward:
                onward[path[-1]] = copied_path(path[-1], up["lefts"], up["rights"])
            path += onward[path[-1]]
            rows.append((proof, path[-1], path if paths and new is not None else None))
        return pd.DataFrame(
            {
                "at": group["at"], "g": group["g"], "leaf": own, "subroot": up["subroot"], "root": up["root"],
                "proof_sha256": [r[0] for r in rows], "folded_root": [r[1] for r in rows], "copied": [r[2] for r in rows],
            }
        )

    proven = (
        leaves.withColumn("at", F.col("at").cast("string"))  # pandas has no null integers
        .groupBy("g", _block())
        .cogroup(above.groupBy("g", "block"))
        .applyInPandas(prove, "at string, g string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, copied array<string>")
    )
    return proven.select(
        F.col("at").cast(table.schema[order].dataType).alias(order), key_value(F.col("g"), table.schema[group].dataType).alias(group),
        "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *(["copied"] if paths else []),
    )
