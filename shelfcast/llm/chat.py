"""Chat formatting from reply trees.

Messages point to the message they answer. Iterative self-joins that double the distance they jump
find, for every leaf, the score and length of its path from the root; the best paths of each
conversation are marked on the way back down and written as one text each.

Control strings inside texts are escaped with a backslash: a control string after k backslashes is
written after k + 1 of them. A blank always stands between a text and the mark that follows, so no
text can turn a real mark into an escaped one, and removing one backslash restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.sources.storage import stage

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
# role -> mark before and after its text; other roles name themselves
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}


_ANY = "(" + "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in CONTROLS) + ")"
# A body holds no control string right after a blank, so it ends at the first such place.
_TURN = (
    r"(?:(\[INST\]|<s>|<<SYS>>) |\[ROLE\] ([\s\S]*?) \[/ROLE\] )([\s\S]*?) (?:\[/INST\]|</s>|<</SYS>>)"
)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)" + _ANY, r"\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)" + _ANY, "$1$2")


def _wrapped(role: Column, text: Column) -> tuple[Column, Column]:
    """The strings before and after the escaped text of a turn."""
    before = F.concat(F.lit("[ROLE] "), escaped(role), F.lit(" [/ROLE] "))
    after = F.lit(" </s>")
    for name, (left, right) in MARKS.items():
        before = F.when(role == name, F.lit(left)).otherwise(before)
        after = F.when(role == name, F.lit(right)).otherwise(after)
    return before, after


def best_paths(
    messages: DataFrame,
    conv: str = "conv_id",
    node: str = "node",
    parent: str = "parent",
    score: str = "score",
    paths: int = 1,
) -> DataFrame:
    """Messages on the chosen root-to-leaf paths: all columns of `messages`, and path (1 is best),
    depth (from 0 at the root).

    Nodes are unique within a conversation. A path's score is the sum over its messages (null counts
    as 0); of equal scores the longer path wins, then the smaller leaf. A parent that is null or
    absent starts a tree; rows without a node are left out; messages on a cycle hang on no root and
    are left out. `paths` is how many branches of each conversation are written.
    """
    nodes = messages.where(F.col(node).isNotNull()).select(
        F.col(conv).alias("_c"), F.col(node).alias("_n"), F.col(parent).alias("_p"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("_s")
    )
    # (_jump, _sum, _len): an ancestor, and the score and number of messages from the node up to below it
    known = nodes.select(F.col("_c").alias("_kc"), F.col("_n").alias("_kn"))
    reach = stage(
        nodes.join(known, F.col("_c").eqNullSafe(F.col("_kc")) & (F.col("_p") == F.col("_kn")), "left").select(
            "_c", "_n", F.col("_kn").alias("_jump"), F.col("_s").alias("_sum"), F.lit(1).alias("_len")
        ),
        "reach",
    )
    parents = reach.select("_c", F.col("_jump").alias("_n")).where("_n is not null").distinct()
    leaves = _null_safe(reach, parents, "left_anti").select("_c", "_n")
    # levels: messages that have an ancestor 2^i above them; ended: those that have reached their root
    levels, ended = [reach.where("_jump is not null")], reach.where("_jump is null")
    total = reach.count()
    while not levels[-1].isEmpty() and 2 ** len(levels) <= 2 * total:
        up = ended.unionByName(levels[-1]).select(
            F.col("_c").alias("_uc"), F.col("_n").alias("_un"), F.col("_jump").alias("_uj"), F.col("_sum").alias("_us"), F.col("_len").alias("_ul")
        )
        doubled = levels[-1].join(up, F.col("_c").eqNullSafe(F.col("_uc")) & (F.col("_jump") == F.col("_un"))).select(
            "_c", "_n", F.col("_uj").alias("_jump"), (F.col("_sum") + F.col("_us")).alias("_sum"), (F.col("_len") + F.col("_ul")).alias("_len")
        )
        doubled = stage(doubled, "reach")
        levels.append(doubled.where("_jump is not null"))
        ended = ended.unionByName(doubled.where("_jump is null"))
    rank = Window.partitionBy("_c").orderBy(F.desc("_sum"), F.desc("_len"), F.asc("_n"))
    chosen = (
        _null_safe(ended, leaves, "left_semi")
        .withColumn("path", F.row_number().over(rank))
        .where(F.col("path") <= paths)
        .select("_c", "_n", "path", (F.col("_len") - 1).alias("depth"))
    )
    # back down: every marked message marks the ancestor 2^i above it; stored, or the plan would double each time
    chosen = stage(chosen, "chosen")
    for level, table in reversed(list(enumerate(levels))):
        jump = table.select(F.col("_c").alias("_uc"), F.col("_n").alias("_un"), "_jump")
        above = chosen.join(jump, F.col("_c").eqNullSafe(F.col("_uc")) & (F.col("_n") == F.col("_un"))).select(
            "_c", F.col("_jump").alias("_n"), "path", (F.col("depth") - 2**level).alias("depth")
        )
        chosen = stage(chosen.unionByName(above), "chosen")
    marked = chosen.select(F.col("_c").alias("_kc"), F.col("_n").alias("_kn"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
    keep = [messages[c] for c in messages.columns if c not in ("path", "depth")]
    return messages.join(marked, messages[conv].eqNullSafe(F.col("_kc")) & (messages[node] == F.col("_kn"))).select(
        *keep, F.col("_path").alias("path"), F.col("_depth").alias("depth")
    )


def _null_safe(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    other = right.select(F.col("_c").alias("_rc"), F.col("_n").alias("_rn"))
    return left.join(other, F.col("_c").eqNullSafe(F.col("_rc")) & (F.col("_n") == F.col("_rn")), how)


def format_paths(turns: DataFrame, conv: str = "conv_id", order: str = "depth", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation and path: conv, path, formatted, loss_spans (array of start and end in
    code points of the formatted text, one for each assistant turn). Null roles and texts are empty."""
    has_path = "path" in turns.columns
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    before, after = _wrapped(r, t)
    parts = turns.select(
        F.col(conv), F.col("path") if has_path else F.lit(1).alias("path"),
        F.struct(F.col(order).alias("at"), before.alias("before"), escaped(t).alias("body"), after.alias("after"), (r == "assistant").alias("learn")).alias("turn"),
    )
    grouped = parts.groupBy(conv, "path").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        first = state.at + F.length(turn.before)
        last = first + F.length(turn.body)
        span = F.array(F.struct(first.alias("start"), last.alias("end")))
        return F.struct((last + F.length(turn.after)).alias("at"), F.when(turn.learn, F.concat(state.spans, span)).otherwise(state.spans).alias("spans"))

    return grouped.select(
        conv, "path",
        F.array_join(F.transform("turns", lambda x: F.concat(x.before, x.body, x.after)), "").alias("formatted"),
        F.aggregate("turns", start, add, lambda s: s.spans).alias("loss_spans"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text: array of role and text, in order, unescaped."""
    marks, roles, texts = (F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(i)) for i in (1, 2, 3))
    zipped = F.arrays_zip(marks.alias("mark"), roles.alias("named"), texts.alias("text"))

    def turn_of(x: Column) -> Column:
        role = F.when(x["mark"] == "[INST]", "user").when(x["mark"] == "<s>", "assistant").when(x["mark"] == "<<SYS>>", "system").otherwise(unescaped(x["named"]))
        return F.struct(role.alias("role"), unescaped(x["text"]).alias("text"))

    return F.transform(zipped, turn_of)


def unescaped_spans(formatted: Column, spans: Column) -> Column:
    """All text under the spans, unescaped, in order and joined without anything between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(formatted.substr(s.start + 1, s.end - s.start))), "")
