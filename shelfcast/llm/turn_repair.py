"""Conversation structure repair by depth-first branch and bound.

A conversation is a row of roles and faults. Rows may be kept, given another role, deleted, and empty turns
inserted, each at a cost, until the roles read `system? (user assistant)+`, or nothing is left. The search
keeps an explicit stack. Its bound is the cost so far and the least that the rows that follow cost if the
roles may end anywhere; the incumbent is the best complete (cost, audit); a table for each place and state holds the
best (cost, audit) that has come there, and a prefix that is no better is dropped. What survives is proved
optimal. Of equal costs the ASCII-least audit wins; two prefixes of one place, state and cost are never each
other's beginnings, so the better prefix stays better whatever follows.

Conversations are cut into segments of 64 rows, so that a long one spreads over many tasks: a segment is
solved from every state in which it can begin to every state in which it can end, and the cheapest chain of
segments is picked from these.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.spread import group_key, key_value, placed, salted_left_join
from shelfcast.sources.storage import stage

SEGMENT = 64
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5  # costs; the last is that of a truncated row that stays

START, SYSTEM, USER, ASSISTANT = range(4)  # the last role so far
STATES = (START, SYSTEM, USER, ASSISTANT)
ENDS = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
_INITIAL = {USER: "u", ASSISTANT: "a"}
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")


@lru_cache(maxsize=64)
def bounds(codes: str) -> list[tuple[int, ...]]:
    """For each place and each state, the least that the rows from there on cost if the last role may be any.
    Codes: s, u, a, x for the initial of the role (x: another), upper case if truncated, d if it must go."""
    rest = [(0, 0, 0, 0)]
    for c in reversed(codes):
        after, code = rest[-1], c.lower()
        late = UNFINISHED if c != code else 0
        row = []
        for state in STATES:
            then = ASSISTANT if state == USER else USER
            least = DELETE + after[state]
            if code != "d":
                least = min(least, late + (KEEP if code == _INITIAL[then] else REROLE) + after[then])
                if code == "s" and state == START:
                    least = min(least, late + KEEP + after[SYSTEM])
            row.append(least)
        ahead = [INSERT + row[ASSISTANT if state == USER else USER] for state in STATES]
        rest.append(tuple(map(min, row, ahead)))
    return rest[::-1]


def search(codes: str, entry: int, exits: Collection[int]) -> tuple[int, str] | None:
    """The least (cost, audit) of edits that lead from state `entry` over all rows to a state in `exits`."""
    n, rest = len(codes), bounds(codes)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    found: tuple[int, str] | None = None
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        least = cost + rest[i][state]
        if found is not None and (least > found[0] or (least == found[0] and audit > found[1][: len(audit)])):
            continue
        if (i, state) in best and best[i, state] <= (cost, audit):
            continue
        best[i, state] = (cost, audit)
        if i == n and state in exits and (found is None or (cost, audit) < found):
            found = (cost, audit)
        then = ASSISTANT if state == USER else USER
        nexts = [(cost + INSERT, i, then, audit + "I")]
        if i < n:
            nexts.append((cost + DELETE, i + 1, state, audit + "D"))
            code = codes[i].lower()
            if code != "d":
                stays = cost + (UNFINISHED if codes[i] != code else 0)
                if code == _INITIAL[then]:
                    nexts.append((stays + KEEP, i + 1, then, audit + "K"))
                else:
                    nexts.append((stays + REROLE, i + 1, then, audit + "R"))
                if code == "s" and state == START:
                    nexts.append((stays + KEEP, i + 1, SYSTEM, audit + "K"))
        nexts.sort(key=lambda x: (x[0] + rest[x[1]][x[2]], x[3]), reverse=True)
        stack += [(place, to, spent, said) for spent, place, to, said in nexts]
    return found


@lru_cache(maxsize=20_000)
def solutions(codes: str, whole: bool) -> list[dict]:
    """The best edits of a segment: of a whole conversation, or else for every entry and exit."""
    if whole:
        cost, audit = search(codes, START, ENDS)
        return [{"entry": START, "exit": -1, "cost": cost, "audit": audit}]
    each = [(a, b, search(codes, a, (b,))) for a in STATES for b in STATES]
    return [{"entry": a, "exit": b, "cost": x[0], "audit": x[1]} for a, b, x in each if x is not None]


def cheapest_chain(segments: list[list[dict]]) -> tuple[int, list[dict]]:
    """The least (cost, audit) over chains of solutions that begin at START and end at one of ENDS."""
    if len(segments) == 1 and len(segments[0]) == 1:
        return segments[0][0]["cost"], segments[0]
    best = {START: (0, "", None)}
    for found in segments:
        after: dict[int, tuple] = {}
        for x in found:
            if x["entry"] in best:
                cost, audit, _ = best[x["entry"]]
                new = (cost + x["cost"], audit + x["audit"], (best[x["entry"]], x))
                if x["exit"] not in after or new[:2] < after[x["exit"]][:2]:
                    after[x["exit"]] = new
        best = after
    cost, _, link = min((best[e] for e in ENDS if e in best), key=lambda x: x[:2])
    chain = []
    while link is not None:
        before, x = link
        chain.append(x)
        link = before[2]
    return cost, chain[::-1]


def turns_of(codes: str, entry: int, audit: str) -> list[dict]:
    """The turns that stay or are new: idx (place in the audit), row (place in the segment, null if new)
    and role (null if kept)."""
    out, state, row = [], entry, 0
    for idx, edit in enumerate(audit):
        if edit == "D":
            row += 1
            continue
        state = SYSTEM if edit == "K" and state == START and codes[row] in "sS" else ASSISTANT if state == USER else USER
        out.append({"idx": idx, "row": None if edit == "I" else row, "role": None if edit == "K" else ROLE[state]})
        row += edit != "I"
    return out


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def marked_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One narrow row per input row: g (key of the conversation), turn, role, digest (of the text), pos, n,
    fault (blank, duplicate, truncated or null) and code."""
    stripped = F.expr("rtrim(concat(' ', '\\t', '\\n', '\\u000b', '\\u000c', '\\r'), _text)")
    ended = F.substring(stripped, -1, 1).isin(".", "!", "?")
    narrow = rows.select(
        group_key(F.col(conv)).alias("g"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    ).select(
        "g", "turn", "role", _digest(F.col("_text")).alias("digest"),
        F.when(stripped == "", "blank").when(~ended, "truncated").alias("own"),
    )
    rows = placed(stage(narrow, "turns"), "g", ["turn", "role", "digest"])
    # copies of a turn may be a large part of a conversation
    same = ["g", "role", "digest"]
    firsts = rows.groupBy(*same).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    seen = salted_left_join(rows, firsts.drop("copies"), same, F.col("pos"))
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("first") < F.col("pos"), "duplicate").otherwise(F.col("own"))
    initial = _initial(F.col("role"))
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    marked = seen.select("g", "turn", "role", "digest", "pos", "n", fault.alias("fault")).withColumn("code", code)
    return stage(marked, "marked_turns")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _segment() -> Column:
    return F.floor(F.col("pos") / SEGMENT).cast("long")


def solved_segments(marked: DataFrame) -> DataFrame:
    """One row per segment: g, seg, codes, illegal (neighbouring roles) and its solutions."""
    last = (F.col("pos") % SEGMENT == SEGMENT - 1) & (F.col("pos") + 1 < F.col("n"))
    # the last row of a segment is also seen by the next one, as its first one's neighbour
    seen = marked.withColumn("seg", F.explode(F.when(last, F.array(_segment(), _segment() + 1)).otherwise(F.array(_segment()))))
    own = F.when(F.col("seg") == _segment(), F.col("code")).otherwise("")
    gathered = F.sort_array(F.collect_list(F.struct("pos", _initial(F.col("role")).alias("initial"), own.alias("code"))))
    segments = seen.groupBy("g", "seg").agg(gathered.alias("r"), F.max("n").alias("n")).select(
        "g", "seg", F.array_join("r.code", "").alias("codes"), F.array_join("r.initial", "").alias("initials"), (F.col("n") <= SEGMENT).alias("whole")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            solved = [solutions(c, bool(w)) for c, w in zip(f["codes"], f["whole"], strict=True)]
            yield f[["g", "seg", "codes"]].assign(illegal=f["initials"].map(_illegal), solutions=solved)

    return stage(
        segments.mapInPandas(run, "g string, seg long, codes string, illegal long, solutions array<struct<entry:int,exit:int,cost:long,audit:string>>"),
        "solved_segments",
    )


def chosen_edits(segments: DataFrame) -> DataFrame:
    """One row per conversation: g, cost, illegal and chain, the seg, codes, entry and audit of its segments."""
    gathered = segments.groupBy("g").agg(
        F.sum("illegal").alias("illegal"), F.sort_array(F.collect_list(F.struct("seg", "codes", "solutions"))).alias("segments")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cost, chains = [], []
            for segments in f["segments"]:
                total, chain = cheapest_chain([list(s["solutions"]) for s in segments])
                cost.append(total)
                chains.append([{"seg": s["seg"], "codes": s["codes"], "entry": x["entry"], "audit": x["audit"]} for s, x in zip(segments, chain, strict=True)])
            yield f[["g", "illegal"]].assign(cost=cost, chain=chains)

    return gathered.mapInPandas(run, "g string, illegal long, cost long, chain array<struct<seg:long,codes:string,entry:int,audit:string>>")


def _kept_turns(chosen: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 1000):
                part = f.iloc[at : at + 1000]
                made = [turns_of(c, e, a) for c, e, a in zip(part["codes"], part["entry"], part["audit"], strict=True)]
                yield part[["g", "seg"]].assign(made=made)

    each = chosen.select("g", F.explode("chain").alias("x")).select("g", "x.seg", "x.codes", "x.entry", "x.audit")
    made = each.mapInPandas(run, "g string, seg long, made array<struct<idx:int,row:int,role:string>>")
    return made.select("g", "seg", F.explode("made").alias("m")).select(
        "g", "seg", "m.idx", (F.col("seg") * SEGMENT + F.col("m.row")).alias("pos"), F.col("m.role").alias("new_role")
    )


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The faults and edits of every conversation, and the repaired turns.

    First: the id column, gaps, blank, duplicate, truncated, illegal, cost and audit, one row per
    conversation. Rows are taken by turn, null first; rows of one turn by role and then by digest of their
    text. gaps is how many turn numbers are missing between the least and the largest. Each row's first
    fault counts: blank (nothing but blanks), duplicate (an earlier row has its role and text), truncated
    (the last character that is no blank is none of `.!?`). illegal counts neighbours whose roles' initials
    are none of su, ua, au. The audit has a letter for each edit in order: K keep, R rerole, D delete,
    I insert.

    Second: the id column, seg and idx (their order), turn (null if inserted), role and text.

    Null roles and texts are empty: the first has no initial and is never kept, the second is blank. A null
    id is a conversation like others. Rows that repeat are duplicates. Other columns are ignored. Empty
    tables give empty results.
    """
    marked = marked_rows(rows, conv, turn, role, text)
    chosen = stage(chosen_edits(solved_segments(marked)), "chosen_edits")
    kind = rows.schema[conv].dataType

    def number(fault: str) -> Column:
        return F.count(F.when(F.col("fault") == fault, 1)).alias(fault)

    counted = marked.groupBy("g", "turn").agg(*[number(x) for x in ("blank", "duplicate", "truncated")]).groupBy("g").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")],
    )
    summary = counted.join(chosen, "g").select(
        key_value(F.col("g"), kind).alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.array_join("chain.audit", "").alias("audit")
    )
    # a turn that stays is the only one of its role and text that does
    same = ["g", "role", "digest"]
    texts = rows.select(
        group_key(F.col(conv)).alias("g"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("digest", _digest(F.col("text"))).groupBy(*same).agg(F.any_value("text").alias("text"))
    turns = stage(_kept_turns(chosen), "kept_turns")
    stay = turns.where("pos is not null").join(marked.select("g", "pos", "turn", "role", "digest"), ["g", "pos"]).join(texts, same)
    new = turns.where("pos is null").select("g", "seg", "idx", F.lit(None).cast(rows.schema[turn].dataType).alias("turn"), F.col("new_role").alias("role"), F.lit("").alias("text"))
    stay = stay.select("g", "seg", "idx", "turn", F.coalesce("new_role", "role").alias("role"), "text")
    repaired = stay.unionByName(new).select(key_value(F.col("g"), kind).alias(conv), "seg", "idx", "turn", "role", "text")
    return summary, repaired
