"""Near-duplicate detection with ProbMinHash.

Documents are weighted sets of five-word shingles (the weight is the count). Every shingle is a Poisson
process of arrivals with its weight as rate; each arrival falls into a random register, which keeps the
shingle that came first. A shingle stops once its next arrival is later than every register's. Two
documents agree in a register with probability equal to their probability Jaccard similarity

    J(a, b) = sum over d in both of 1 / sum over e of max(a_e / a_d, b_e / b_d),

which for shingles that occur once is the usual Jaccard similarity. Bands of registers give candidate
pairs, and these are verified on the exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.batches import small_batches
from shelfcast.llm.spread import salted_left_join
from shelfcast.llm.words import SHINGLE, counted, mixed, shingle_hashes, sliced, word_hashes
from shelfcast.sources.storage import stage

BANDS = 36
ROWS = 6  # registers of a band; a pair at 0.8 is in no common band with probability (1 - 0.8^6)^36 = 2e-5
THRESHOLD = 0.8
BLOCK = 64  # documents of one bucket compared in one task at a time
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(owner: np.ndarray, items: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """texts x registers: the item that came first in each register; 0 for texts without items."""
    first = np.full(texts * registers, np.inf)
    holder = np.zeros(texts * registers, np.uint64)
    latest = np.full(texts, np.inf)
    arrival, rate, seed = np.zeros(len(items)), weight.astype(np.float64), mixed(items)
    while len(items):
        seed = seed + _STEP
        draw = mixed(seed)
        arrival = arrival - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
        cell = owner * registers + (mixed(draw) % np.uint64(registers)).astype(np.int64)
        on_time = arrival < first[cell]
        np.minimum.at(first, cell[on_time], arrival[on_time])
        won = on_time & (first[cell] == arrival)
        holder[cell[won]] = items[won]
        there = np.unique(owner)
        latest[there] = first.reshape(texts, registers)[there].max(1)
        going = arrival < latest[owner]  # an item whose arrivals are past every register is done
        owner, items, rate, seed, arrival = owner[going], items[going], rate[going], seed[going], arrival[going]
    return holder.reshape(texts, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact similarity of two weighted sets, given as sorted items and their weights."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    order = np.argsort(x / y)
    x, y = x[order], y[order]
    ratio = x / y
    # for item d, e counts with a_e / a_d where a_e / b_e >= a_d / b_d, and with b_e / b_d elsewhere
    at_least = np.searchsorted(ratio, ratio, side="left")
    tail = np.r_[np.cumsum(x[::-1])[::-1], 0.0]
    head = np.r_[0.0, np.cumsum(y)]
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    return float((1.0 / ((tail[at_least] + only_a) / x + (head[at_least] + only_b) / y)).sum())


def _weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
    _, items, weight = counted(*shingle_hashes(*word_hashes([text])))
    return items, weight


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(_id, _key, _text) to (_id, _key, content, bands): a digest of the words in order, and the hash of each
    band; null for texts without words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sliced(frames, "_text"):
            owner, words = word_hashes(frame["_text"].tolist())
            size = np.bincount(owner, minlength=len(frame))
            start = np.cumsum(size) - size
            place = np.arange(len(words)) - start[owner]
            digest = [np.zeros(len(frame), np.uint64) for _ in range(2)]
            for i, d in enumerate(digest):
                np.add.at(d, owner, mixed(words + mixed(place.astype(np.uint64) + np.uint64(i << 40))))
            held = signatures(*counted(*shingle_hashes(owner, words)), len(frame), bands * rows)
            band = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(frame), bands))
            for r in range(rows):
                band = mixed(band + _STEP + held.reshape(len(frame), bands, rows)[:, :, r])
            some = size > 0
            yield pd.DataFrame(
                {
                    "_id": frame["_id"].to_numpy(),
                    "_key": frame["_key"].to_numpy(),
                    "content": [f"{a:016x}{b:016x}" if s else None for a, b, s in zip(*map(np.ndarray.tolist, digest), some, strict=True)],
                    "bands": [x if s else None for x, s in zip(band.view(np.int64), some, strict=True)],
                }
            )

    return docs.mapInPandas(run, "_id long, _key binary, content string, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b) those whose exact similarity reaches the threshold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, None
        for frame in frames:
            keep = np.zeros(len(frame), bool)
            for k, (a, x, y) in enumerate(zip(frame["a"], frame["x"], frame["y"], strict=True)):
                if a != last:
                    last, left = a, _weighted(x)
                keep[k] = probability_jaccard(left, _weighted(y)) >= threshold
            yield frame.loc[keep, ["a", "b"]]

    one = texts.select(F.col("_id").alias("a"), F.col("_text").alias("x"))
    two = texts.select(F.col("_id").alias("b"), F.col("_text").alias("y"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(_id, label): the smallest id that links (a, b) connect each node with. Every round takes the
    smallest label next door and then the label of that label, so chains shrink by halves."""
    label = stage(nodes.select("_id", F.col("_id").alias("label")), "labels")
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    while True:
        near = stage(
            both.join(label.select(F.col("_id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near")), "near"
        )
        closer = label.join(near, label["_id"] == near["a"], "left").select(
            "_id", "label", F.least("label", "near").alias("to")
        )
        closer = stage(closer, "closer")
        onward = closer.select(F.col("_id").alias("via"), F.col("to").alias("end"))
        after = stage(
            closer.join(onward, closer["to"] == onward["via"]).select("_id", F.col("end").alias("label"), (F.col("end") != closer["label"]).alias("moved")),
            "labels",
        )
        label = after.select("_id", "label")
        if after.where("moved").isEmpty():
            return label


def _ordered(met: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of the members with their leaders."""
    return met.select(F.least("_id", "leader").alias("a"), F.greatest("_id", "leader").alias("b")).distinct()


def _open(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members with their label, of buckets whose members are not all in one class."""
    parted = stage(members.join(label, "_id"), "parted")
    split = parted.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return stage(parted.join(stage(split, "split"), "key"), "open")


def _remaining_links(rows: DataFrame, texts: DataFrame, bands: DataFrame, registers: int, threshold: float) -> DataFrame:
    """Links of the members outside a bucket's largest class with the rest of the bucket.

    Both sides are cut into blocks of about BLOCK members, and a task meets two blocks at a time. It
    takes a pair in the first bucket the two share, drops those whose signatures are too far apart,
    verifies the rest on their texts, and stops asking about classes that it has already joined; so no
    more links come out than members went in.
    """
    slack = 4.0 * (threshold * (1 - threshold) / registers) ** 0.5

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sliced(frames, "_text"):
            held = signatures(*counted(*shingle_hashes(*word_hashes(frame["_text"].tolist()))), len(frame), registers)
            yield frame.assign(signature=[r.astype("<u4").tobytes() for r in held])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids, label, outside = (group[c].to_numpy() for c in ("_id", "label", "outside"))
        held = np.frombuffer(b"".join(group["signature"]), "<u4").reshape(len(group), registers)
        buckets, here = np.stack(group["bands"].to_numpy()), group["key"].iloc[0]
        parent = {x: x for x in label.tolist()}
        weighted: dict[int, tuple] = {}

        def root(x: int) -> int:
            while parent[x] != x:
                x = parent[x]
            return x

        def of(k: int) -> tuple[np.ndarray, np.ndarray]:
            if k not in weighted:
                weighted[k] = _weighted(group["_text"].iat[k])
            return weighted[k]

        out = []
        inside = np.flatnonzero(~outside)
        for k in np.flatnonzero(outside):
            other = inside[label[inside] != label[k]]
            other = other[(held[other] == held[k]).mean(1) >= threshold - slack]
            both = buckets[other] == buckets[k]
            other = other[buckets[k][both.argmax(1)] == here]
            for o in other:
                x, y = root(label[k]), root(label[o])
                if x != y and probability_jaccard(of(k), of(o)) >= threshold:
                    parent[max(x, y)] = min(x, y)
                    out.append((min(ids[k], ids[o]), max(ids[k], ids[o])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    counts = stage(rows.groupBy("key", "label").agg(F.count("*").alias("n")), "class_counts")
    main = stage(
        counts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all")).select(
            "key", F.col("m.label").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("every"),
            F.ceil((F.col("all") - F.col("m.n")) / BLOCK).cast("int").alias("away"),
        ),
        "main_classes",
    )
    placed = rows.join(main, "key")
    hashed = F.xxhash64("_id")

    def dealt(own: str, others: str, i: str, j: str) -> list:
        return [F.pmod(hashed, own).cast("int").alias(i), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(j)]

    meets = (
        placed.where("label <> main").select("key", "_id", "label", F.lit(True).alias("outside"), *dealt("away", "every", "i", "j"))
        .unionByName(placed.select("key", "_id", "label", F.lit(False).alias("outside"), *dealt("every", "away", "j", "i")))
    )
    involved = stage(rows.select("_id").distinct(), "open_ids")
    signed = texts.join(involved, "_id").mapInPandas(sign, "_id long, _text string, signature binary")
    signed = stage(signed.join(bands, "_id"), "signatures")
    return meets.join(signed, "_id").groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def marked_rows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per document: doc_id, _key (a digest of the text), copy_id, group_id, group_size and kept. What
    is compared and linked are contents, the distinct texts by their words, whatever ids they have."""
    docs = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).withColumn("_key", _text_key(F.col("_text")))
    live = docs.where("_id is not null and _text is not null")
    with small_batches(docs.sparkSession):
        sketched = stage(sketch(live, bands, rows), "sketches")
    alone = sketched.where("content is null").select("_id", "_key").unionByName(docs.where("_id is null or _text is null").select("_id", "_key"))
    sketched = sketched.where("content is not null")
    # of the rows of a content one gives the text that it is compared by
    first = F.min(F.struct("_id", "_key")).alias("first")
    contents = sketched.groupBy("content").agg(first, F.any_value("bands").alias("bands"))
    # a number for each content, fixed as it is stored
    contents = contents.select(F.monotonically_increasing_id().alias("_id"), "content", F.col("first._id").alias("copy_id"), F.col("first._key").alias("_key"), "bands")
    contents = stage(contents, "contents")
    label = _classes(contents, live, threshold, bands, rows)
    return _with_classes(sketched, alone, contents, label)


def _classes(copies: DataFrame, live: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """(_id, label) of the contents that share a bucket with others."""
    # one row per distinct content; buckets of one content hold no pair
    banded = copies.select("_id", F.explode("bands").alias("key"))
    shared = stage(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = stage(banded.join(shared, "key"), "members")
    # first the member of each bucket that meets most others is compared with all of it: what copies are
    # made from is nearer to them than they are to each other
    degree = stage(members.groupBy("_id").agg(F.sum("n").alias("degree")), "degrees")
    members = members.select("key", "_id")
    hub = F.min(F.struct((-F.col("degree")).alias("d"), "_id"))["_id"].alias("leader")
    leaders = stage(members.join(degree, "_id").groupBy("key").agg(hub), "leaders")
    # of its leaders, each member first meets the one with most others around it
    led = stage(members.join(leaders, "key").where("_id <> leader").select("_id", "leader").distinct(), "led")
    nearest = led.join(degree.select(F.col("_id").alias("leader"), "degree"), "leader").groupBy("_id").agg(
        F.min(F.struct((-F.col("degree")).alias("d"), "leader"))["leader"].alias("leader")
    )
    pairs = stage(_ordered(nearest), "pairs")
    involved = stage(members.select("_id").distinct(), "involved")
    wanted = copies.join(involved, "_id").select(F.col("_id").alias("node"), F.col("copy_id").alias("_id"), "_key")
    texts = live.join(wanted, ["_id", "_key"]).groupBy("node").agg(F.any_value("_text").alias("_text"))
    texts = stage(texts.select(F.col("node").alias("_id"), "_text"), "texts")
    with small_batches(live.sparkSession):
        links = stage(verified(pairs, texts, threshold), "links")
    ids = texts.select("_id")
    label = components(ids, links)
    # then the other leaders that are still of another class
    its = label.select(F.col("_id").alias("leader"), F.col("label").alias("its"))
    apart = led.join(label, "_id").join(its, "leader").where("label <> its").select("_id", "leader")
    apart = stage(_ordered(apart).join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not apart.isEmpty():
        with small_batches(live.sparkSession):
            links = stage(links.union(verified(apart, texts, threshold)), "links")
        label = components(ids, links)
    # then, in buckets that are not of one class, a member drawn by hash
    rest = stage(members.join(leaders, "key").where("_id <> leader").drop("leader"), "rest")
    rows_left = _open(rest, label)
    if not rows_left.isEmpty():
        drawn = F.min(F.struct(F.xxhash64("key", "_id").alias("h"), "_id", "label")).alias("m")
        drawn = stage(rows_left.groupBy("key").agg(drawn).select("key", F.col("m._id").alias("leader"), F.col("m.label").alias("its")), "drawn")
        met = rows_left.join(drawn, "key").where("label <> its")
        with small_batches(live.sparkSession):
            links = links.union(stage(verified(stage(_ordered(met), "pairs"), texts, threshold), "links"))
        label = components(ids, links)
        rest = stage(rest.join(drawn.select("key", "leader"), "key", "left").where("leader is null or _id <> leader").drop("leader"), "rest")
        # and at last all pairs that are still open
        rows_left = _open(rest, label)
        if not rows_left.isEmpty():
            every_band = copies.select("_id", "bands")
            with small_batches(live.sparkSession):
                found = stage(_remaining_links(rows_left, texts, every_band, bands * rows, threshold), "links")
            label = components(ids, links.union(found))
    return label


def _with_classes(sketched: DataFrame, alone: DataFrame, contents: DataFrame, label: DataFrame) -> DataFrame:
    classes = contents.select("_id", "content", "copy_id").join(label, "_id", "left").select(
        "content", "copy_id", F.coalesce("label", "_id").alias("class")
    )
    # a third of all rows may be copies of one content
    row = F.xxhash64("_id", "_key")
    member = stage(salted_left_join(sketched.select("_id", "_key", "content"), stage(classes, "classes"), ["content"], row), "classed")
    # rows that repeat id and words count once
    each = member.groupBy("class", "_id", "content").agg(F.min("_key").alias("_key"))
    sizes = each.groupBy("class").agg(F.count("*").alias("group_size"), F.min(F.struct("_id", "_key")).alias("first"))
    sizes = sizes.select("class", "group_size", F.col("first._id").alias("group_id"), F.col("first._key").alias("first_key"))
    known = salted_left_join(member, stage(sizes, "class_sizes"), ["class"], row)
    kept = (F.col("_id") == F.col("group_id")) & (F.col("_key") == F.col("first_key"))
    marked = known.select(F.col("_id").alias("doc_id"), "_key", "copy_id", "group_id", "group_size", kept.alias("kept"))
    single = alone.select(
        F.col("_id").alias("doc_id"), "_key", F.col("_id").alias("copy_id"), F.col("_id").alias("group_id"),
        F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
    )
    return marked.unionByName(single)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, copy_id (the smallest id with the same words in the same order),
    group_id (the smallest id of its class), group_size and kept.

    Classes are the components of the links between texts of similarity `threshold` or more. Of each class
    one document is kept, that with the smallest id, and of rows that repeat that id the one with the first
    digest; rows that repeat id and text are kept or dropped together. Rows that repeat an id with other words
    are documents of their own: each is linked by its own words only. Texts that are null or without words
    are alone in their class; texts of fewer than five words have one shingle. Rows without an id take no
    part and are kept, with null ids. Other columns are ignored; an empty table gives an empty result.

    A pair at the threshold shares no band with probability 2e-5; of the pairs that are still open in the last
    round those whose signatures agree four standard deviations below the threshold are not verified, which
    costs a pair at the threshold with probability 3e-5.
    """
    return marked_rows(docs, doc_id, text, **options).drop("_key")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay: one document of each class, and rows without an id."""
    marked = marked_rows(docs, doc_id, text, **options)
    gone = stage(marked.where("not kept").select(F.col("doc_id").alias("_gone"), "_key").distinct(), "near_copies")
    same = (docs[doc_id].cast("long") == gone["_gone"]) & (_text_key(docs[text]) == gone["_key"])
    return docs.join(gone, same, "left_anti")
