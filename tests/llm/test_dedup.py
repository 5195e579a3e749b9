"""Exact and near deduplication: edge cases, and near-duplicates against all pairs."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from shelfcast.llm import exact_dedup, near_dedup

FOLDER = "/root/testdata/sf0.001"


def test_exact_dedup_edge_cases(spark):
    rows = [(1, "a", "x"), (2, "a", None), (3, None, "x"), (4, "", "y"), (None, "a", "z"), (5, "long " * 50_000, "w"), (6, "b", "w"), (6, "b", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = exact_dedup.mark_exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    kept = sorted((r.doc_id, r.group_size) for r in got if r.kept)
    assert kept == [(2, 3), (4, 2), (5, 1), (6, 2)]  # one of two identical rows
    assert {r.keep_id for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()} == {4}
    assert exact_dedup.drop_exact_duplicates(docs).count() == 4
    assert exact_dedup.drop_exact_duplicates(docs).columns == docs.columns
    assert exact_dedup.mark_exact_duplicates(docs.limit(0)).count() == 0


def test_exact_dedup_is_the_same_with_and_without_heavy_digests(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else string(id % 700) end as text")
    split = exact_dedup.mark_exact_duplicates(docs, heavy=4, tracked=64)
    winners = exact_dedup.heavy_digests(docs.selectExpr("text as d", "doc_id"), "d", "doc_id", 4, 64).collect()
    assert [(r.d, r._size, r._top) for r in winners] == [("hot", 1000, 2997)]
    whole = exact_dedup.mark_exact_duplicates(docs, heavy=1, tracked=64)
    assert sorted(split.collect()) == sorted(whole.collect())


def test_near_duplicates_match_all_pairs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(docs).collect()}
    weighted = {r.doc_id: near_dedup._weighted(r.text) for r in docs.collect()}
    parent = {i: i for i in weighted}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, (items, _) in weighted.items():
        for h in items.tolist():
            holders[h].append(i)
    for a, b in {(min(x, y), max(x, y)) for ids in holders.values() for x in ids for y in ids if x < y}:
        if near_dedup.probability_jaccard(weighted[a], weighted[b]) >= 0.8:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in weighted}
    assert len(set(got.values())) < len(got)


def test_near_duplicates_edge_cases(spark):
    words = [f"w{i}" for i in range(60)]
    base, near = " ".join(words), " ".join([*words[:58], "other", "end"])
    rows = [(5, base), (3, base), (9, near), (1, None), (2, ""), (4, "... !!"), (6, "two words"), (7, "Two, words"), (8, "two other"), (None, base), (9, near), (10, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "'z' as label")
    got = sorted((r.doc_id or 0, r.copy_id, r.group_id, r.group_size, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    want = [
        (0, None, None, 1, True), (1, 1, 1, 1, True), (2, 2, 2, 1, True), (3, 3, 3, 3, True), (4, 4, 4, 1, True), (5, 3, 3, 3, False),
        (6, 6, 6, 2, True), (7, 6, 6, 2, False), (8, 8, 8, 1, True), (9, 9, 3, 3, False), (9, 9, 3, 3, False), (10, 10, 10, 1, True),
    ]
    assert got == want
    assert near_dedup.drop_near_duplicates(docs).columns == docs.columns
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_repeat_an_id_with_other_words(spark):
    """An id may have several texts: each is kept unless its own words are those of another."""
    a, b = (" ".join(f"{w}{i}" for i in range(80)) for w in "ab")
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(5, a), (5, b), (2, a + " tail")], schema)
    assert {(r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(docs).collect()} == {(5, b), (2, a + " tail")}
    for one, two in ((a, b), (b, a)):  # the link of b is found whichever text is the smaller
        docs = spark.createDataFrame([(1, one), (1, two), (2, two + " tail"), (3, None), (3, "")], schema)
        marked = sorted((r.doc_id, r.group_id, r.group_size, r.kept) for r in near_dedup.near_duplicates(docs).collect())
        assert marked == [(1, 1, 1, True), (1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (3, 3, 1, True)]
        assert near_dedup.drop_near_duplicates(docs).count() == 4
    docs = spark.createDataFrame([(4, a), (4, a + " tail"), (4, a.upper()), (4, a)], schema)
    kept = near_dedup.drop_near_duplicates(docs).collect()
    assert len(kept) in (1, 2) and len({r.text for r in kept}) == 1


def test_members_of_a_bucket_that_only_match_each_other_are_linked(spark):
    """b and c are alike, a is their leader in shared buckets but like neither: its passage is theirs."""
    passage = [f"p{i}" for i in range(100)]
    a = " ".join(passage + [f"a{i}" for i in range(60)])
    b = " ".join(passage + [f"b{i}" for i in range(60)])
    c = " ".join(passage + [f"b{i}" for i in range(58)] + ["c1", "c2"])
    docs = spark.createDataFrame([(1, a), (2, b), (3, c)], "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(docs, bands=60, rows=1).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


@pytest.mark.parametrize("seed", range(5))
def test_probability_jaccard_follows_its_definition_and_its_estimate(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(2):
        items = np.sort(rng.choice(200, 120, replace=False)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        items.sort()
        sets.append((items, rng.integers(1, 9, 120)))
    a, b = (dict(zip(i.tolist(), w.tolist(), strict=True)) for i, w in sets)
    want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
    assert near_dedup.probability_jaccard(*sets) == pytest.approx(want)
    owner = np.repeat([0, 1], 120)
    held = near_dedup.signatures(owner, np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), 2, 4096)
    assert (held[0] == held[1]).mean() == pytest.approx(want, abs=4 * (want * (1 - want) / 4096) ** 0.5)
