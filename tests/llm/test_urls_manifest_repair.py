"""URL filter, Merkle manifest and conversation repair: edge cases and brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import merkle, turn_repair, url_filter

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def judged(spark, urls, listed=(), rules=RULES, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    known = spark.createDataFrame([(u,) for u in listed], "url string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, known, rules, **options).collect()}


def test_rules_hosts_and_paths(spark):
    cases = {
        "https://A.Example.ORG/en/12?x#y": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://x.org": ("x.org", "", None, "allow"),
        "http://x.org?a=/b": ("x.org", "", None, "allow"),
        "http://x.org#://y.com/de/": ("x.org", "", None, "allow"),
        "http://x.com/de/1": ("x.com", "/de/1", "com/de/", "block"),
        "http://x.com/DE/1": ("x.com", "/DE/1", None, "allow"),
        "no scheme.org/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://ÀB.com/fr/": ("Àb.com", "/fr/", "com/fr/", "allow"),
        "http://a\nb.org/\n?": ("a\nb.org", "/\n", "org/", "allow"),
    }
    got = judged(spark, list(cases))
    assert got == dict(enumerate(cases.values()))


def test_longest_rule_wins_and_longer_host_breaks_ties(spark):
    rules = [("allow", "b.io", "/x"), ("block", "io", "/x/y"), ("block", "io", ""), ("allow", "a.b.io", "")]
    got = judged(spark, ["http://b.io/x/y", "http://a.b.io/x/y", "http://io", "http://a.b.io/"], rules=rules)
    assert [v[2] for _, v in sorted(got.items())] == ["b.io/x", "a.b.io", "io", "a.b.io"]
    with pytest.raises(ValueError):
        judged(spark, ["x"], rules=[("maybe", "a", "/")])


def test_listed_urls_in_any_form_are_blocked_and_no_others(spark):
    listed = ["http://www.bad.net:80/a/?utm_source=z&b=2&a=1#f", None, "nothing", "https://bad.net/a"]
    pages = ["https://bad.net/a", "bad.net/a", "ftp://u@BAD.net/a/", "http://bad.net/a?b=2&a=1", "http://bad.net/a?a=2", "http://bad.net/A", None, "https://x" * 50_000]
    got = judged(spark, pages, listed)
    assert [got[i][3] for i in range(len(pages))] == ["block", "allow", "block", "block", "allow", "allow", "allow", "allow"]
    assert {v[3] for v in judged(spark, pages, []).values()} == {"allow"}
    assert judged(spark, [], listed) == {}


def test_a_full_filter_and_a_hot_url_change_nothing(spark):
    draw = random.Random(5)
    urls = [f"http://h{draw.randrange(900)}.net/{draw.randrange(3)}" for _ in range(3000)] + ["http://hot.net/"] * 1500
    listed = [f"http://h{i}.net/1" for i in range(0, 900, 2)] + ["http://hot.net"]
    bad = {u.rstrip("/") for u in listed}
    want = {i: "block" if u.rstrip("/") in bad else "allow" for i, u in enumerate(urls)}
    for most in (1, 4, 1 << 18):  # one block is full of ones: everything is a possible hit
        got = judged(spark, urls, listed, most_blocks=most)
        assert {i: v[3] for i, v in got.items()} == want


def test_the_filter_has_few_false_positives_and_no_false_negative(spark):
    keys = spark.range(4000).selectExpr("concat('k', id) as _key")
    blocks = url_filter.blocks_for(keys)
    assert blocks == 256
    filled = url_filter.build_filter(keys, "_key", blocks)
    rows = spark.range(40_000).selectExpr("id", "concat('k', id) as _key")
    hits = url_filter.possible_hits(rows, "_key", filled, blocks).where("_possible")
    assert hits.where("id < 4000").count() == 4000
    assert hits.where("id >= 4000").count() < 36_000 * 0.01


def test_url_columns_of_the_input(spark):
    pages = spark.createDataFrame([(None, "http://a.org/", "old", 1), (None, "http://a.org/", "old", 1)], "page_id long, u string, verdict string, rule int")
    got = url_filter.judge_urls(pages, pages.limit(0), RULES, url="u", listed_url="u")
    assert sorted(got.columns) == ["host", "page_id", "path", "rule", "u", "verdict"]
    assert [r.verdict for r in got.collect()] == ["allow", "allow"]
    assert got.where(F.col("rule") == "org/").count() == 2


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """The root, and for each node the siblings left and right of its path, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k - k % 8
            paths[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + 8])))
            at[i] = k // 8
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain_manifest(rows, lower):
    """rows: doc_id, source, lang, n_chars, text -> leaf, subroot, root, proof, folded root, by sorted rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]])
    root, upper = plain_tree([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, upper, strict=True):
        for r, own in zip(groups[g], trees[g][1], strict=True):
            digest, path = plain_leaf(lower(r)), own + above
            for left, right in path:
                digest = h(left + digest + right)
            out.append((r[0], r[2], plain_leaf(r), trees[g][0], root, h("".join(a + b for a, b in path)), digest, digest == root))
    return out


@pytest.mark.parametrize("shape", [{}, {None: 1}, {"a": 8}, {"a": 1, None: 9, "b": 513, "é": 8, "Z": 65}, {f"l{i:03}": 1 + i % 2 for i in range(70)}])
def test_manifest_matches_a_plain_tree(spark, shape):
    draw = random.Random(7)
    rows = [(draw.randrange(10**6), draw.choice(["s", None, ""]), g, draw.choice([None, 5, -12]), draw.choice([None, "", "Ab", "ab", "ÄÖ Z", "x" * 9])) for g, n in shape.items() for _ in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit(1))
    made = merkle.manifest(docs.repartition(7), changed={"text": F.translate("text", url_filter.UPPER, url_filter.LOWER)}, where=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)

    def lower(r):
        return r if zlib.crc32(str(r[0]).encode()) % 3 or r[4] is None else (*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4]))

    got = made.select("doc_id", "lang", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    want = plain_manifest(rows, lower) if rows else []
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))


def test_manifest_rows_that_repeat_and_null_ids(spark):
    big = 2**60 + 1
    rows = [(big, None, "a", 1, "T")] * 3 + [(big, None, "a", 1, "U"), (None, "s", "a", None, None), (None, "s", "a", None, "X" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    made = merkle.manifest(docs, changed={"text": F.lower("text")}, where=F.col("doc_id").isNotNull() | F.lit(None), paths=True).collect()
    want = plain_manifest(rows, lambda r: r if r[0] is None else (*r[:4], r[4].lower()))
    assert sorted(str((r.doc_id, r.lang, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)) for r in made) == sorted(map(str, want))
    for r in made:  # a version copies its ancestors only, and an untouched row none
        assert (r.copied is None) == (r.doc_id is None)
        assert r.copied is None or (len(r.copied) == 2 and r.copied[-1] == r.folded_root)


def test_versions_share_untouched_nodes():
    nodes = [h(str(i)) for i in range(100)]
    levels = merkle.levels_above(nodes, 100)
    assert [len(x) for x in levels] == [100, 13, 2, 1]
    for at in (0, 57, 99):
        lefts, rights = merkle.siblings(levels, at)
        assert merkle.copied_path(nodes[at], lefts, rights)[-1] == levels[-1][0]
        changed = [*nodes[:at], h("new"), *nodes[at + 1 :]]
        assert merkle.copied_path(h("new"), lefts, rights) == [x[at // 8 ** (i + 1)] for i, x in enumerate(merkle.levels_above(changed, 100)[1:])]
    with pytest.raises(ValueError):
        merkle.manifest(None, order="root")


def every_way(codes, most_inserts=3):
    """The least (cost, audit, turns) by trying all edits of a short conversation."""
    best = []

    def go(i, last, inserts, cost, audit, turns):
        if i == len(codes) and last in ("", "a"):
            best.append((cost, audit, turns))
        then = "a" if last == "u" else "u"
        if inserts < most_inserts:
            go(i, then, inserts + 1, cost + 5, audit + "I", [*turns, (then, None)])
        if i < len(codes):
            go(i + 1, last, inserts, cost + 2, audit + "D", turns)
            c = codes[i].lower()
            late = 5 if codes[i] != c else 0
            if c != "d":
                go(i + 1, then, inserts, cost + late + (c != then), audit + ("K" if c == then else "R"), [*turns, (then, i)])
                if c == "s" and not last:
                    go(i + 1, "s", inserts, cost + late, audit + "K", [*turns, ("s", i)])

    go(0, "", 0, 0, "", [])
    return min(best, key=lambda x: x[:2])


def by_tables(codes):
    """The least (cost, audit), place by place and state by state."""
    v = {"": (0, "")}
    for c in [*codes, None]:
        for _ in range(3):
            for s, (cost, audit) in list(v.items()):
                then = "a" if s == "u" else "u"
                v[then] = min(v.get(then, (10**9, "")), (cost + 5, audit + "I"))
        if c is None:
            return min(v[s] for s in ("", "a") if s in v)
        after = {}
        for s, (cost, audit) in v.items():
            then, low = "a" if s == "u" else "u", c.lower()
            late = 5 if c != low else 0
            ways = [(s, cost + 2, "D")]
            if low != "d":
                ways.append((then, cost + late + (low != then), "K" if low == then else "R"))
                if low == "s" and not s:
                    ways.append(("s", cost + late, "K"))
            for to, spent, edit in ways:
                after[to] = min(after.get(to, (10**9, "")), (spent, audit + edit))
        v = after


def test_search_finds_what_trying_everything_finds():
    draw = random.Random(3)
    for _ in range(400):
        codes = "".join(draw.choice("suaxSUAXd") for _ in range(draw.randrange(7)))
        cost, audit, turns = every_way(codes)
        assert turn_repair.search(codes, turn_repair.START, turn_repair.ENDS) == (cost, audit)
        made = turn_repair.turns_of(codes, turn_repair.START, audit)
        assert [(m["row"], (m["role"] or codes[m["row"]].lower())[0]) for m in made] == [(row, role) for role, row in turns]


@pytest.mark.parametrize("letters", ["u", "a", "ua", "uuuaU", "suaxSUAXd", "UA", "d", "xa", "uaUd"])
def test_long_conversations_in_segments(letters):
    draw = random.Random(11)
    for n in (64, 65, 200, 333):
        codes = "".join(draw.choice(letters) for _ in range(n))
        want = by_tables(codes)
        parts = [turn_repair.solutions(codes[i : i + 64], False) for i in range(0, n, 64)]
        cost, chain = turn_repair.cheapest_chain(parts)
        assert (cost, "".join(x["audit"] for x in chain)) == want
        if n == 64:
            assert turn_repair.search(codes, turn_repair.START, turn_repair.ENDS) == want


def code_of(role, text, seen):
    stripped = text.strip(turn_repair.BLANKS)
    fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None
    seen.add((role, text))
    initial = role[:1] if role[:1] in tuple("sua") else "x"
    return fault, "d" if fault in ("blank", "duplicate") else initial.upper() if fault else initial


def test_repair_of_whole_tables(spark):
    draw = random.Random(17)
    said = ["Hi.", "Hi", " \t", "", None, "No?\n", "Wait! ", "e" * 40_000 + ".", "…", " "]
    rows = []
    for conv, n in [(None, 5), (1, 1), (2, 0), (3, 300), *[(c, draw.randrange(1, 9)) for c in range(10, 60)]]:
        rows += [(conv, draw.choice([None, draw.randrange(9), t]), draw.choice(["user", "assistant", "system", None, "", "tool", "ufo"]), draw.choice([*said, f"Line {draw.randrange(90)}."]), 1) for t in range(n)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit int").repartition(5)
    summary, repaired = turn_repair.repair(frame)
    got = {r.conv_id: r for r in summary.collect()}
    turns = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.seg, r.idx)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    convs = {}
    for c, t, role, text, _ in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    assert set(got) == set(convs)
    for c, own in convs.items():
        own.sort()
        seen, faults, codes = set(), [], ""
        for _, _, role, _, text in own:
            fault, code = code_of(role, text, seen)
            faults.append(fault)
            codes += code
        numbers = [t for there, t, *_ in own if there]
        r = got[c]
        assert r.gaps == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults.count(x) for x in ("blank", "duplicate", "truncated"))
        assert r.illegal == sum((x[2][:1] + y[2][:1]) not in ("su", "ua", "au") for x, y in zip(own, own[1:], strict=False))
        assert (r.cost, r.audit) == by_tables(codes)
        want = []
        for m in turn_repair.turns_of(codes, turn_repair.START, r.audit):
            want.append((m["role"] or own[m["row"]][2], "" if m["row"] is None else own[m["row"]][4]))
        assert turns.get(c, []) == want


def test_repair_of_an_empty_table(spark):
    summary, repaired = turn_repair.repair(spark.createDataFrame([], "conv_id string, turn int, role string, text string"))
    assert summary.count() == repaired.count() == 0
    assert summary.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
