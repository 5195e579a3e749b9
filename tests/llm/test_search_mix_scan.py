"""Neighbour search, mixing, licence scans and the pipeline."""

import math
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from shelfcast.llm import hashing_index, license_scan, mixing
from shelfcast.llm.queries import QUERIES, byte_vocabulary

FOLDER = "/root/testdata/sf0.01"


def test_search_recall_against_brute_force(spark):
    found = defaultdict(list)
    for r in sorted(QUERIES["op1_multi_index_hashing"](spark, FOLDER).collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        near = ids[np.lexsort((ids, -score))[:20]]
        mine = found[ids[q]]
        assert len(mine) == 20 and mine == sorted(mine, key=lambda m: (-m[1], m[0]))
        hits += len(set(near) & {m[0] for m in mine})
        total += 20
        assert all(abs(score[np.flatnonzero(ids == v)[0]] - s) < 1e-12 for v, s in mine)
    assert hits / total >= 0.9


def test_a_shard_retrieves_every_code_within_a_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (400, 8), dtype=np.uint8)
    codes[:200] = codes[0] ^ np.packbits(rng.random((200, 64)) < 0.1, axis=1)
    shard = hashing_index.Shard(codes)
    for radius in (0, 3, 5, 10, 20, 64):
        want = np.flatnonzero(hashing_index.distances(codes, codes[7]) <= radius)
        assert shard.within(codes[7], radius).tolist() == want.tolist()
    assert len(shard.nearest(codes[300], 0, 25)) >= 25 and len(shard.nearest(codes[300], 0, 1000)) == 400


def test_search_edge_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [5.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, [-1.0, 0.0]), (None, [1.0, 1.0]), (2, [5.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in hashing_index.nearest_neighbours(vectors, F.col("vec_id") < 3, k=20).collect()]
    want = []
    live = {0: (1, 0), 1: (1, 0), 2: (5, 1), 9: (-1, 0)}
    for q in (0, 1, 2):
        order = sorted((-(a * live[q][0] + b * live[q][1]), i) for i, (a, b) in live.items() if i != q)
        want += [(q, k, i, -s) for k, (s, i) in enumerate(order, 1)]
    assert sorted(got) == want
    assert hashing_index.nearest_neighbours(vectors.limit(0), F.col("vec_id") < 3).count() == 0
    copies = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(0.6), F.lit(0.8)).alias("embedding"))
    near = hashing_index.nearest_neighbours(copies, F.col("vec_id") == 150, k=5, shard_rows=64).collect()
    assert [r.vec_id for r in sorted(near, key=lambda r: r["rank"])] == [0, 1, 2, 3, 4]


def _mixed(spark, **options):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").when(F.col("doc_id") % 41 == 0, None).otherwise(F.col("source")))
    rows = mixing.mix_sources(docs, block_tokens=2000, **options).withColumn("tokens", mixing.token_count(F.col("text"))).toPandas()
    owned = docs.withColumn("tokens", mixing.token_count(F.col("text"))).toPandas()
    return rows.fillna({"source": "-"}), owned.fillna({"source": "-"})


@pytest.mark.parametrize("options", [{"repetition_limit": 2.0}, {"target_entropy": 0.93}, {"target_entropy": 0.7}, {"target_entropy": 0.97, "repetition_limit": 3.0, "budget": 200_000.0}])
def test_mix_meets_its_quotas(spark, options):
    rows, owned = _mixed(spark, **options)
    have, got = owned.groupby("source").tokens.sum(), rows.groupby("source").tokens.sum()
    p = have / have.sum()

    def at(a):
        w = p**a / (p**a).sum()
        budget = options.get("budget", (have / w).max())
        return w, budget, -(w * np.log(w)).sum() / math.log(len(w)), (w * budget / have).max()

    target, limit = options.get("target_entropy"), options.get("repetition_limit")
    grid = np.linspace(0, 8, 80_001)
    a = 0.0 if target is None else next(x for x in grid if at(x)[2] <= target)
    if limit is not None:
        way = np.linspace(a, 1.0, 20_001)
        a = next((x for x in way if at(x)[3] <= limit), 1.0)
    w, budget, *_ = at(a)
    longest = owned.groupby("source").tokens.max()
    for s in have.index:
        assert got.get(s, 0) <= w[s] * budget * 1.001 + 2 and got.get(s, 0) >= w[s] * budget * 0.999 - longest[s] - 2
    if "budget" not in options:
        assert set(rows.doc_id) == set(owned.doc_id)
    assert not rows.duplicated(["doc_id", "mix_pass"]).any() and rows.mix_position.between(0, 1).all()
    # whole blocks come in one stretch of a pass
    assert (rows.groupby(["source", "mix_pass", "mix_block"]).mix_position.nunique() == 1).all()


def test_mix_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, "x y", "a"), (3, "x y", "a"), (None, "z", "b"), (4, "w " * 90_000, "c")], "doc_id long, text string, source string").withColumn("mix_pass", F.lit("p"))
    rows = mixing.mix_sources(docs, repetition_limit=3.0).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, None} and max(r.mix_pass for r in rows) == 3
    assert len([r for r in rows if r.mix_pass == 1]) == 6
    assert mixing.mix_sources(docs.limit(0), repetition_limit=2.0).count() == 0
    assert mixing.mix_sources(docs).count() == 6  # nothing asked for: the proportional mix


def _scan(files, threshold=license_scan.THRESHOLD, templates=license_scan.TEMPLATES):
    """Every segment against every template, without a prefix filter."""
    word = re.compile(license_scan.WORD)
    vocabulary = {w for _, t in templates for w in word.findall(t.lower())}
    df = Counter(w for _, _, t in files for w in set(word.findall((t or "").lower())) & vocabulary)
    weight = lambda w: math.log((1 + len(files)) / (1 + df[w])) if w in vocabulary else math.log(1 + len(files))

    def vector(text):
        v = {w: n * weight(w) for w, n in Counter(word.findall(text.lower())).items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()} if length else {}

    against = [(name, vector(t)) for name, t in templates]
    own = {}
    for key, path, text in files:
        base = (path or "").rpartition("/")[2]
        parts = list(enumerate((text or "").split("\n"), 1)) + ([(0, text or "")] if re.match(license_scan.LICENCE_FILE.replace("(?i)", ""), base, re.I) else [])
        best = None
        for line, part in parts:
            v = vector(part)
            for name, t in against:
                cos = round(sum(x * t.get(w, 0.0) for w, x in v.items()), 9)
                if cos >= threshold and (best is None or (-cos, name, line) < best):
                    best = (-cos, name, line)
        own[key] = best
    granted = {}
    for key, path, _ in files:
        if path and own[key] and re.match(license_scan.LICENCE_FILE.replace("(?i)", ""), path.rpartition("/")[2], re.I):
            folder = path.rpartition("/")[0]
            granted[folder] = max(granted.get(folder, (0, "", 0)), (-own[key][0], own[key][1], own[key][2]))
    out = {}
    for key, path, _ in files:
        if own[key]:
            out[key] = (own[key][1], "header" if own[key][2] else "licence file", None)
        else:
            up = path.rpartition("/")[0] if path else None
            while up is not None and up not in granted:
                up = up.rpartition("/")[0] if up else None
            out[key] = (granted[up][1], "inherited", up) if up is not None else (None, None, None)
    return out


def test_licences_match_a_plain_scan(spark):
    mit, gpl, prose = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "the work of the day is free and ends in general rights"
    whole = "\n".join(t for n, t in license_scan.TEMPLATES if n == "MIT")
    files = [
        (1, "a/LICENSE", mit), (2, "a/b/c.py", prose), (3, "a/b/LICENSE.txt", f"{prose}\n{gpl}"), (4, "a/b/c/d.py", prose), (5, "a/x.py", f"{prose}\n// {gpl}"), (6, "z.py", prose),
        (7, None, prose), (8, "q/COPYING", None), (9, "q/r.py", ""), (10, "n/NOTICE", whole.replace("\n", " ")), (11, "n/m/o.py", prose), (12, "a/long.py", "filler " * 40_000 + mit), (13, None, mit), (14, "LICENSE", "All rights reserved."), (15, "top.py", None),
    ]
    files += [(100 + i, f"p/{i}.txt", f"{prose} {i}") for i in range(30)]
    table = spark.createDataFrame(files, "key int, path string, text string").withColumn("licence", F.lit("x"))
    got = {r.key: (r.licence, r.licence_from, r.licence_dir) for r in license_scan.scan_licences(table).collect()}
    assert got == _scan(files)
    assert got[4] == ("GPL-3.0", "inherited", "a/b") and got[2] == ("GPL-3.0", "inherited", "a/b") and got[6][1] == "inherited"
    assert license_scan.scan_licences(table.limit(0)).count() == 0


def test_licence_query_matches_a_plain_scan(spark):
    rows = QUERIES["op8_license_scan"](spark, FOLDER).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    want = _scan([(r.doc_id, r.path, text[r.doc_id]) for r in rows])
    assert {r.doc_id: (r.licence, r.licence_from, r.licence_dir) for r in rows} == want
    assert {"header", "inherited"} <= {r.licence_from for r in rows}


def test_wrapped_and_embedded_notices_are_found(spark, tmp_path):
    by = {}
    for name, t in license_scan.TEMPLATES:
        by.setdefault(name, []).append(t)

    def wrapped(text, width):
        return "\n".join(" * " + x for x in textwrap.wrap(text, width))

    want, files = {}, []
    for name in ("GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "BSD-3-Clause", "MIT", "ISC"):
        notice = max(by[name], key=len)
        for width in (30, 50, 70):
            files.append(("/* tool\n * by me\n" + wrapped(notice, width) + "\n */\nx = 1\n", name, 3))
        files.append(("one line before\nsome words " * 3 + notice + " and a great deal of other text" * 20, name, 4))
    files += [("plain prose without a notice, line %d" % i, None, None) for i in range(60)]
    rows, source = [], tmp_path / "documents.parquet"
    for i, (text, name, line) in enumerate(files):
        rows.append((10_001 + i + i // 40, text, "s"))  # no notice lands on a licence file
        want[10_001 + i + i // 40] = (name, line, "header" if name else None)
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(source))
    got = {r.doc_id: (r.licence, r.licence_line, r.licence_from) for r in QUERIES["op8_license_scan"](spark, str(tmp_path)).collect()}
    assert got == want


def _licence_text(name):
    return max((t for n, t in license_scan.TEMPLATES if n == name), key=len)


def _prose(n):
    """Files without a notice, in which words of notices occur now and then."""
    return [f"the work of day {i} and its source may be of use, as the {'license' if i % 9 == 0 else 'notice' if i % 7 == 0 else 'paper'} says" for i in range(n)]


def test_licences_that_contain_one_another_are_told_apart(spark):
    mit, bsd2, bsd3, isc, zero = (_licence_text(n) for n in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD"))
    as_is = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.'
    gpl3 = next(t for n, t in license_scan.TEMPLATES if n == "GPL-3.0" and "published" in t)
    texts = [
        (f"Copyright 2020 A\n\n{bsd2}\n\n{as_is}", "BSD-2-Clause"),
        (f"Copyright 2020 A\n\n{bsd3}\n\n{as_is}", "BSD-3-Clause"),
        (f"Copyright (C) 2020 by A <a@b.c>\n\n{zero}\n\n{as_is}", "0BSD"),
        (f"Copyright 2020 A\n\n{isc}\n\n{as_is}", "ISC"),
        (f"MIT License\n\nCopyright 2020 A\n\n{mit}\n\n{as_is}", "MIT"),
        ("Copyright 2020 The Authors. All rights reserved.\nLicensed under the Apache License 2.0, see LICENSE\nimport x", "Apache-2.0"),
        ("Copyright 2020 The Authors. All rights reserved. Use of this is governed. Licensed under the Apache License 2.0, see LICENSE", "Apache-2.0"),
        ("The agency said on Monday: All rights reserved. The paper then closed for the day.", None),
        ("Copyright (c) 2020 Foo Inc. All rights reserved.\nimport x", "Proprietary"),
        ("// SPDX-License-Identifier: BSD-2-Clause\nx", "BSD-2-Clause"),
        ("/* SPDX-License-Identifier: GPL-2.0+ */\nx", "GPL-2.0-or-later"),
        ("# SPDX-License-Identifier: GPL-2.0-only\nx", "GPL-2.0"),
        ("# SPDX-License-Identifier: (MIT OR Apache-2.0)\nx", "Apache-2.0"),
        ("# SPDX-License-Identifier: BSD-4-Clause\nx", None),
        ("This page is under Creative Commons Attribution-ShareAlike 4.0 International and free to share", "CC-BY-SA-4.0"),
        ("This page is under Creative Commons Attribution 4.0 International and free to share", "CC-BY-4.0"),
        ("This page is under Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "CC-BY-NC-SA-4.0"),
        ("                  Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n 1. Definitions.", "Apache-2.0"),
        ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\nEveryone is permitted", "AGPL-3.0"),
        ("/*\n * " + gpl3.replace("Foundation, ", "Foundation,\n * ") + "\n *\n * This program is distributed in the hope that it will be useful\n */", "GPL-3.0"),
    ]
    files = [(i, f"d{i}/f.txt", t) for i, (t, _) in enumerate(texts)]
    files += [(1000 + i, f"p/{i}.txt", t) for i, t in enumerate(_prose(300))]
    table = spark.createDataFrame(files, "key int, path string, text string")
    got = {r.key: r.licence for r in license_scan.scan_licences(table, windows=True).collect()}
    assert [got[i] for i in range(len(texts))] == [name for _, name in texts]
    assert all(got[1000 + i] is None for i in range(300))


def test_equal_notices_of_many_files_are_found_in_each(spark):
    notice = _licence_text("Apache-2.0")
    files = [(i, f"d{i}/a.txt", f"line of file {i}\n{notice}" if i % 3 == 0 else f"line of file {i}") for i in range(600)]
    got = license_scan.scan_licences(spark.createDataFrame(files, "key int, path string, text string"), windows=True).collect()
    assert {r.key: (r.licence, r.licence_line) for r in got} == {i: ("Apache-2.0", 2) if i % 3 == 0 else (None, None) for i in range(600)}


def test_mixing_query_meets_its_quotas(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source", mixing.token_count(F.col("text")).alias("tokens")).toPandas()
    docs["source"] = docs["source"].fillna("-")
    rows = QUERIES["op5_temperature_mixing"](spark, FOLDER).toPandas().drop(columns="source").merge(docs, on="doc_id")
    have, got = docs.groupby("source").tokens.sum(), rows.groupby("source").tokens.sum()
    p = have / have.sum()

    def at(a):
        w = p**a / (p**a).sum()
        budget = (have / w).max()
        return w, budget, -(w * np.log(w)).sum() / math.log(len(w)), (w * budget / have).max()

    a = next(x for x in np.linspace(0, 8, 80_001) if at(x)[2] <= 0.95)
    if at(a)[3] > 4.0:
        a = next((x for x in np.linspace(a, 1.0, 20_001) if at(x)[3] <= 4.0), 1.0)
    w, budget, *_ = at(a)
    longest = docs.groupby("source").tokens.max()
    for s in have.index:
        assert w[s] * budget * 0.999 - longest[s] - 2 <= got.get(s, 0) <= w[s] * budget * 1.001 + 2
    assert set(rows.doc_id) == set(docs.doc_id) and not rows.duplicated(["doc_id", "mix_pass"]).any()


def test_pipeline_stages_against_brute_force(spark):
    """Copies, near copies, a repeated id, null and empty texts, through all stages but the learned one."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 60)]
        near = [*words[:-1], "changed"]  # 55 of 57 shingles in common
        rows += [(10 * g, " ".join(words), "a"), (10 * g + 1, " ".join(near), "b"), (10 * g + 2, " ".join(words), "a")]
        rows.append((10 * g + 3, " ".join(words[:30] + [f"v{x}" for x in rng.integers(0, 5000, 30)]), "b"))
    rows += [(500, None, "a"), (501, "", "b"), (0, "an id that another text has", None), (502, "It's  caf\u00e9 \u4f60\u597d\n\n  12345", "b")]
    now = spark.createDataFrame([(i, t, s, "en", len(t or ""), "x") for i, t, s in rows], "doc_id long, text string, source string, lang string, n_chars long, extra string")
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))} if t.split() else set()
    columns = now.columns
    for name, apply in corpus_pipeline.STAGES[1:]:
        before = [(r.doc_id, r.text) for r in now.collect()]
        now = apply(spark, now, FOLDER).persist()
        after = now.collect()
        texts = Counter(r.text or "" for r in after)
        if name == "exact dedup":
            assert set(texts) == {t or "" for _, t in before} and max(texts.values()) == 1
        elif name == "MinHash near-dedup":
            left = [shingles(t) for t in texts]
            gone = [shingles(t or "") for _, t in before if (t or "") not in texts]
            like = lambda x, y: bool(x | y) and len(x & y) / len(x | y) >= 0.8
            assert len(gone) == 12 and all(any(like(x, y) for y in left) for x in gone)
            assert not any(like(x, y) for i, x in enumerate(left) for y in left[:i])
        elif name.startswith("mixing"):
            assert set(texts) == {t or "" for _, t in before} and max(texts.values()) <= 2
        else:
            known = tokenizers.Tokenizer.from_file(byte_vocabulary())
            assert len(after) == len(before)
            for r in after:
                ids = known.encode(r.text or "", add_special_tokens=False).ids
                assert bytes(r.token_ids) == np.array(ids, dtype="<u4").tobytes() and r.n_tokens == len(ids)
        if not name.startswith("BPE"):
            assert now.columns == columns


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    now = docs
    sizes = []
    for name, apply in corpus_pipeline.STAGES:
        before, now = now, apply(spark, now, FOLDER).persist()
        ids = [r.doc_id for r in now.select("doc_id").collect()]
        sizes.append(len(ids))
        if name == "quality classifier":
            assert now.columns == docs.columns and sum(labels.get(i) == 0 for i in ids) <= 2
            clean = [i for i, q in labels.items() if q == 1]
            assert len(set(clean) & set(ids)) >= 0.98 * len(clean)
        elif name == "exact dedup":
            texts = [r.text for r in now.select("text").collect()]
            assert len(texts) == len(set(texts)) == before.select("text").distinct().count()
        elif name == "MinHash near-dedup":
            assert 0 < len(ids) < before.count() and len(ids) == len(set(ids))
        elif name.startswith("mixing"):
            assert now.columns == docs.columns and set(ids) == {r.doc_id for r in before.collect()} and max(Counter(ids).values()) == 2
        else:
            assert {"token_ids", "n_tokens"} <= set(now.columns) and len(ids) == before.count()
    assert corpus_pipeline.run(spark, FOLDER).count() == sizes[-1]
    assert byte_vocabulary().endswith("byte_bpe_50k.json")
