"""Licence scans: TF-IDF cosines of headers and licence files to templates, then inheritance.

Every line of a text, and the whole text of a licence file, is compared with licence templates as sparse
TF-IDF vectors; with `windows`, so is every run of words as long as a template that lies in the text as the
template would around one of its prefix words, over line breaks and within long lines. Words of a template
that carry most of its weight form its prefix: what shares none of them cannot reach the threshold, so only
texts and lines with a prefix word are taken apart. Equal segments are scored once. A file without a match
inherits from the nearest directory above it that has a matching licence file. DataFrame operations only.

Licences contain one another's words, so among the templates within the threshold not the cosine decides but
cosine^2 times the length of the template's vector: a longer template wins where its further words are
there, a shorter one where they are not.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.sources.storage import stage

THRESHOLD = 0.7
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"

# Usual notices of common licences, licence files that are short, and the opening of those that are long.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
            "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 of the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
                     "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
                     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
                     "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
                     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
                     "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"),
    ("Proprietary", "All rights reserved."),
)
# What reserves rights says nothing beside a licence, so these count last, and only as a line of their own.
RESERVATIONS = ("Proprietary",)
TAG = r"spdx-license-identifier:[ \t]*([^\n]*)"
HOLDER = r"(?:copyright|\(c\)|©)[^\n]*?(?=all rights reserved)"


def tag_templates(templates: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """A template of one word for each spelling of a licence's name in a tag."""
    names = {name for name, _ in templates} - set(RESERVATIONS)
    spelt = {(name, name) for name in names}
    for name in names:
        later = name + "-or-later"
        if later in names:
            spelt |= {(name, name + "-only"), (later, name + "+")}
    return sorted((name, _tag_word(x)) for name, x in spelt)


def _tag_word(identifier: str) -> str:
    return "spdx" + re.sub("[^a-z0-9]", "", identifier.lower().replace("+", "plus"))


def template_words(text: str) -> Counter:
    return Counter(re.findall(WORD, text.lower()))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("(" + WORD + ")"), F.lit(1))


def document_frequencies(files: DataFrame, text: str, vocabulary: Sequence[str]) -> tuple[int, dict[str, int]]:
    """How many files there are and how many hold each word of the vocabulary."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    held = F.array_intersect(words_of(F.coalesce(F.col(text), F.lit(""))), known)
    rows = files.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    return counts.get("", 0), counts


def prefix_words(weights: dict[str, float], threshold: float) -> list[str]:
    """The fewest heavy words without which a vector of length 1 stays below the threshold."""
    prefix, rest = [], 1.0
    for word, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        if math.sqrt(max(rest, 0.0)) < threshold:
            break
        prefix.append(word)
        rest -= w * w
    return prefix


def scan_licences(
    files: DataFrame, path: str = "path", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
    windows: bool = False,
) -> DataFrame:
    """`files` with licence, licence_score, licence_line and licence_from.

    With `windows`, notices wrapped over lines or sharing a line with other text are found too, and
    licence_line is the line on which they start; without it only whole lines and licence files are compared.

    licence_from is `header` (a line of the file, numbered from 1), `licence file` (the whole text,
    without a line), `inherited` (the path of the directory is in licence_dir) or null. Of the templates with a
    cosine of at least `threshold`, the one with the most evidence (see above) wins; ties go to the licence that is
    first by name, then to the earlier line. An SPDX tag counts as a segment of its own for each licence in it, and
    matches by the whole name. A reservation of rights counts only as a line (a copyright holder may stand before
    it) of a file without any other match. A word in no template weighs as one that no file holds. Null and empty texts match nothing; a null path inherits
    nothing; rows that repeat a path are scanned alike and share one directory. Columns named like a
    result column are replaced; an empty table gives an empty result.
    """
    result = ("licence", "licence_score", "licence_line", "licence_from", "licence_dir")
    kept = files.select(*[c for c in files.columns if c not in result])
    tags = tag_templates(templates)
    counts = [(name, template_words(t)) for name, t in (*templates, *tags)]
    vocabulary = sorted({w for _, c in counts for w in c})
    total, df = document_frequencies(files, text, vocabulary)
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) for w in vocabulary}
    unknown = math.log(1 + total)
    postings, gate, anchors = [], set(), {}
    for i, (name, c) in enumerate(counts):
        length = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        if length:
            weights = {w: n * idf[w] / length for w, n in c.items()}
            reserve = name in RESERVATIONS
            postings += [(w, i, name, x, 0.0 if reserve else length) for w, x in weights.items() if x]
            if i >= len(templates):
                continue
            prefix = set(prefix_words(weights, threshold))
            gate |= prefix
            order = re.findall(WORD, templates[i][1].lower())
            for w in prefix:
                if windows and not reserve:
                    anchors.setdefault(w, set()).add((order.index(w), len(order)))
    rows = kept.withColumn("_file", F.xxhash64(F.col(path), F.col(text)))
    matches = stage(_matches(rows, path, text, postings, gate, anchors, idf, unknown, threshold), "licence_matches")
    own = rows.join(matches, "_file", "left")
    folder = F.regexp_extract(F.col(path), r"^(.*)/[^/]*$", 1)
    own = own.withColumn("_dir", F.when(F.col(path).isNotNull(), folder))
    narrow = stage(own.select("_dir", F.col(path).alias("_path"), F.col("best").alias("_best")), "licence_files")
    is_licence = F.regexp_extract("_path", r"([^/]*)$", 1).rlike(LICENCE_FILE)
    granted = stage(narrow.where(is_licence & F.col("_best").isNotNull()).groupBy("_dir").agg(F.max("_best").alias("grant")), "licence_dirs")
    dirs = stage(narrow.where("_dir is not null").select("_dir").distinct(), "dirs")
    depth = F.size(F.split("_dir", "/"))
    above = dirs.withColumn("depth", F.explode(F.sequence(F.lit(0), depth))).withColumn(
        "up", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("substring_index(_dir, '/', depth)"))
    ).distinct()
    near = above.join(granted.select(F.col("_dir").alias("up"), "grant"), "up")
    nearest = stage(near.groupBy("_dir").agg(F.max(F.struct("depth", "up", "grant")).alias("n")), "nearest")
    found = own.join(nearest, "_dir", "left")
    mine, theirs = F.col("best"), F.col("n.grant")
    return found.select(
        *kept.columns,
        F.coalesce(mine["licence"], theirs["licence"]).alias("licence"),
        F.coalesce(mine["score"], theirs["score"]).alias("licence_score"),
        F.when(mine["line"] > 0, mine["line"]).alias("licence_line"),
        F.when(mine.isNotNull(), F.when(mine["line"] > 0, "header").otherwise("licence file")).when(theirs.isNotNull(), "inherited").alias("licence_from"),
        F.when(mine.isNull(), F.col("n.up")).alias("licence_dir"),
    )


def _windows(anchors: dict[str, set[tuple[int, int]]]) -> Column:
    """From `_words`, the words of every line: all runs of words that have an anchor word where a template
    of that size has it. Runs that would begin before the text or end after it are cut there."""
    places = F.create_map(
        *[x for w, to in sorted(anchors.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(at).alias("at"), F.lit(n).alias("size")) for at, n in sorted(to)]))]
    )
    lines = F.transform("_words", lambda words, i: F.transform(words, lambda w: F.struct(w.alias("word"), (i + 1).alias("line"))))

    def runs(tokens: Column) -> Column:
        hits = F.filter(
            F.transform(tokens, lambda t, i: F.when(t.word.isin(*sorted(anchors)), F.struct(i.alias("i"), t.word.alias("word")))), lambda h: h.isNotNull()
        )
        around = F.transform(hits, lambda h: F.transform(places[h.word], lambda p: F.struct(F.greatest(h.i - p["at"], F.lit(0)).alias("first"), p["size"].alias("size"))))
        return F.transform(
            F.array_distinct(F.flatten(around)),
            lambda r: F.struct(tokens[r["first"]]["line"].alias("line"), F.transform(F.slice(tokens, r["first"] + 1, r["size"]), lambda t: t.word).alias("words")),
        )

    # a list of one, so that the tokens are made once
    return F.flatten(F.transform(F.array(F.flatten(lines)), runs))


def _segments(rows: DataFrame, path: str, text: str, gate: set, anchors: dict) -> DataFrame:
    """_file, line and words of all segments with a prefix word, and of all tags; each text is read once."""
    known = F.array(*[F.lit(w) for w in sorted(gate)]) if gate else F.array().cast("array<string>")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    tagged = F.col("_low").contains("spdx-license-identifier:")
    texts = rows.select("_file", F.col(path).alias("_path"), low.alias("_low")).where(F.arrays_overlap(words_of(F.col("_low")), known) | tagged)
    is_licence = F.coalesce(F.regexp_extract("_path", r"([^/]*)$", 1).rlike(LICENCE_FILE), F.lit(False))
    parts = texts.select("_file", is_licence.alias("_whole"), F.split("_low", "\n").alias("_lines"))
    parts = parts.withColumn("_words", F.transform("_lines", words_of))

    def segment(line: Column, words: Column) -> Column:
        return F.struct(line.alias("line"), words.alias("words"))

    def held(line: Column, i: Column) -> Column:
        reserved = line.contains("all rights reserved") & line.rlike(HOLDER)
        return F.when(reserved, segment(i + 1, words_of(F.regexp_replace(line, HOLDER, ""))))

    def tags(line: Column, i: Column) -> Column:
        # a tag names licences between words of its expression and marks of the comment that it stands in
        named = F.filter(F.split(F.regexp_extract(line, TAG, 1), r"[^a-z0-9.+-]+"), lambda x: ~x.isin("", "or", "and", "with", "-", "--"))
        word = lambda x: F.concat(F.lit("spdx"), F.regexp_replace(F.replace(x, F.lit("+"), F.lit("plus")), "[^a-z0-9]", ""))
        return F.when(line.contains("spdx-license-identifier:"), F.transform(named, lambda x: segment(i + 1, F.array(word(x)))))

    none = F.array().cast("array<struct<line:int,words:array<string>>>")
    plain = [
        F.transform("_words", lambda words, i: segment(i + 1, words)),
        F.filter(F.transform("_lines", held), lambda x: x.isNotNull()),
        F.when(F.col("_whole"), F.array(segment(F.lit(0), F.flatten("_words")))).otherwise(none),
    ]
    with_prefix = F.filter(F.concat(*plain), lambda x: F.arrays_overlap(x.words, known))
    of_tags = F.flatten(F.filter(F.transform("_lines", tags), lambda x: x.isNotNull()))
    found = F.concat(with_prefix, of_tags, *([_windows(anchors)] if anchors else []))
    return parts.select("_file", F.explode(found).alias("s")).select("_file", "s.line", F.array_join("s.words", " ").alias("words"))


def _matches(rows: DataFrame, path: str, text: str, postings: list, gate: set, anchors: dict, idf: dict, unknown: float, threshold: float) -> DataFrame:
    """_file and best (evidence, score, licence, line) for files with a match. Equal rows share a _file."""
    spark = rows.sparkSession
    weights = spark.createDataFrame(postings or [("", -1, "", 0.0, 0.0)], "word string, template int, licence string, weight double, size double")
    words = spark.createDataFrame(list(idf.items()), "word string, idf double")
    # two hashes of 64 bits stand for the words of a segment
    segments = stage(
        _segments(rows, path, text, gate, anchors).withColumns({"k1": F.xxhash64("words"), "k2": F.xxhash64(F.lit(1), F.col("words"))}), "licence_segments"
    )
    key = ("k1", "k2")
    terms = (
        segments.dropDuplicates(list(key)).select(*key, F.explode(F.split("words", " ")).alias("word"))
        .groupBy(*key, "word").agg(F.count("*").alias("tf")).join(F.broadcast(words), "word", "left")
        .withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    )
    lists = weights.groupBy("word").agg(F.collect_list(F.struct("template", "licence", "weight", "size")).alias("to"))
    nowhere = F.array().cast("array<struct<template:int,licence:string,weight:double,size:double>>")
    # one row per segment and template; template -1 carries the length of the segment
    spread = terms.join(F.broadcast(lists), "word", "left").select(
        *key,
        F.explode(
            F.concat(
                F.transform(F.coalesce("to", nowhere), lambda t: F.struct(t.template.alias("template"), t.licence.alias("licence"), t["size"].alias("size"), (t.weight * F.col("x")).alias("v"))),
                F.array(F.struct(F.lit(-1).alias("template"), F.lit("").alias("licence"), F.lit(0.0).alias("size"), (F.col("x") * F.col("x")).alias("v"))),
            )
        ).alias("e"),
    )
    sums = spread.groupBy(*key, "e.template", "e.licence", "e.size").agg(F.sum("e.v").alias("v")).where("v > 0")
    per_part = sums.groupBy(*key).agg(
        F.sqrt(F.max(F.when(F.col("template") < 0, F.col("v")))).alias("length"),
        F.collect_list(F.when(F.col("template") >= 0, F.struct("v", "licence", "size"))).alias("all"),
    )
    # rounded, so that the order of summing decides no tie
    cosine = F.transform("all", lambda t: F.struct(F.round(t.v / F.col("length"), 9).alias("score"), t.licence.alias("licence"), t["size"].alias("size")))
    close = F.transform(
        F.filter(cosine, lambda t: t.score >= threshold),
        lambda t: F.struct((-F.round(t.score * t.score * t["size"], 9)).alias("evidence"), t.licence.alias("licence"), (-t.score).alias("score")),
    )
    scored = per_part.select(*key, F.array_min(close).alias("m")).where("m is not null")
    # one notice may stand in a third of all files: its segments spread over the salts
    salts = 16
    salted = scored.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = segments.select("_file", "line", *key, F.pmod("_file", F.lit(salts)).cast("int").alias("_salt")).join(salted, [*key, "_salt"])
    best = found.groupBy("_file").agg(F.min(F.struct("m.evidence", "m.licence", "line", "m.score")).alias("b"))
    return best.select(
        "_file",
        F.struct((-F.col("b.evidence")).alias("evidence"), (-F.col("b.score")).alias("score"), F.col("b.licence").alias("licence"), F.col("b.line").alias("line")).alias("best"),
    )
