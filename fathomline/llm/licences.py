"""Licence scans: sparse TF-IDF cosine of texts, header blocks and lines to templates, then inheritance from the nearest ancestor.

DataFrame operations only.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.session import saved

# Short statements by which texts declare a licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license. Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
#: Whole licences, a file for each.
TEXTS = Path(__file__).parent / "licence_texts"
#: The licences that SPDX identifiers name; those of the GNU licences can say which versions follow.
SPDX = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0"]
SALTS = 16
#: An SPDX identifier is one term with its tag, so an unknown one is like no other.
TAG = r"spdx-license-identifier:\s*\(*"
TERM = r"spdx:[a-z0-9]+(?:[.+-]+[a-z0-9]+)*\+?|[a-z0-9]+(?:\.[a-z0-9]+)*"
#: Between blocks are lines without a letter or digit, comment marks or not.
GAP = r"\n[^\p{L}\p{N}]*\n"
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)([._-].*)?$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), TAG, "spdx:"), F.lit(TERM), F.lit(0))


def units(text: Column) -> Column:
    """What of a text is held to templates: the whole, and its blocks, sentences, lines and SPDX identifiers, each once."""
    blocks = F.split(text, GAP)
    joined = F.transform(blocks, lambda x: F.regexp_replace(x, r"\n[^\p{L}\p{N}\n]*", " "))
    sentences = F.flatten(F.transform(joined, lambda x: F.split(x, r"(?<=[.!?])\s+")))
    lines = F.flatten(F.transform(blocks, lambda x: F.split(x, "\n")))
    tags = F.regexp_extract_all(text, F.lit("(?i)" + TAG + "[a-z0-9]+(?:[.+-]+[a-z0-9]+)*\\+?"), F.lit(0))
    return F.array_distinct(F.concat(F.array(text), blocks, sentences, lines, tags))


def statements() -> list[tuple[str, str]]:
    """Licences and what declares them: short statements, SPDX identifiers and whole licences."""
    tags = [(name, f"SPDX-License-Identifier: {name}{end}") for name in SPDX for end in (["", "-only", "-or-later", "+"] if "GPL" in name else [""])]
    return TEMPLATES + tags + [(p.stem, p.read_text()) for p in sorted(TEXTS.glob("*.txt"))]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(statements())], "template int, licence string, statement string")


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("string").cast("binary"), 256))


def telling(goal: DataFrame, least: float) -> DataFrame:
    """``(template, rest, tell)``: the terms by which a template is found with their shares of its squared length, and the share of the others.

    The others are a template's most frequent terms in the corpus, as many as hold half of ``least`` squared.
    """
    share = goal.select("template", "term", "n", (F.col("w") * F.col("w") / (F.col("length") * F.col("length"))).alias("share"))
    often = Window.partitionBy("template").orderBy(F.desc("n"), "term").rowsBetween(Window.unboundedPreceding, 0)
    light = F.sum("share").over(often) <= least * least / 2
    tell = F.collect_list(F.when(~F.col("light"), F.struct("term", "share"))).alias("tell")
    return share.withColumn("light", light).groupBy("template").agg(F.sum(F.when(F.col("light"), F.col("share")).otherwise(0.0)).alias("rest"), tell)


def hopeful(tell: DataFrame, least: float) -> Callable[[Column], Column]:
    """A condition on a text or unit: it may reach a cosine of ``least``; few others fulfil it.

    By Cauchy and Schwarz a cosine is at most the root of the share of a template's squared length in the terms that
    the text holds, and a text holds at most ``rest`` of it in terms that don't tell.  The terms of the templates are
    a fixed few, so they are literals of the plan and each row is judged where it is, without a shuffle.
    """
    found = tell.collect()
    shares: dict[str, list[dict]] = {}
    for k, row in enumerate(found):
        for term, share in row.tell:
            shares.setdefault(term, []).append({"k": k, "share": share})
    if not shares:
        return lambda text: F.lit(False)
    of_term = F.from_json(F.lit(json.dumps(shares)), "map<string, array<struct<k: int, share: double>>>")
    rest = F.array(*[F.lit(float(row.rest)) for row in found])
    goal = (least - 1e-5) ** 2

    def added(sums: Column, one: Column) -> Column:
        return F.transform(sums, lambda x, k: F.when(k == one["k"], x + one["share"]).otherwise(x))

    def condition(text: Column) -> Column:
        telling = F.filter(F.array_distinct(terms(text)), lambda x: x.isin(list(shares)))
        held = F.flatten(F.transform(telling, lambda x: F.element_at(of_term, x)))
        return F.exists(F.aggregate(held, rest, added), lambda x: x >= goal)

    return condition


def scored(files: DataFrame, known: DataFrame, text_col: str = "text", least: float = 0.6) -> DataFrame:
    """``(digest, own_licence, own_score)``: of distinct texts those with a unit whose cosine to a template is ``least`` or more.

    A unit is the whole text, or a block, sentence, line or SPDX identifier of it, see ``units``.  Its vector has term
    counts times ln((files + 1) / (files with the term + 1)) + 1.  Counts cover every term of the units and templates
    over the whole texts of all files, so a unit is judged alike in a small and in a large corpus of the same kind.  The best unit
    and template of a text count, equal ones by the first licence by name; null texts have no units.  Texts and then units
    that a bound on the cosine rules out are left aside, which loses none, see ``hopeful``; a unit's terms are all among its
    text's, but for SPDX identifiers that a line ends before, so texts with such a tag stay.  The templates are a fixed few, so their
    vectors are broadcast; units meet the counts by term and salt, as a third of all units may hold one term.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    word = known.select("template", "licence", F.explode(terms(F.col("statement"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    rows = files.select(F.col(text_col).cast("string").alias("text"))
    total = rows.count()
    weight = lambda n: F.log((F.lit(total) + 1) / (n + 1)) + 1
    n = F.coalesce("n", F.lit(0))
    seen = rows.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    held = seen.join(F.broadcast(word.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    goal = word.join(held, "term", "left").select("template", "licence", "term", n.alias("n"), (F.col("tf") * weight(n)).alias("w"))
    goal = saved(goal.join(goal.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length")), "template"))
    may = hopeful(telling(goal, least), least)
    likely = rows.where(F.col("text").rlike("(?i)" + TAG) | may(F.col("text")))
    likely = likely.groupBy(text_key(F.col("text")).alias("id")).agg(F.first("text").alias("text"))  # each text once
    unit = likely.select("id", F.posexplode(units(F.col("text"))).alias("unit", "said")).where(may(F.col("said")))
    unit = unit.select("id", F.struct(F.xxhash64("said"), "unit", F.crc32(F.col("said").cast("binary"))).alias("unit"), F.explode(terms(F.col("said"))).alias("term"))
    unit = saved(unit.groupBy("id", "unit", "term").agg(F.count("*").alias("tf")))
    wanted = unit.select("term").distinct()
    idf = wanted.join(seen.groupBy("term").agg(F.count("*").alias("n")).join(wanted, "term", "left_semi"), "term", "left").select("term", weight(n).alias("idf"))
    dealt = saved(idf).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    unit = unit.withColumn("salt", F.pmod(F.xxhash64("id", "unit"), F.lit(SALTS)).cast("int")).join(dealt, ["term", "salt"])
    unit = unit.select("id", "unit", "term", (F.col("tf") * F.col("idf")).alias("v"))
    length = unit.groupBy("id", "unit").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("own"), F.collect_list(F.struct("term", "v")).alias("has"))
    near = length.select("id", "unit", "own", F.explode("has").alias("x")).select("id", "unit", "own", "x.term", "x.v").join(F.broadcast(goal), "term")
    score = near.groupBy("id", "unit", "template", "licence").agg(F.round(F.sum(F.col("v") * F.col("w")) / (F.first("own") * F.first("length")), 6).alias("score"))
    best = score.where(F.col("score") >= least).groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select(F.col("id").alias("digest"), F.col("b.licence").alias("own_licence"), (-F.col("b.s")).alias("own_score"))


def scanned(files: DataFrame, known: DataFrame, id_col: str = "id", text_col: str = "text", least: float = 0.6) -> DataFrame:
    """``(id, own_licence, own_score)`` for each row of ``files`` whose text has a licence, see ``scored``."""
    rows = files.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("digest"))
    return rows.join(scored(files, known, text_col, least), "digest").drop("digest")


def licensed(files: DataFrame, known: DataFrame, id_col: str = "id", path_col: str = "path", text_col: str = "text", least: float = 0.6) -> DataFrame:
    """``(id, path, own_licence, own_score, licence, licence_dir)`` for each row of ``files``.

    A file's licence is its own or else that of the nearest directory above it with a licence file
    (LICENSE, COPYING or NOTICE, perhaps with an ending) in which one was found: there the best score counts,
    equal ones by the first path.  ``licence_dir`` is that directory, null for a licence of the file's own or
    none.  Directories, not files, are joined with their ancestors, so a root above all files costs a row for
    each directory.  Null paths inherit nothing and name no directory; rows are judged by their own text and path,
    so ids may be null or repeat; other columns are not read.
    """
    own = saved(scored(files, known, text_col, least))
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), text_key(F.col(text_col)).alias("digest"))
    rows = rows.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")).withColumn("name", F.regexp_extract("path", "[^/]*$", 0))
    rows = rows.join(own, "digest", "left").drop("digest")  # a left join, of which hot digests can be split
    held = rows.where(F.col("own_licence").isNotNull() & F.col("name").rlike(LICENCE_FILE))
    held = held.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_licence")).alias("b")).select(F.col("dir").alias("up"), F.col("b.own_licence").alias("given"))
    part = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(part)), lambda k: F.array_join(F.slice(part, 1, k), "/"))
    dirs = rows.where("dir is not null").select("dir").distinct().select("dir", F.posexplode(F.array_distinct(above)).alias("depth", "up"))
    nearest = dirs.join(held, "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "given")).alias("b")).select("dir", F.col("b.up").alias("up"), F.col("b.given").alias("given"))
    found = rows.join(nearest, "dir", "left")
    lent = F.col("own_licence").isNull()
    return found.select("id", "path", "own_licence", "own_score", F.coalesce("own_licence", "given").alias("licence"), F.when(lent, F.col("up")).alias("licence_dir"))
