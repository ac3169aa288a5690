"""License scans: TF-IDF cosine of licence statements to templates, then inheritance from the nearest directory.

All in DataFrame functions.  Only texts with a marker word are taken apart; their statements (lines and
paragraphs with a marker, and whole licence files) become sparse vectors.  Terms are weighted by their rarity among
the templates, and terms that no template has lengthen a statement's vector, so prose around a notice counts against it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from glyphgate.llm.work import Folder
from glyphgate.operators.joins import lookup_join

#: fixed values: short notices by which licences are named or granted
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright to this work. CC0 1.0 Universal public domain dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
MARKER = "(?i)licen[cs]|copyright|public domain|all rights reserved|permission is hereby granted"
LICENSE_FILE = "(?i)(^|/)(licen[cs]e|copying|copyright|notice|unlicense)([-._][^/]*)?$"
TERM = "[a-z0-9]+"
MIN_COSINE = 0.6


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def _terms(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, ``term`` and how often the term occurs."""
    return (df.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))).alias("term"))
            .groupBy(*keys, "term").agg(F.count("*").alias("tf")))


def statements(files: DataFrame) -> DataFrame:
    """``id``, ``path``, ``statement``: lines and paragraphs with a marker, and whole licence files, each once."""
    marked = files.where(F.col("text").rlike(MARKER) | F.col("path").rlike(LICENSE_FILE))
    parts = F.concat(F.split("text", r"\r?\n"), F.split("text", r"\r?\n[ \t]*\r?\n"))
    kept = F.concat(F.filter(parts, lambda x: x.rlike(MARKER)), F.when(F.col("path").rlike(LICENSE_FILE), F.array("text")).otherwise(F.array()))
    return marked.select("id", "path", F.explode(F.array_distinct(F.transform(kept, F.trim))).alias("statement")).distinct()


def own_licenses(files: DataFrame, known: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``id``, ``path``, ``license``, ``cosine`` of each file with a statement near enough to a template.

    Ties go to the first licence by name.  ``known`` is a list of templates (``license``, ``text``), small by nature.
    """
    spark = files.sparkSession
    listed = known.where("license IS NOT NULL AND text IS NOT NULL").withColumn("t", F.xxhash64("license", "text"))
    n = listed.select("t").distinct().count()
    counted = _terms(listed.select("t", "license", "text").distinct(), ["t", "license"], "text")
    rarity = counted.groupBy("term").agg((F.log(F.lit(1 + n) / (1 + F.countDistinct("t"))) + 1).alias("idf"))
    weight = ((1 + F.log("tf")) * F.col("idf")).alias("w")
    vectors = counted.join(rarity, "term").select("t", "license", "term", weight)
    norms = vectors.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vectors = vectors.join(norms, "t").select("t", "license", "term", (F.col("w") / F.col("norm")).alias("tw"))

    unseen = float(spark.range(1).select(F.log(F.lit(1 + n)) + 1).first()[0])
    # terms carry a hash of their statement, not its text
    stated = statements(files).withColumn("u", F.xxhash64("id", "path", "statement"))
    terms = _terms(stated, ["u"], "statement")
    # the templates' terms are few
    terms = terms.join(F.broadcast(rarity), "term", "left").select(
        "u", "term", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(unseen))).alias("w"))
    lengths = terms.groupBy("u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # a statement's terms times the few templates that have the term
    dots = (terms.join(F.broadcast(vectors), "term").groupBy("u", "t", "license")
            .agg(F.sum(F.col("w") * F.col("tw")).alias("dot")))
    found = lengths.join(dots, "u").select("u", "license", F.round(F.col("dot") / F.col("norm"), 4).alias("cosine"))
    best = found.where(F.col("cosine") >= min_cosine).join(stated.select("u", "id", "path"), "u").groupBy("id", "path", "license").agg(F.max("cosine").alias("cosine"))
    return best.groupBy("id", "path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b")).select(
        "id", "path", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def _parent(path: str):
    return F.regexp_replace(F.regexp_replace(path, "^/+", ""), "/?[^/]*$", "")


def scan(files: DataFrame, known: DataFrame | None = None, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``id``, ``path``, ``license``, ``origin``, ``cosine``, ``from_dir`` for each row of ``files`` (``id``, ``path``, ``text``).

    ``origin`` is ``own`` for a file with a statement of its own, ``inherited`` where a licence file lies in its
    directory or the nearest one above, else null, with no licence.  Of several licence files in one directory the
    one of highest cosine counts, then the first by name.  Null texts have no statement; a null path is no file's
    child; repeated rows stay repeated.
    """
    known = templates(files.sparkSession) if known is None else known
    files = files.select("id", "path", "text")
    folder = Folder(files.sparkSession)      # stored results are read back with their true sizes, which choose the joins
    own = folder.kept(own_licenses(files, known, min_cosine))
    dirs = folder.kept(own.where(F.col("path").rlike(LICENSE_FILE)).groupBy(_parent("path").alias("dir"))
            .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
            .select("dir", F.col("b.license").alias("dir_license"), (-F.col("b.c")).alias("dir_cosine")))
    mine = folder.kept(own.select(F.xxhash64("id", "path").alias("key"), "license", "cosine"))
    narrow = files.select("id", "path").withColumn("key", F.xxhash64("id", "path"))
    rows = folder.kept(lookup_join(narrow, mine, "key").drop("key"))
    # distinct directories, each with its ancestors
    held = rows.where("license IS NULL AND path IS NOT NULL").select(_parent("path").alias("leaf")).distinct()
    steps = F.split("leaf", "/")
    above = F.when(F.col("leaf") == "", F.array(F.lit(""))).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/")))
    near = folder.kept(lookup_join(held.select("leaf", F.explode(above).alias("dir")), dirs, "dir", "inner")
            .groupBy("leaf").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "dir_license", "dir_cosine")).alias("d"))
            .select("leaf", "d.dir", "d.dir_license", "d.dir_cosine"))
    joined = lookup_join(rows.withColumn("leaf", _parent("path")), near, "leaf")
    own_ = F.col("license").isNotNull()
    return joined.select(
        "id", "path", F.coalesce("license", "dir_license").alias("license"),
        F.when(own_, "own").when(F.col("dir_license").isNotNull(), "inherited").alias("origin"),
        F.when(own_, F.col("cosine")).otherwise(F.col("dir_cosine")).alias("cosine"),
        F.when(~own_, F.col("dir")).alias("from_dir"))
