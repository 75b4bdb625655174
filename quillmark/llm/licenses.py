"""License scans by DataFrame functions only.

Passages that speak of a licence are cut out of every text: its sentences with a trigger word, and of a licence file
the whole text.  Passages and licence templates become sparse TF-IDF vectors; term weights follow the document
frequencies over all passages and templates.  Only terms of the templates, a fixed list, meet the templates in a join
whose small side can't grow with the data; the others count in a passage's norm.  The template of greatest cosine, if
it reaches `least`, is the passage's licence; the best passage is the file's.

Files without one of their own inherit from the nearest directory above that has a licence file.  The directories are
reduced to distinct ones before they are joined to their ancestors, so a directory that holds a third of all files is
one row there; the last join has plain equality on the directory, which adaptive execution may split.

Null or empty text: no licence of its own; texts are read whole, however long.  A null path is no file of any directory: it inherits nothing.  Ties between
templates go to the name that sorts first, between licence files of a directory to the higher score, then that name.
Rows that repeat a path are rows of their own.  Other columns, whatever their names, aren't read.  An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import written

TRIGGER = r"(?i)(licen[sc]|copyright|public domain|all rights reserved|spdx)"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([.-][a-z0-9.-]*)?$"
LEAST = 0.5
#: Forms in which files name or give their licence; fixed values, several for a licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 public domain dedication."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction. The MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. The Unlicense."),
)


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits; points inside version numbers stay."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)*"), F.lit(0))


def parent(path: Column) -> Column:
    """The directory of a path, without a slash at its end; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def passages(files: DataFrame, whole: Column) -> DataFrame:
    """row, n, words of every passage of files (row, text): triggered sentences, or the whole text where `whole` holds."""
    text = F.col("text")
    sentences = F.filter(F.split(text, r"\n|(?<=[.!?])\s+"), lambda s: s.rlike(TRIGGER))
    found = files.filter(text.rlike(TRIGGER)).select("row", F.posexplode(F.concat(F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>")), sentences)).alias("n", "passage"))
    return found.select("row", "n", terms(F.col("passage")).alias("words")).filter(F.size("words") > 0)


def detect(files: DataFrame, whole: Column, least: float = LEAST) -> DataFrame:
    """row, license, score of the files (row, text) with a passage that resembles a template."""
    spark = files.sparkSession
    own = written(passages(files, whole), "passages")
    known = _templates(spark)
    vocabulary = known.select("term").distinct()
    n = own.count() + len(TEMPLATES)
    # Documents frequencies over all passages, kept for the templates' terms.
    seen = own.select(F.explode(F.array_distinct("words")).alias("term")).join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").count()
    with_templates = seen.unionByName(known.select("term", F.lit(1).cast("bigint").alias("count"))).groupBy("term").agg(F.sum("count").alias("df"))
    idf = with_templates.select("term", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    rare = F.log(F.lit((n + 1) / 2.0)) + 1  # of terms that no template has
    weights = known.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    sides = weights.join(norms, "template").select("template", "license", "term", (F.col("w") / F.col("norm")).alias("unit"))
    tf = own.select("row", "n", F.explode("words").alias("term")).groupBy("row", "n", "term").agg(F.count("*").alias("tf"))
    weighed = tf.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", rare))
    norm = weighed.groupBy("row", "n").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(sides), "term").groupBy("row", "n", "template", "license").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    cosines = dots.join(norm, ["row", "n"]).select("row", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= least)
    best = cosines.groupBy("row", "license").agg(F.max("score").alias("score")).groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best"))
    return best.select("row", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score"))


def _templates(spark: SparkSession) -> DataFrame:
    """template, license, term, tf of the fixed templates."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(TEMPLATES)], "template int, license string, text string")
    return rows.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))


def ancestors(directory: Column) -> Column:
    """The directory and all above it, with their depths; the top is the empty one of depth 0."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))


def inherit(files: DataFrame, licenses: DataFrame) -> DataFrame:
    """directory, license, score, from_dir: what each directory of files inherits from the nearest licence file's.

    files: path; licenses: path, license, score of the licence files.
    """
    clean = lambda c: F.array_join(F.filter(F.split(parent(c), "/"), lambda p: p != ""), "/")
    order = Window.partitionBy("above").orderBy(F.desc("score"), "license")
    own = licenses.filter("path is not null").select(clean(F.col("path")).alias("above"), "license", "score").distinct()
    own = own.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")
    directories = files.filter("path is not null").select(parent(F.col("path")).alias("directory")).distinct()
    climbed = directories.select("directory", F.explode(ancestors(F.col("directory"))).alias("a")).select("directory", "a.depth", "a.above")
    met = climbed.join(own, "above")
    nearest = met.groupBy("directory").agg(F.max_by(F.struct("license", "score", F.col("above").alias("from_dir")), "depth").alias("x"))
    return nearest.select("directory", "x.*")


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", licence_file: Column | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, path, license, score, origin ('header', 'inherited' or null), from_dir of every row.

    licence_file: over path and text; which files license their directory.  Without it, names like LICENSE do.
    """
    own = files.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    is_licence = F.coalesce(F.col("path").rlike(LICENCE_FILE) if licence_file is None else licence_file, F.lit(False))
    named = own.withColumn("row", F.xxhash64("doc_id", "path", "text"))
    flagged = named.select("row", "doc_id", "path", is_licence.alias("is_licence"), F.when(F.col("text").rlike(TRIGGER), F.col("text")).otherwise("").alias("text"))
    found = written(detect(flagged.filter("text != ''"), F.col("is_licence"), least), "licenses")
    heads = flagged.filter("text != ''").select("row", "path", "is_licence").join(found, "row")
    given = inherit(own.select("path"), heads.filter("is_licence").select("path", "license", "score"))
    rows = named.select("row", "doc_id", "path", parent(F.col("path")).alias("directory"))
    both = rows.join(found, "row", "left").join(given.toDF("directory", "given", "given_score", "given_dir"), "directory", "left")
    origin = F.when(F.col("license").isNotNull(), "header").when(F.col("given").isNotNull(), "inherited")
    inherited = F.col("license").isNull()
    return both.select("doc_id", "path", F.coalesce("license", "given").alias("license"), F.coalesce("score", "given_score").alias("score"), origin.alias("origin"), F.when(inherited, F.col("given_dir")).alias("from_dir"))
