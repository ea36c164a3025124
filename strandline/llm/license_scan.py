"""License scans by diagonal voting; DataFrame functions only.

All rolling K-grams of a text's words are joined to the K-grams of templates (by hash, then word by word). A match of
text position p and template position q votes for the diagonal p - q. Phrases hold where all their grams vote for one
diagonal. For longer templates, diagonals at most GAP apart are merged (words put in or left out), and a merged span is
verified: it must cover enough of the template's grams and not be much longer than the template.

The templates are a fixed table, so they are broadcast; only votes and one row a document are shuffled.

Defined results: a null text is empty and has no words. Rows with one doc_id and text give that many equal rows; a null
doc_id is a value like others. No label gives empty strings and score 0. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import stage, table

K, GAP, COVER, STRETCH = 3, 4, 0.6, 1.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Wording of well-known licenses, each with its label.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
]


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], phrases: dict[str, str]) -> DataFrame:
    """One row for each gram: the template's number and label, whether it is a phrase, its grams, and the gram's place and words."""
    rows = [(0, "", False, 0, 0, "", "", "")]  # meets the mark that every text has
    for n, (label, text, phrase) in enumerate([(v, k, True) for k, v in phrases.items()] + [(a, b, False) for a, b in templates], 1):
        words = template_words(text)
        rows += [(n, label, phrase, len(words) - K + 1, i, *words[i : i + K]) for i in range(len(words) - K + 1)]
    return spark.createDataFrame(rows, "template int, label string, phrase boolean, grams int, tpos int, t1 string, t2 string, t3 string")


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    grams = F.broadcast(template_grams(spark, TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases).withColumn("h", F.xxhash64("t1", "t2", "t3")))
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    texts = docs.select("doc_id", F.xxhash64("text").alias("print"), F.concat(F.array(F.lit("")), words).alias("w"))
    # The first element is a mark: words start at 1, and the text itself keeps one row.
    three = F.arrays_zip(F.col("w").alias("w1"), F.slice("w", 2, F.size("w")).alias("w2"), F.slice("w", 3, F.size("w")).alias("w3"))
    rolled = texts.select("doc_id", "print", (F.size("w") - 1).cast("long").alias("n_words"), F.posexplode(three).alias("pos", "g"))
    first = F.col("pos") == 0
    g = [F.when(first, F.lit("")).otherwise(F.col(f"g.w{i}")) for i in (1, 2, 3)]
    rolled = rolled.select("doc_id", "print", "n_words", "pos", *(c.alias(f"w{i}") for i, c in enumerate(g, 1))).withColumn("h", F.xxhash64("w1", "w2", "w3"))
    same = (rolled["h"] == grams["h"]) & (rolled["w1"] == grams["t1"]) & (rolled["w2"] == grams["t2"]) & (rolled["w3"] == grams["t3"])
    votes = rolled.join(grams, same).select("doc_id", "print", "n_words", (F.col("pos") - 1).alias("pos"), "template", "label", "phrase", "grams", "tpos")
    votes = stage(votes, "votes")

    rows = votes.filter("template = 0").groupBy("doc_id", "print", "n_words").agg(F.count("*").alias("copies"))
    hits = votes.filter("template > 0").drop("n_words").distinct().withColumn("diagonal", F.col("pos") - F.col("tpos"))
    base = hits.filter("phrase").groupBy("doc_id", "print", "template", "label", "grams", "diagonal").agg(F.count("*").alias("n")).filter("n = grams")
    base = base.groupBy("doc_id", "print").agg(F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base"))

    along = Window.partitionBy("doc_id", "print", "template").orderBy("diagonal", "pos")
    far = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= GAP, 0).otherwise(1)
    spans = hits.filter("not phrase").withColumn("far", far).withColumn("span", F.sum("far").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("doc_id", "print", "template", "label", "grams", "span").agg(F.count_distinct("tpos").alias("met"), (F.max("pos") - F.min("pos") + 1).alias("reach"))
    spans = spans.withColumn("cover", F.when(F.col("reach") <= STRETCH * F.col("grams") + GAP, F.col("met") / F.col("grams")).otherwise(F.lit(0.0)))
    spans = spans.groupBy("doc_id", "print").agg(F.max("cover").alias("cover"), F.collect_set(F.when(F.col("cover") >= COVER, F.col("label"))).alias("more"))

    out = rows.alias("r")
    for name, side in (("b", base), ("s", spans)):
        out = out.join(side.alias(name), F.col("r.doc_id").eqNullSafe(F.col(f"{name}.doc_id")) & (F.col("r.print") == F.col(f"{name}.print")), "left")
    none = F.array().cast("array<string>")
    base_labels, labels = F.coalesce("base", none), F.array_union(F.coalesce("base", none), F.coalesce("more", none))
    return out.select(
        F.col("r.doc_id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named or quoted in every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))
