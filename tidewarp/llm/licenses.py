"""License scans: MinHash bands over overlapping text windows, verified by shingle containment. DataFrame functions only.

Texts and license templates become three-word shingles of plain words (A-Z lowered, anything but a-z and 0-9 between
words). A shingle that no template has cannot count for any, so windows keep only shingles of templates: all others leave
in the scan, before anything moves. Windows are twice as long as the longest template and start every such length,
so a notice that lies anywhere in a text lies wholly in some window, however long the text is.

A window and a template that share a band (the least hash of their shingles under one of ``BANDS`` hash functions, one row
a band) meet as candidates. A window that holds a template and up to four times as many other template shingles has a Jaccard
similarity of 0.2 with it and meets it with probability 1 - 0.8^64 > 0.999999; with less clutter, more surely. Exact containment of the
template's shingles in the window then decides.

Shuffles carry the few hits only, keyed by row and window, so no source, line or group of copies makes a hot key. The
templates' bands (templates x BANDS rows) are broadcast; their number is that of the stated table.

Defined results: null and empty texts match nothing; texts and templates shorter than three words are one shingle each.
Repeated rows are scanned each on its own; a null doc_id is carried along. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarp.llm.common import prepare

BANDS = 64
CONTAINED = 0.8
WIDTH = 3
#: fixed values: public license notices and the operative sentences of common licenses
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Licensed under the MIT License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
                 "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
                 "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
                 "above copyright notice and this permission notice appear in all copies."),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
                     "software without specific prior written permission."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def words(text: Column) -> Column:
    """Plain words of a text, null for none."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))
    return F.when(plain != "", F.split(plain, " "))


def shingles(w: Column) -> Column:
    """The hash of the shingle at each word."""
    last = F.greatest(F.size(w) - WIDTH, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))


def _bands(hashes: Column) -> Column:
    """The least hash under each of BANDS functions."""
    def least(seed: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(seed))))

    return F.array(*map(least, range(BANDS)))


def templates(spark: SparkSession, table=TEMPLATES) -> DataFrame:
    """(template, license, hashes, length) of a table of (license, text)."""
    rows = spark.createDataFrame([], "template int, license string, text string") if not table else spark.sql(
        "SELECT * FROM VALUES " + ", ".join(f"({i}, '{name}', '{text.replace(chr(92), ' ').replace(chr(39), ' ')}')" for i, (name, text) in enumerate(table))
        + " AS t(template, license, text)")
    return rows.select("template", "license", words(F.col("text")).alias("w")).where("w is not null").select(
        "template", "license", F.array_distinct(shingles(F.col("w"))).alias("hashes"), F.size("w").alias("length"))


def scan(docs: DataFrame, table=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, license, containment, n_windows, first_word): one row per row of ``docs`` (doc_id, text) and license found
    in it; the best containment, the windows that hold it and the first word of the first of these."""
    spark = docs.sparkSession
    prepare(spark)
    known = templates(spark, table)
    stated = known.select("hashes", "length").collect()  # the stated table
    vocabulary = sorted({h for r in stated for h in r[0]})
    step = max([r[1] for r in stated], default=1)
    hits = F.filter(F.transform(shingles(F.col("w")), lambda h, i: F.struct(i.alias("i"), h.alias("h"))), lambda x: x["h"].isin(vocabulary))
    found = (docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
             .select("doc_id", "row", words(F.col("text")).alias("w")).where("w is not null")
             .select("doc_id", "row", F.explode(hits).alias("x")))
    block = F.floor(F.col("x.i") / step)
    windows = (found.select("doc_id", "row", "x.h", F.explode(F.array(block - 1, block)).alias("window")).where("window >= 0")
               .groupBy("row", "window").agg(F.first("doc_id").alias("doc_id"), F.collect_set("h").alias("held")))
    banded = windows.select("*", F.posexplode(_bands(F.col("held"))).alias("band", "least"))
    known_bands = known.select("template", "license", "hashes", F.posexplode(_bands(F.col("hashes"))).alias("band", "least"))
    met = banded.join(F.broadcast(known_bands), ["band", "least"]).dropDuplicates(["row", "window", "template"])
    share = F.size(F.array_intersect("held", "hashes")) / F.size("hashes")
    return (met.withColumn("share", share).where(F.col("share") >= contained)
            .groupBy("row", "license").agg(F.first("doc_id").alias("doc_id"), F.max("share").alias("containment"),
                                           F.count_distinct("window").alias("n_windows"), (F.min("window") * step).cast("long").alias("first_word"))
            .select("doc_id", "license", "containment", "n_windows", "first_word"))


def oracle(table=TEMPLATES, contained: float = CONTAINED) -> str:
    """DuckDB SQL for ``scan`` over ``documents``: all windows against all templates."""
    plain = "trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    cut = "unnest(list_transform(range(0, greatest(len(w) - 3, 0) + 1), lambda i: {'i': i, 'h': concat_ws(' ', w[i + 1], w[i + 2], w[i + 3])}))"
    values = ", ".join(f"({i}, '{n}', '{t.replace(chr(92), ' ').replace(chr(39), ' ')}')" for i, (n, t) in enumerate(table))
    return f"""
WITH raw(template, license, text) AS (VALUES {values}),
tw AS (SELECT template, license, string_split({plain}, ' ') AS w FROM raw WHERE {plain} <> ''),
ts AS (SELECT DISTINCT template, license, x.h AS h FROM (SELECT template, license, {cut} AS x FROM tw)),
tn AS (SELECT template, count(*) AS n FROM ts GROUP BY 1),
step AS (SELECT max(len(w)) AS s FROM tw),
dw AS (SELECT doc_id, string_split({plain}, ' ') AS w FROM documents WHERE {plain} <> ''),
ds AS (SELECT doc_id, x.i AS i, x.h AS h FROM (SELECT doc_id, {cut} AS x FROM dw) WHERE x.h IN (SELECT h FROM ts)),
win AS (SELECT DISTINCT doc_id, h, i // s - k AS wn FROM ds, step, (VALUES (0), (1)) AS o(k) WHERE i // s - k >= 0),
m AS (SELECT doc_id, wn, win.h, template, license FROM win JOIN ts ON win.h = ts.h),
c AS (SELECT doc_id, wn, m.template, license, count(DISTINCT h) / CAST(any_value(tn.n) AS DOUBLE) AS share FROM m JOIN tn ON tn.template = m.template GROUP BY 1, 2, 3, 4)
SELECT doc_id, license, max(share) AS containment, count(DISTINCT wn) AS n_windows, CAST(min(wn) * any_value(s) AS BIGINT) AS first_word
FROM c, step WHERE share >= {contained} GROUP BY doc_id, license"""
