"""Licence scan: MinHash bands over overlapping windows retrieve templates, containment verifies.

All of it is DataFrame expressions and joins: words are hashed, five-word shingles are hashed from
those.  A template of L shingles has blocks of B shingles with B < L <= 2B; a window is three
neighbouring blocks, and windows start at every block, so one of them always covers a whole
occurrence.  Each band is one minimum under a hash function of its own.  A window that holds 75 %
of a template has a Jaccard similarity of at least 0.22 with it (0.375 / 1.625 or more), hence
shares a band with probability 1 - 0.77 ** 32 = 0.9997 at the least; for the usual full match it is
above 1 - 0.66 ** 32.  One-shingle templates are matched at similarity 1.  A retrieved window
matches if it contains at least 75 % of the template's shingles, compared exactly.

The band index is a table with a row for each template and band: the minimum, and the shingle that
has it.  A window can share that minimum only if it holds that shingle, so a text's shingles are
joined to the index, and the minimum of the windows around a shingle is taken only where one meets an entry.  The
windows that come out are those that full tables of minima would give.  The index goes to every
task while ``INDEX_ROWS`` and ``TEMPLATE_WORDS`` bound it; larger sets of templates are joined by a shuffle.

Defined results: null and empty texts, and texts with no match, get an empty list; fewer than
five words form one shingle; templates without a word match nothing; repeated rows repeat their
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, CONTAINED, BANDS = 5, 0.75, 32
#: Rows of a band index, and words of templates, that may be broadcast: some 50 MB.
INDEX_ROWS, TEMPLATE_WORDS = 1 << 19, 1 << 21
#: Short licence notices and the openings of common licence texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
}


def _shingles(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_h``: the shingle hashes in order."""
    hashed = docs.withColumn("_w", F.transform(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    n = F.greatest(F.size("_w") - (SHINGLE - 1), F.lit(1))
    one = lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(SHINGLE)])
    return hashed.withColumn("_h", F.when(F.size("_w") == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), one)))


def _signed(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, its distinct shingles, their number, and the blocks and windows that it is sought in."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    t = _shingles(rows, "text").select("license", F.array_distinct("_h").alias("shingles")).withColumn("n", F.size("shingles"))
    block = F.when(F.col("n") == 1, F.lit(1)).otherwise(F.expr("shiftleft(1, length(bin(n - 1)) - 1)"))
    return t.select("license", "shingles", "n", block.alias("block"), F.when(F.col("n") == 1, F.lit(1)).otherwise(F.lit(3)).alias("wide"))


def _index(signed: DataFrame) -> DataFrame:
    """For each template and band: the minimum, and the shingle whose hash it is."""
    bands = F.sequence(F.lit(1), F.when(F.col("n") == 1, F.lit(1)).otherwise(F.lit(BANDS)))
    rows = signed.select("license", "shingles", "n", "block", "wide", F.explode(bands).alias("band"))
    least = F.array_min(F.transform("shingles", lambda x: F.struct(F.xxhash64(x, F.col("band")).alias("minimum"), x.alias("met")))).alias("least")
    return rows.select("license", "n", "block", "wide", "band", least).select("license", "n", "block", "wide", "band", "least.minimum", "least.met")


def _window(k: Column) -> Column:
    """The shingles of the window that starts at block k."""
    return F.slice("_h", (k * F.col("block") + 1).cast("int"), F.col("block") * F.col("wide"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", index_rows: int = INDEX_ROWS) -> DataFrame:
    """For each row: key and ``matches``, an array of (license, containment), by name."""
    templates = TEMPLATES if templates is None else templates
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    if not templates:
        return rows.select(F.col("_key").alias(key), F.array().cast("array<struct<license:string,containment:double>>").alias("matches"))
    signed = _signed(docs.sparkSession, templates)
    index, small = _index(signed), len(templates) * BANDS <= index_rows and sum(len(t.split()) for t in templates.values()) <= TEMPLATE_WORDS
    each = _shingles(rows, "_text").select(F.monotonically_increasing_id().alias("_row"), "_key", "_h")
    # The last entry of a row is null: it meets no template and keeps the row.
    each = each.select("_row", "_key", "_h", F.posexplode(F.concat("_h", F.array(F.lit(None).cast("bigint")))).alias("_at", "_shingle"))
    if small:
        met = each.join(F.broadcast(index), F.col("_shingle") == F.col("met"), "left")
    else:  # the null entries are dealt out by row
        own = each.withColumn("_on", F.coalesce("_shingle", F.xxhash64("_row"))).withColumn("_none", F.col("_shingle").isNull())
        met = own.join(index, (F.col("_on") == F.col("met")) & (F.col("_none") == F.lit(False)), "left")
    met = met.where(F.col("license").isNotNull() | F.col("_shingle").isNull())
    starts = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda o: F.expr("_at div block") - o)
    minimum = lambda k: F.array_min(F.transform(_window(k), lambda x: F.xxhash64(x, F.col("band"))))
    # No filter on the windows: it would be merged with the one above and end the generated code there.
    retrieved = met.withColumn("_windows", F.filter(starts, lambda k: (k >= 0) & (minimum(k) == F.col("minimum")))).select("_row", "_key", "_h", "_windows", "license", "n", "block", "wide")
    exact = signed.select(F.col("license").alias("_license"), "shingles")
    checked = retrieved.join(F.broadcast(exact) if small else exact, F.col("license") == F.col("_license"), "left")
    share = F.array_max(F.transform("_windows", lambda k: F.size(F.array_intersect(_window(k), "shingles")))) / F.col("n")
    checked = checked.select("_row", "_key", "license", share.alias("containment"))
    found = F.when(F.col("containment") >= CONTAINED, F.struct("license", "containment"))
    whole = checked.groupBy("_row", "_key").agg(F.collect_set(found).alias("found"))
    best = lambda name: F.array_max(F.transform(F.filter("found", lambda m: m["license"] == name), lambda m: m["containment"]))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda m: m["license"])))
    return whole.select(F.col("_key").alias(key), F.transform(names, lambda x: F.struct(x.alias("license"), best(x).alias("containment"))).alias("matches"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def oracle(templates: dict[str, str] | None = None, key: str = "doc_id") -> str:
    """The same by brute force in SQL: every window of every text against every template."""
    rows = ", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in sorted((TEMPLATES if templates is None else templates).items()))
    words = lambda c: rf"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    cut = f"case when len(w) = 0 then [] else list_transform(range(0, greatest(len(w) - {SHINGLE - 1}, 1)), lambda i: array_to_string(w[i + 1 : i + {SHINGLE}], ' ')) end"
    return f"""
with t as (select id, list_distinct(h) h from (select id, {cut} h from (select id, {words("text")} w from (values {rows}) v(id, text)))),
s as (select id, len(h) n, case when len(h) = 1 then 1 else cast(pow(2, ceil(log2(len(h))) - 1) as bigint) end block, case when len(h) = 1 then 1 else 3 end wide, unnest(h) sh from t),
d as (select row_number() over () r, {key}, text from documents),
p as (select r, unnest(h) sh, generate_subscripts(h, 1) - 1 pos from (select r, {cut} h from (select r, {words("text")} w from d))),
m as (select p.r, s.id, s.n, p.sh, p.pos // s.block b, s.wide from p join s using (sh)),
x as (select r, id, n, sh, b - o k from m, (values (0), (1), (2)) v(o) where o < wide and b >= o),
c as (select r, id, max(share) share from (select r, id, k, count(distinct sh) / n share from x group by r, id, k, n) group by r, id having max(share) >= {CONTAINED})
select d.{key}, count(c.id) n_licenses, coalesce(string_agg(c.id, ',' order by c.id), '') licenses, coalesce(max(c.share), 0) containment
from d left join c using (r) group by d.r, d.{key}"""
