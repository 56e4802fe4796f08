"""License scans: which license texts occur in a document, and where.

Texts are words of letters and digits, in lower case; shingles are runs of ``SHINGLE`` words. A template of L shingles
is looked for in overlapping windows of L + L // 8 shingles that step by L // 8 (at least 1), so some window holds any
occurrence whole. Windows and templates have ``BANDS`` MinHash values, each a band of its own; a template is retrieved
where a window meets it in any band. Where a window has ``CONTAINMENT`` of a template's shingles their similarity is at
least 0.6 and the chance to miss it at most 0.4 ** 24, which is 3 in 10 ** 10. What is retrieved is verified: the exact
share of the template's distinct shingles that the window has must reach the bound.

A window can only meet a template in a band if it holds the very shingle that gives the template's value there. So the
windows' values are computed only around occurrences of these shingles; all other windows cannot meet any template.

All of it is one expression per row, without a shuffle. The templates are a short list held in the plan.

Edge cases: a null or empty text, or one with fewer words than a shingle, holds nothing; a template with fewer words
than a shingle is refused; equal templates under two names are both found; repeated rows and null ids are scanned like
any others; long texts are read whole; an empty table gives no rows; other columns are kept, but a column ``matches`` is
replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 24
CONTAINMENT = 0.8

#: Names and wordings of license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_KIND = "array<struct<name:string,size:int,step:int,need:int,shingles:array<bigint>,anchors:array<bigint>,bands:array<struct<band:int,value:bigint>>>>"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column) -> Column:
    """Array of the hashes of the runs of SHINGLE words, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    words = F.transform(words, lambda w: F.xxhash64(w))
    places = lambda w: F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(0), F.size(w) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return let(words, lambda w: F.transform(places(w), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE)))))


def _min_hash(some: Column, band: Column) -> Column:
    return F.array_min(F.transform(some, lambda x: F.xxhash64(x, band)))


def prepare(spark, templates: dict[str, str], bands: int = BANDS, containment: float = CONTAINMENT) -> list[dict]:
    """Sizes, shingles, and per band the value and the shingle that gives it, of every template."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").withColumn("s", shingles(F.col("text")))
    value = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.transform("s", lambda x: F.struct(F.xxhash64(x, b).alias("value"), x.alias("anchor"))).alias("all")))
    value = F.transform(value, lambda v: F.struct(v["band"].alias("band"), F.array_min(v["all"]).alias("least")))
    out = []
    for r in rows.select("name", "s", value.alias("v")).collect():  # as many rows as templates
        if not r.s:
            raise ValueError(f"template {r.name} has fewer than {SHINGLE} words")
        n, t = len(r.s), sorted(set(r.s))
        need = -(-len(t) * round(containment * 100) // 100)
        out.append({"name": r["name"], "size": n + n // 8, "step": max(1, n // 8), "need": need, "shingles": t, "anchors": sorted({v.least.anchor for v in r.v}), "bands": [{"band": v.band, "value": v.least.value} for v in r.v]})
    return out


def matches(text: Column, prepared: list[dict]) -> Column:
    """Array of (name, start, has, of): the window from shingle start on has so many of the template's shingles."""
    anchors = sorted({a for t in prepared for a in t["anchors"]})
    known = F.from_json(F.lit(json.dumps(prepared)), _KIND)
    none = F.array().cast("array<struct<name:string,start:int,has:int,of:int>>")

    def scan(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        hits = F.filter(places, lambda i: F.get(s, i).isin(anchors))

        def of(t: Column, at: Column) -> Column:
            own = F.filter(at, lambda i: F.array_contains(t["anchors"], F.get(s, i)))
            first = lambda i: F.ceil(F.greatest(i - t["size"] + 1, F.lit(0)) / t["step"]).cast("int") * t["step"]
            starts = F.array_distinct(F.flatten(F.transform(own, lambda i: F.when(first(i) <= i, F.sequence(first(i), i, t["step"])).otherwise(F.array().cast("array<int>")))))
            window = lambda a: F.slice(s, a + 1, t["size"])
            met = F.filter(starts, lambda a: F.exists(t["bands"], lambda b: _min_hash(window(a), b["band"]) == b["value"]))
            found = F.transform(met, lambda a: F.struct(t["name"].alias("name"), a.alias("start"), F.size(F.array_intersect(t["shingles"], window(a))).alias("has"), F.size(t["shingles"]).alias("of")))
            return F.filter(found, lambda m: m["has"] >= t["need"])

        return let(hits, lambda at: F.when(F.size(at) > 0, F.flatten(F.transform(known, lambda t: of(t, at)))).otherwise(none))

    return let(shingles(text), scan) if prepared else none


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, **how) -> DataFrame:
    """docs with ``matches``: array of (name, start, has, of), every window that holds a template."""
    return docs.withColumn("matches", matches(F.col(text), prepare(docs.sparkSession, TEMPLATES if templates is None else templates, **how)))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct("matches.name"))
    best = F.aggregate("matches", F.lit(0), lambda a, m: F.greatest(a, m["has"]))
    return out.select("doc_id", F.array_join(names, ",").alias("licenses"), F.size(names).cast("long").alias("n_licenses"), best.cast("long").alias("most_shingles"))


def _sql() -> str:
    words = lambda c: f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    table = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    return f"""
WITH t0(name, text) AS (VALUES {table}),
tw AS (SELECT name, {words('text')} AS w FROM t0),
ts AS (SELECT name, len(w) - 4 AS n, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS g FROM tw),
t AS (SELECT name, any_value(n) AS n, count(DISTINCT g) AS k, any_value(n) + any_value(n) // 8 AS size, greatest(1, any_value(n) // 8) AS step FROM ts GROUP BY 1),
dw AS (SELECT doc_id, {words('text')} AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
o AS MATERIALIZED (SELECT ds.doc_id, ts.name, ds.p, ds.g FROM ds JOIN (SELECT DISTINCT name, g FROM ts) ts USING (g)),
s AS (SELECT DISTINCT doc_id, name, a FROM (SELECT doc_id, name, p, size, unnest(range(CAST(ceil(greatest(p - size + 1, 0) / step) AS BIGINT) * step, p + 1, step)) AS a FROM o JOIN t USING (name))),
h AS (SELECT s.doc_id, s.name, s.a, count(DISTINCT o.g) AS has FROM s JOIN t USING (name) JOIN o ON o.doc_id = s.doc_id AND o.name = s.name AND o.p >= s.a AND o.p < s.a + t.size GROUP BY ALL),
m AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(DISTINCT name) AS n_licenses, max(has) AS most_shingles
  FROM h JOIN t USING (name) WHERE 5 * has >= 4 * k GROUP BY 1)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_licenses, 0) AS n_licenses, coalesce(most_shingles, 0) AS most_shingles
FROM documents LEFT JOIN m USING (doc_id)
"""


OP3_SQL = _sql()
