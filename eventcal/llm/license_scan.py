"""License scans with MinHash bands over overlapping text windows, in DataFrame functions alone.

A text is an array of hashes of its five-word shingles. Windows of 1, 8 and 32 shingles overlap by half. A
template is looked for with the largest window that lies whole inside any copy of it, wherever the copy begins, and
all its own windows of that size are indexed; so a window of a true copy equals one of them and collides
for certain. Each band is one minimum under a permutation: windows of Jaccard similarity J collide in one of ``BANDS`` with
probability 1 - (1 - J)^BANDS, over 0.995 from J = 0.6 on. Where a band collides, the share of the template's shingles around
the window is counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 5
SIZES = (1, 8, 32)
BANDS = 6
#: Templates are literals of the plan; more than so many are refused.
MOST_TEMPLATES = 200

# Notices as they are commonly printed.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met"),
)
#: Fixed permutations: a hash is xor-ed with one of these before the minimum is taken.
MASKS = tuple((0x9E3779B97F4A7C15 * (2 * k + 1) + (1 << 63)) % (1 << 64) - (1 << 63) for k in range(BANDS))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(w: Column) -> Column:
    at = lambda i, k: F.get(w, i + k)
    return F.when(F.size(w) >= WORDS, F.transform(
        F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[at(i, k) for k in range(WORDS)]))).otherwise(
        F.array().cast("array<bigint>"))


def _upto(n: Column) -> Column:
    """0, 1, ... n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _minima(x: Column, size: int) -> Column:
    """The least entry of each window of ``size``, every half window; one cut short at the end counts."""
    step = max(1, size // 2)
    n = F.ceil(F.size(x) / F.lit(step)).cast("int")
    return F.transform(_upto(n), lambda i: F.array_min(F.slice(x, i * step + 1, F.lit(size))))


def with_windows(df: DataFrame, sizes=SIZES) -> DataFrame:
    """The minima of each band over each size of windows, as columns ``m{size}_{band}``, from column ``sh``."""
    wide = [s for s in sizes if s > 1]
    if wide:
        df = df.withColumns({f"x_{b}": F.transform("sh", _masked(mask)) for b, mask in enumerate(MASKS)})
        df = df.withColumns({f"m{s}_{b}": _minima(F.col(f"x_{b}"), s) for s in wide for b in range(BANDS)})
    return df.drop(*[f"x_{b}" for b in range(BANDS)])


def _masked(mask: int):
    return lambda h: h.bitwiseXOR(F.lit(mask))


def size_for(n: int) -> int:
    """The largest window that is whole inside any copy of a template of n shingles."""
    return max(s for s in SIZES if s == 1 or s + s // 2 - 1 <= n)


def _template_rows(templates: DataFrame, name_col: str, text_col: str) -> list[dict]:
    """Names, shingles and bands of the templates; a bounded collect."""
    rows = (templates.select(F.col(name_col).alias("name"), words(F.col(text_col)).alias("w"))
            .withColumn("sh", _shingles(F.col("w"))).select("name", "sh").limit(MOST_TEMPLATES + 1).collect())
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    out = []
    for r in sorted(rows, key=lambda r: (r["name"], r["sh"])):
        if not r["sh"]:
            raise ValueError(f"template {r['name']}: fewer than {WORDS} words")
        n, s = len(r["sh"]), size_for(len(r["sh"]))
        bands = [set(r["sh"])] if s == 1 else [{min((h ^ m for h in r["sh"][i:i + s])) for i in range(n - s + 1)} for m in MASKS]
        out.append({"name": r["name"], "set": sorted(set(r["sh"])), "n": n, "size": s, "bands": bands})
    return out


def _places(column: Column, values: list[int]) -> Column:
    """The indexes of an array's entries that are among the values."""
    return F.filter(_upto(F.size(column)), lambda i: F.get(column, i).isin(values))


def _found(t: dict, percent: int) -> Column:
    """The template's name and first shingle, if enough of it stands around a window that collided."""
    own, step, hits = F.array(*[F.lit(h) for h in t["set"]]), max(1, t["size"] // 2), F.col(f"hit{t['size']}")

    def fits(i: Column) -> Column:
        region = F.slice(F.col("sh"), F.greatest(i * step - t["n"], F.lit(0)) + 1, F.lit(2 * t["n"] + t["size"]))
        return 100 * F.size(F.array_intersect(region, own)) >= percent * len(t["set"])

    first = F.array_min(_places(F.col("sh"), t["set"]))
    return F.when((F.size(hits) > 0) & F.exists(hits, fits), F.struct(F.lit(t["name"]).alias("name"), first.alias("at")))


def default_templates(spark) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "name string, text string")


def scan(docs: DataFrame, templates: DataFrame | None = None, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
         name_col: str = "name", template_col: str = "text") -> DataFrame:
    """(id, n_words, licenses, places) of every row: names of the templates found, sorted, and where.

    A template is found where ``percent`` of its distinct shingles or more stand around a window that collides with one of its
    own. ``places`` has for each template found ``name:word``, the first shingle of its that stands in the text. Null
    texts, texts under five words and an empty set of templates find nothing. Texts are scanned whole; rows that repeat
    an id one by one; other columns are not read.
    """
    known = _template_rows(templates if templates is not None else default_templates(docs.sparkSession), name_col, template_col)
    rows = docs.select(F.col(id_col).alias("_id"), words(F.col(text_col)).alias("w"))
    rows = rows.withColumn("sh", _shingles(F.col("w"))).withColumn("w", F.size("w"))
    sizes = sorted({t["size"] for t in known}) or [1]
    rows = with_windows(rows, sizes)
    for s in sizes:                              # where any band of any template collides
        own = [t for t in known if t["size"] == s]
        hits = []
        for b in range(1 if s == 1 else BANDS):
            values = sorted(set().union(*[t["bands"][b] for t in own])) if own else []
            column = F.col("sh") if s == 1 else F.col(f"m{s}_{b}")
            hits.append(_places(column, values))
        rows = rows.withColumn(f"hit{s}", F.array_distinct(F.flatten(F.array(*hits))))
    rows = rows.drop(*[f"m{s}_{b}" for s in SIZES for b in range(BANDS) if s > 1])
    found = [_found(t, percent) for t in known]
    kind = "array<struct<name:string,at:int>>"
    rows = rows.withColumn("found", F.array_sort(F.filter(F.array(*found).cast(kind) if found else F.array().cast(kind), lambda x: x.isNotNull())))
    return rows.select(
        F.col("_id").alias(id_col), F.col("w").cast("long").alias("n_words"),
        F.array_distinct(F.transform("found", lambda x: x["name"])).alias("licenses"),
        F.array_join(F.array_distinct(F.transform("found", lambda x: F.concat(x["name"], F.lit(":"), x["at"].cast("string")))), ",").alias("places"))
