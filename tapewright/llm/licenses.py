"""License scan: MinHash bands over overlapping windows of words find templates, exact containment confirms.

Only DataFrame functions are used. A template of T words is looked for in windows of T + T // 2 words
that start every T // 2 words, so any run of T words lies in one window. Window and template are sets of
five-word shingles. A template kept to ``CONTAINED`` within a window has a Jaccard similarity to it of at
least about a third, and each of ``BANDS`` bands of one MinHash then agrees with that probability: all
disagree with a probability below 1e-5. A window that agrees in a band is compared exactly: the share of
the template's shingles, as words, that the window holds. SPDX tags, which may have only four words, are found by
their exact names beside that.

A band can agree only where the window holds the very shingle that is the template's minimum, so texts
without any of these are left out by one overlap test in the scan; nothing is shuffled for them.

Defined results: null and empty texts match nothing; rows that repeat an id share their matches; rows
without an id are matched as one document of id null; repeated templates match each by name; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.exact_dedup import ascii_lower

SHINGLE, BANDS, CONTAINED = 5, 32, 0.8
#: What Creative Commons licences are called: conditions, and the spellings of the long name.
_CC = {
    "BY": ("Attribution",),
    "BY-SA": ("Attribution-ShareAlike", "Attribution-Share Alike"),
    "BY-NC": ("Attribution-NonCommercial", "Attribution-Non-Commercial"),
    "BY-ND": ("Attribution-NoDerivatives", "Attribution-No Derivatives", "Attribution-NoDerivs", "Attribution-No Derivative Works"),
    "BY-NC-SA": ("Attribution-NonCommercial-ShareAlike", "Attribution-Non-Commercial-Share Alike", "Attribution-Noncommercial-Share Alike"),
    "BY-NC-ND": ("Attribution-NonCommercial-NoDerivatives", "Attribution-Non-Commercial-No Derivatives", "Attribution-NonCommercial-NoDerivs", "Attribution-Noncommercial-No Derivative Works"),
}


def _creative_commons() -> dict[str, tuple[str, ...]]:
    """The long and the short name with a version. "CC BY 4.0" is shorter than a shingle, so it takes a word beside it."""
    out = {}
    for kind, spellings in _CC.items():
        for version in ("4.0", "3.0", "2.5", "2.0"):
            short = f"CC {kind} {version}"
            shorts = [f"{word} {short}" for word in ("under", "a", "the", "license", "licence", "identifier")] + [f"{short} {word}" for word in ("license", "licence", "international")] if kind == "BY" else [short]
            out[f"CC-{kind}-{version}"] = (*(f"{'Commons' if long.startswith('Attribution-Non') and ' ' in long else 'Creative Commons'} {long} {version}" for long in spellings), *shorts)
    return out


def _gnu(name: str, short: str, version: str) -> tuple[str, ...]:
    """Notices of a GNU licence, cut to where 0.8 of the shingles tells its name and version from the others'."""
    return (
        f"terms of the {name} as published by the Free Software Foundation, either version {version} of the License",
        *(f"the {name}{by}{version}" for by in (", version ", " v. ", " v")),
        *(f"{lead} {short} {by}{version}" for lead in ("under the", "under the GNU") for by in ("version ", "v. ")),
        *(f"{lead} {short} v{version}" for lead in ("Licensed under the", "Released under the", "under the GNU")),
        f"SPDX-License-Identifier: {short}-{version if '.' in version else version + '.0'}",
    )


def _notices(name: str) -> tuple[str, ...]:
    return tuple(f"{verb} under the {name}" for verb in ("Licensed", "Released", "Distributed", "Available", "Is", "Provided")) + (f"under the terms of the {name}",)


_GPL, _LGPL, _AGPL = (f"GNU {kind}General Public License" for kind in ("", "Lesser ", "Affero "))
#: Notices as licences ask for them to be written, and how they are named (fixed texts). What has fewer words than a shingle is not looked for.
TEMPLATES = {
    "AGPL-3.0": _gnu(_AGPL, "AGPL", "3"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "under the Apache License 2.0",
        "under the Apache 2.0 License",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    # Both texts begin alike. In that of two clauses the disclaimer follows the clause on binary forms at once; in that of three the clause on names stands between.
    "BSD-2-Clause": (
        "provided with the distribution. THIS SOFTWARE IS PROVIDED BY",
        "under the BSD 2-Clause License",
        "under the 2-Clause BSD License",
        "under the Simplified BSD License",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "under the BSD 3-Clause License",
        "under the 3-Clause BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    **_creative_commons(),
    "CC0-1.0": ("Creative Commons CC0 1.0", "Creative Commons Zero v1.0", "under CC0 1.0 Universal", "Licensed under CC0 1.0", "Released under CC0 1.0", "the CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-2.0": _gnu(_GPL, "GPL", "2"),
    "GPL-3.0": _gnu(_GPL, "GPL", "3"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", *_notices("ISC License")),
    "LGPL-2.1": _gnu(_LGPL, "LGPL", "2.1"),
    "LGPL-3.0": _gnu(_LGPL, "LGPL", "3"),
    "MIT": (
        *_notices("MIT License"),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "under the Mozilla Public License 2.0", "under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", *_notices("Unlicense License")),
}

#: Names of licences in SPDX tags, lower-cased: those of the templates, and the GNU ones with what they allow.
SPDX = {name.lower() + more: name for name in TEMPLATES for more in ("", *(("+", "-only", "-or-later") if "GPL" in name else ()))}
#: A tag: its name is the group, full stops and hyphens at its end aside.
TAG = "(?:^|[^a-z0-9])spdx[^a-z0-9]+license[^a-z0-9]+identifier[^a-z0-9]+([a-z0-9][a-z0-9.+-]*)"


def tagged(text: Column) -> Column:
    """Licences named by SPDX tags, by equal names. A tag of four words has no shingle, so this needs no window."""
    known = F.create_map(*[F.lit(x) for pair in SPDX.items() for x in pair])
    names = F.transform(F.regexp_extract_all(ascii_lower(text), F.lit(TAG), F.lit(1)), lambda x: F.element_at(known, F.regexp_replace(x, "[.-]+$", "")))
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull()))


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _shingles(words: Column) -> Column:
    """Hashes of the five-word shingles of an array of words, in order; empty with fewer words."""
    return _let(words, lambda w: F.transform(_starts(w), lambda i: F.xxhash64(F.slice(w, i, SHINGLE))))


def _starts(words: Column) -> Column:
    return F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)).otherwise(F.array().cast("array<int>"))


def _shingle_words(words: Column) -> Column:
    return _let(words, lambda w: F.array_distinct(F.transform(_starts(w), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))))


def _minimum(hashes: Column, k: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k))))


def _behind_minimum(hashes: Column, k: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, F.lit(k)).alias("value"), h.alias("hash"))))["hash"]


def _minima(hashes: Column) -> Column:
    return _let(hashes, lambda hs: F.array(*[_minimum(hs, k) for k in range(BANDS)]))


def _windows(words: Column, hashes: Column, lowest: Column, sizes: list[int]) -> Column:
    """(size, at) of the windows that hold a shingle of ``lowest``."""

    def around(places: Column) -> Column:
        return F.flatten(F.array(*[_starts_around(words, places, size) for size in sizes]))

    places = _let(F.array_intersect(hashes, lowest), lambda met: F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(met, h), i)), lambda i: i.isNotNull()))
    return _let(places, around)


def _starts_around(words: Column, places: Column, size: int) -> Column:
    step = max(1, size // 2)
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)), F.lit(step))
    held = F.filter(starts, lambda at: F.exists(places, lambda i: (i >= at) & (i + SHINGLE <= at + size + step)))
    return F.transform(held, lambda at: F.struct(F.lit(size).alias("size"), at.alias("at")))


def templates(spark: SparkSession, texts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(license, template, size, hashes, shingles, minima, lowest) of each template; ``lowest`` are the shingles behind the minima."""
    rows = [(name, f"{name}-{i}", text) for name, found in (texts or TEMPLATES).items() for i, text in enumerate(found)]
    table = spark.createDataFrame(rows, "license string, template string, text string").select("license", "template", _words(F.col("text")).alias("words")).where(F.size("words") >= SHINGLE)
    table = table.select("license", "template", F.size("words").alias("size"), _shingles(F.col("words")).alias("hashes"), _shingle_words(F.col("words")).alias("shingles"))
    lowest = F.array(*[_behind_minimum(F.col("hashes"), k) for k in range(BANDS)])
    return table.select("*", _minima(F.col("hashes")).alias("minima"), lowest.alias("lowest"))


def license_matches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(id, license, contained, first_word): licences found in each document, the best containment and where it starts first."""
    spark = docs.sparkSession
    known = templates(spark, texts)
    # The templates are a fixed, small table.
    rare = sorted({h for r in known.select("lowest").collect() for h in r["lowest"]})
    sizes = sorted({r["size"] for r in known.select("size").collect()})
    rows = docs.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("words"))
    lowest = F.split(F.lit(",".join(map(str, rare))), ",").cast("array<bigint>")
    some = rows.where(F.coalesce(F.arrays_overlap(_shingles(F.col("words")), lowest), F.lit(False))).select("id", "words", _shingles(F.col("words")).alias("hashes"))
    windows = some.select("id", "words", F.explode(_windows(F.col("words"), F.col("hashes"), lowest, sizes)).alias("w"))
    windows = windows.select("id", "w.size", "w.at", F.slice("words", F.col("w.at") + 1, (F.col("w.size") + F.floor(F.col("w.size") / 2)).cast("int")).alias("words"))
    banded = windows.select("id", "size", "at", "words", F.posexplode(_minima(_shingles(F.col("words")))).alias("band", "value"))
    bands = known.select("license", "template", F.col("size").alias("its_size"), "shingles", F.posexplode("minima").alias("its_band", "its_value"))
    met = banded.join(F.broadcast(bands), (F.col("band") == F.col("its_band")) & (F.col("value") == F.col("its_value")) & (F.col("size") == F.col("its_size")))
    contained = F.size(F.array_intersect("shingles", _shingle_words(F.col("words")))) / F.size("shingles")
    best = met.select("id", "license", "at", contained.alias("contained")).where(F.col("contained") >= CONTAINED).groupBy("id", "license")
    return best.agg(F.max("contained").alias("contained"), F.min("at").cast("bigint").alias("first_word")).withColumnRenamed("id", id_col)


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per document: id, n_licenses, licenses (names, sorted, comma-joined; empty if none), from matches and SPDX tags."""
    found = license_matches(docs, id_col=id_col, text_col=text_col, texts=texts).select(id_col, "license")
    if texts is None:
        found = found.unionByName(docs.where(F.contains(ascii_lower(F.col(text_col)), F.lit("spdx"))).select(id_col, F.explode(tagged(F.col(text_col))).alias("license")))
    found = found.groupBy(F.col(id_col).alias("its_id")).agg(F.sort_array(F.collect_set("license")).alias("names"))
    ids = docs.select(id_col)
    out = ids.join(found, ids[id_col].eqNullSafe(found["its_id"]), "left")
    return out.select(id_col, F.when(F.col("names").isNull(), 0).otherwise(F.size("names")).cast("bigint").alias("n_licenses"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"))
