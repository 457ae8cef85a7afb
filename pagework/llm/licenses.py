"""License scans by MinHash bands over text windows, in column expressions (operator 10).

Templates are cut into pieces of at most nine shingles.  A run of t shingles lies
wholly in one of the windows of 2s shingles that start every s shingles if
t <= s + 1, so pieces of 6 to 9 shingles look at windows of 16 that start every 8;
piece and window are then at least 3/8 alike and share one of 10 bands of one row
with probability 1 - (5/8)^10 = 0.991 or more, and longer templates have several
pieces.  Shorter pieces look at windows of one shingle, whose minimum is the
shingle itself, so they are always retrieved.  Window minima are made of block
minima: every shingle is visited once per band.

Templates of a shared band are retrieved and verified: the share of the
template's distinct shingles that the document holds must reach ``least``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 10
LEAST = 0.8
BLOCK = 8  # shingles whose minima are taken at once; a window is two blocks
PIECE = 9
SHORT = 5  # pieces up to this size look at single shingles
KEYS_AT_ONCE = 20_000  # band keys that one pass over the documents looks for

# Notices that are looked for by default: (template_id, text).
NOTICES = [
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit-line", "Released under the MIT License"),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0-line", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "template_id string, text string")


def shingles(text: Column) -> tuple[Column, Column, Column]:
    """Steps that are to be taken one select after the other: words, hashes of the
    column ``__words``, hashes of five hashes of the column ``__hashes``."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    hashes = F.transform("__words", lambda w: F.xxhash64(w))
    own = F.col("__hashes")
    starts = F.slice(own, 1, F.greatest(F.size(own) - (SHINGLE - 1), F.lit(0)))
    runs = F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(own, i + k) for k in range(1, SHINGLE)]))
    return words, hashes, runs


def _seeds() -> list[int]:
    return [int(np.uint64(xxhash.xxh64_intdigest(b"band %d" % b)).astype(np.int64)) for b in range(BANDS)]


def _with_shingles(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    words, hashes, runs = shingles(F.col(f"`{text}`"))
    kept = [F.col(f"`{c}`") for c in keep]
    df = df.select(*kept, words.alias("__words"))
    df = df.select(*kept, hashes.alias("__hashes"))
    return df.select(*kept, runs.alias("__shingles"))


def _pieces(shingle: list[int]) -> Iterator[list[int]]:
    """Overlapping pieces of at most PIECE shingles; the last one is a full one."""
    last = max(len(shingle) - PIECE, 0)
    for at in [*range(0, last, PIECE // 2), last]:
        yield shingle[at : at + PIECE]


def _minima(piece: list[int]) -> list[int]:
    """Band keys of a template piece (signed 64-bit, like the columns')."""
    return [min(x ^ seed for x in piece) for seed in _seeds()]


def _template_blocks(templates: DataFrame) -> Iterator[list[tuple[str, list[int], list[int]]]]:
    """(id, distinct shingles, keys) in blocks of at most KEYS_AT_ONCE keys."""
    named = templates.where(F.col("template_id").isNotNull() & F.col("text").isNotNull())
    block, size = [], 0
    for name, found in _with_shingles(named.select("template_id", "text"), "text", ["template_id"]).toLocalIterator():
        if not found:
            continue
        pieces = list(_pieces(found))
        short = [x for p in pieces if len(p) <= SHORT for x in p]
        keys = sorted({*short, *[key for p in pieces if len(p) > SHORT for key in _minima(p)]})
        if block and size + len(keys) > KEYS_AT_ONCE:
            yield block
            block, size = [], 0
        block.append((name, sorted(set(found)), keys))
        size += len(keys)
    if block:
        yield block


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")")


def _among(keys: list[int]):
    """Membership in a set that is built once, not per row."""
    return lambda x: x.isin(keys)


def scan(docs: DataFrame, templates: DataFrame, least: float = LEAST, text: str = "text") -> DataFrame:
    """Append ``licenses``: (template_id, containment) of every template that a
    window retrieves and of whose shingles the document holds ``least`` or more,
    sorted by template_id.

    Words are runs of letters and digits in lower case, shingles five of them.
    Null, empty and shorter texts hold nothing; templates that are null, have no
    id or fewer than five words are never found; templates that repeat are
    reported as often.  Rows are independent, repeated rows give repeated results,
    and a column ``licenses`` is replaced.  Templates are read in blocks of bounded
    size that travel with the plan.
    """
    names = [c for c in docs.columns if c != "licenses"]
    kept = [F.col(f"`{c}`") for c in names]
    kind = "array<struct<template_id: string, containment: double>>"
    own = docs.select(*kept) if text in names else docs
    out = _with_shingles(own, text, names)
    blocks = list(_template_blocks(templates))

    count = F.ceil(F.size("__shingles") / BLOCK).cast("int")
    every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    out = out.select(*kept, "__shingles", every.alias("__blocks"))

    def block_minima(seed: int) -> Column:
        def least_of(i: Column) -> Column:
            return F.least(*[F.get("__shingles", i * BLOCK + k).bitwiseXOR(F.lit(seed)) for k in range(BLOCK)])

        return F.transform("__blocks", least_of)

    out = out.select(*kept, "__shingles", *[block_minima(s).alias(f"__b{b}") for b, s in enumerate(_seeds())])

    def window_minima(band: str) -> Column:
        return F.transform(band, lambda x, i: F.least(x, F.get(band, i + 1)))

    minima = [window_minima(f"__b{b}") for b in range(BANDS)]
    out = out.select(*kept, "__shingles", F.concat("__shingles", *minima).alias("__minima"))
    hits = [F.expr("cast(array() as array<bigint>)")]
    for block in blocks:
        keys = sorted({key for _, _, own_keys in block for key in own_keys})
        hits.append(F.filter("__minima", _among(keys)))
    out = out.select(*kept, "__shingles", F.array_distinct(F.concat(*hits)).alias("__hits"))

    found = [F.expr(f"cast(array() as {kind})")]
    for block in blocks:
        for name, own_shingles, own_keys in block:
            share = F.size(F.array_intersect("__shingles", _longs(own_shingles))) / F.lit(float(len(own_shingles)))
            match = F.struct(F.lit(name).alias("template_id"), share.alias("containment"))
            # Containment is worked out only for templates that a band retrieves.
            held = F.filter(F.array(match), lambda m: m["containment"] >= least)
            found.append(F.when(F.arrays_overlap("__hits", _longs(own_keys)), held))
    empty = F.expr(f"cast(array() as {kind})")
    parts = [F.coalesce(f, empty) for f in found]
    result = F.when(F.size("__hits") > 0, F.array_sort(F.concat(*parts))).otherwise(empty)
    return out.select(*kept, result.alias("licenses"))


def report(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per document with the columns of the query."""
    found = scan(docs.select("doc_id", "text"), templates)
    return found.select(
        "doc_id", F.size("licenses").cast("bigint").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda m: m["template_id"]), ",").alias("licenses"),
        F.round(F.array_max(F.transform("licenses", lambda m: m["containment"])), 6).alias("containment"),
    )
