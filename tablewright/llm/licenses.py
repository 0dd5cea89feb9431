"""License scans: MinHash bands over overlapping word windows find templates, exact containment confirms them.

Everything runs in DataFrame expressions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SHINGLE = 5
#: tenths of a template's shingles that a window must hold
TENTHS = 8
#: chance that all bands of a window and a template it holds differ
MISS = 1e-6
#: rows of the band table that may be broadcast
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# fixed values: short notices and the opening paragraphs of common licenses, in their published wording
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


@dataclass(frozen=True)
class Template:
    number: int
    license: str
    shingles: tuple[str, ...]
    width: int
    stride: int
    bands: int
    anchors: tuple[str, ...]


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))


def read_templates(listed: Sequence[tuple[str, str]]) -> list[Template]:
    """Windows, bands and anchor words of each template; one of fewer than five words is refused.

    A window is a quarter longer than its template, plus the stride, so that every stretch of the first length lies in
    some window. ``bands`` is what the least similarity of a window that holds the template needs to reach ``MISS``. A
    window that holds it lacks at most the other tenths of its shingles; the anchors are words that more shingles than
    that contain, so such a window has an anchor word.
    """
    out = []
    for number, (name, text) in enumerate(listed):
        words = words_of(text)
        if len(words) < SHINGLE:
            raise ValueError(f"template {name!r} has fewer than {SHINGLE} words")
        all_shingles = [" ".join(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]
        shingles = tuple(dict.fromkeys(all_shingles))
        width = len(words) + len(words) // 4
        stride = max(1, width // 8)
        width += stride - 1
        least = -(-TENTHS * len(shingles) // 10)
        similarity = least / (width - SHINGLE + 1 + len(shingles) - least)
        bands = max(4, math.ceil(math.log(MISS) / math.log(1 - similarity))) if similarity < 1 else 4
        anchors: list[str] = []
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            anchors.append(w)
            if sum(any(a in s.split() for a in anchors) for s in shingles) > len(shingles) - least:
                break
        out.append(Template(number, name, shingles, width, stride, bands, tuple(anchors)))
    return out


def _signature(shingles: Column, bands: Column) -> Column:
    """Per band the least hash of the shingles under the band's own hash function."""
    return F.transform(bands, lambda k: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, k))))


def _windows(words: Column, t: Column) -> Column:
    """Windows on a template's grid that hold one of its anchor words, as ``(start, words)``."""
    places = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(t["anchors"], w), i)), lambda i: i.isNotNull())
    first = lambda p: F.greatest(F.lit(0), F.ceil((p - t["width"] + 1) / t["stride"])).cast("int")
    starts = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(
        first(p), F.floor(p / t["stride"]).cast("int")))))
    return F.transform(starts, lambda k: F.struct((k * t["stride"]).alias("start"),
                                                  F.slice(words, k * t["stride"] + 1, t["width"]).alias("words")))


def license_matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(id, license, template, containment, start)`` for every template a document holds.

    Words are ``[a-z0-9]+`` after lower-casing A-Z, shingles five of them. A document holds a template when a window
    has at least eight tenths of its distinct shingles; ``containment`` is the best window's share and ``start`` the
    first word of the first such window. Texts without any anchor word cannot hold a template and are not cut into
    windows. Null and empty texts match nothing; rows of one id, null included, count as one document; no templates or
    no documents give no rows; other columns are not read.
    """
    known = read_templates(templates)
    spark = docs.sparkSession
    if not known:
        return docs.limit(0).select(F.col(id_col), F.expr("'' license"), F.expr("0 template"), F.expr("0D containment"), F.expr("0 start"))
    lowered = F.lower(F.col(text_col))
    anchors = sorted({a for t in known for a in t.anchors})
    any_anchor = F.lit(False)
    for a in anchors:
        any_anchor = any_anchor | F.contains(F.col("lowered"), F.lit(a))
    cut = F.array_remove(F.split(F.translate("text", UPPER, LOWER), "[^a-z0-9]+"), "")
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lowered.alias("lowered"))
             .where(any_anchor).select("id", cut.alias("words")))
    # windows are cut once for templates of equal shape
    shapes: dict[tuple[int, int], set[str]] = {}
    for t in known:
        shapes.setdefault((t.width, t.stride), set()).update(t.anchors)
    bands = max(t.bands for t in known)
    shape = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(s).alias("stride"),
                               F.array(*[F.lit(a) for a in sorted(x)]).alias("anchors")) for (w, s), x in sorted(shapes.items())])
    windows = (texts.select("id", "words", F.explode(shape).alias("t"))
               .select("id", F.col("t.width").alias("width"), F.explode(_windows(F.col("words"), F.col("t"))).alias("w"))
               .where(F.size("w.words") >= SHINGLE)
               .select("id", "width", F.col("w.start").alias("start"), F.array_distinct(F.transform(
                   F.sequence(F.lit(1), F.size("w.words") - SHINGLE + 1),
                   lambda i: F.array_join(F.slice("w.words", i, SHINGLE), " "))).alias("shingles")))
    listed = F.sequence(F.lit(0), F.lit(bands - 1))
    banded = windows.select("*", F.posexplode(_signature(F.col("shingles"), listed)).alias("band", "value"))
    table = spark.createDataFrame([(t.number, t.license, t.width, t.bands, list(t.shingles)) for t in known],
                                  "template int, license string, width int, bands int, wanted array<string>")
    signed = (table.select("template", "width", "bands", F.posexplode(_signature(F.col("wanted"), listed)).alias("band", "value"))
              .where(F.col("band") < F.col("bands")).drop("bands"))
    small = len(known) * bands <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda x: x)
    candidates = banded.join(hint(signed), ["width", "band", "value"]).join(hint(table.drop("width", "bands")), "template")
    held = F.size(F.array_intersect("shingles", "wanted"))
    return (candidates.withColumn("held", held).where(F.col("held") * 10 >= F.size("wanted") * TENTHS)
            .groupBy("id", "license", "template").agg(F.max(F.struct(
                (F.col("held") / F.size("wanted")).alias("containment"), (-F.col("start")).alias("start"))).alias("best"))
            .select(F.col("id").alias(id_col), "license", "template", F.col("best.containment").alias("containment"),
                    (-F.col("best.start")).alias("start")))
