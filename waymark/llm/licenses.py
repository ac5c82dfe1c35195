"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance from directories.

Every line of a text that speaks of a licence is a header, and so is every run of adjacent lines around it, as headers
are wrapped; comment marks go first. A file whose name says so is a licence file, and counts as a whole as well.
Headers are compared with notices, whole files with notices and with whole licence texts: all become sparse TF-IDF
vectors over the templates' words and take the template of greatest cosine. A file without a licence of its own inherits that of the nearest ancestor directory with a licence file: its
directory's ancestors are joined, path by path, with the directories that have one.

Texts go to Python once; those of licence files, which few files are, a second time for what directories hand down.

Defined cases: a null text has no licence of its own but may inherit; a null path stands in no directory; of equal
cosines the template that is listed first wins, of several licence files in a directory the one of greatest cosine,
then of smallest path; equal rows, rows that repeat a doc_id and rows without one give a result each; other columns are
ignored, whatever their names; an empty table gives an empty result; texts of any length are scanned whole.
"""

from __future__ import annotations

import functools
import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, ship, spread_join, text_bytes

#: Well-known notices of licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-2.1", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work; CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: What a line must hold to be scanned, and file names of licences.
_SPEAKS = re.compile(rb"licen[cs]e|copyright|permission is|redistribution|public domain|creative commons", re.I)
_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice)[^/]*$"
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
LEAST_COSINE = 0.75
#: Licences with a whole text (see whole_text), and the least cosine to one of them: all of them are long legal prose.
WHOLE = ("Apache-2.0", "MIT", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-3-Clause", "BSD-2-Clause", "MPL-1.1", "MPL-2.0", "CC0-1.0", "Unlicense")
LEAST_WHOLE = 0.9
#: Lines and words of a header at most; a single line may be longer.
LINES, WORDS = 8, 80
_MARK = re.compile(rb"^[\s]*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|!+|<!--|\(\*|(?:REM|rem|dnl)\b)?[\s]*")


def _vectors(texts: list[str]) -> tuple[dict[str, float], list[dict[str, float]]]:
    bags = [Counter(_WORD.findall(t.lower())) for t in texts]
    in_bags = Counter(w for b in bags for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in in_bags.items()}
    return idf, [_normal({w: n * idf[w] for w, n in b.items()}) for b in bags]


def _normal(v: dict[str, float]) -> dict[str, float]:
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {w: x / norm for w, x in v.items()} if norm else {}


def whole_text(name: str) -> str:
    """The text of a licence, from this package's files; two are made from the text that they differ little from."""
    if name == "AGPL-3.0":
        return re.sub("(?i)gnu general public", "GNU Affero General Public", whole_text("GPL-3.0"))
    if name == "BSD-2-Clause":
        return re.sub(r"(?s)\n3\. .*?\n(?=THIS SOFTWARE)", "\n", whole_text("BSD-3-Clause"))
    return pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()


IDF, VECTORS = _vectors([t for _, t in TEMPLATES])
WHOLE_IDF, WHOLE_VECTORS = _vectors([whole_text(n) for n in WHOLE])


def _nearest(text: str, names: list[str], idf: dict[str, float], vectors: list[dict[str, float]]) -> tuple[str | None, float]:
    # Words outside the templates count as the rarest ones, so that a long line which mentions a licence isn't one.
    rarest = max(idf.values())
    v = _normal({w: n * idf.get(w, rarest) for w, n in Counter(_WORD.findall(text.lower())).items()})
    scores = [round(sum(x * t.get(w, 0.0) for w, x in v.items()), 9) for t in vectors]
    best = max(range(len(scores)), key=lambda i: (scores[i], -i))
    return (names[best], scores[best]) if scores[best] > 0 else (None, 0.0)


@functools.lru_cache(20_000)
def nearest_template(text: str) -> tuple[str | None, float]:
    """The licence of the notice of greatest cosine and that cosine."""
    return _nearest(text, [n for n, _ in TEMPLATES], IDF, VECTORS)


def nearest_whole(text: str) -> tuple[str | None, float]:
    """The licence whose whole text has the greatest cosine and that cosine."""
    return _nearest(text, list(WHOLE), WHOLE_IDF, WHOLE_VECTORS)


def headers(text: bytes) -> set[bytes]:
    """Lines that speak of a licence, and runs of adjacent lines that hold one; an empty line ends a run."""
    lines = [_MARK.sub(b"", x) for x in text.split(b"\n")]
    sizes = [len(x.split()) for x in lines]
    speaks = [bool(_SPEAKS.search(x)) for x in lines]
    found = {x for x, s in zip(lines, speaks, strict=True) if s}
    for at in {k for i, s in enumerate(speaks) if s for k in range(max(0, i - LINES + 1), i + 1)}:
        words, heard = 0, False
        for end in range(at, min(at + LINES, len(lines))):
            words, heard = words + sizes[end], heard or speaks[end]
            if not sizes[end] or words > WORDS:
                break
            if heard and end > at:
                found.add(b" ".join(lines[at : end + 1]))
    return found


def own_license(text: bytes | None, is_file: bool) -> tuple[str | None, float]:
    """Licence and cosine of a text's best header (or of the whole, if it is a licence file); None below LEAST_COSINE."""
    text = text or b""
    if not is_file and not _SPEAKS.search(text):
        return None, 0.0
    found = [nearest_template(x.decode("utf-8", "replace")) for x in sorted(headers(text) | ({text} if is_file else set()))]
    if is_file:
        whole = nearest_whole(text.decode("utf-8", "replace"))
        # A whole licence quotes notices, of other licences too, so its text says more than they do.
        if whole[1] >= LEAST_WHOLE:
            return whole
    best = max(found, key=lambda x: (x[1], x[0] or ""), default=(None, 0.0))
    return best if best[1] >= LEAST_COSINE else (None, best[1])


def _parent(path: Column) -> Column:
    """Directory of a path; the top is the empty string."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def scan(files: DataFrame) -> DataFrame:
    """For each row of files (doc_id, path, text): doc_id, path, own_license, cosine, license and inherited_from."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [own_license(t.as_py(), bool(f.as_py())) for t, f in zip(b.column(3), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "path", "is_file", "own_license", "cosine"])

    is_file = F.coalesce(F.col("path").rlike(_FILE), F.lit(False))
    plain = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), is_file.alias("is_file"), text_bytes().alias("text"))
    judged = lambda rows: rows.mapInArrow(run, "doc_id long, path string, is_file boolean, own_license string, cosine double").withColumn("dir", _parent(F.col("path")))
    given = judged(plain.filter("is_file")).filter("own_license is not null").groupBy("dir").agg(F.min_by("own_license", F.struct(-F.col("cosine"), F.col("path"))).alias("license")).withColumnRenamed("dir", "ancestor")
    # Each distinct directory looks up its ancestors once, however many files it holds.
    dirs = plain.select(_parent(F.col("path")).alias("dir")).groupBy("dir").agg(F.count("*").alias("files"))
    crowded = hot_keys(dirs.filter("dir is not null"), "dir", "files", plain.select("doc_id").count())
    parts = F.split("dir", "/")
    chain = F.concat(F.array(F.lit("")), F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    near = dirs.filter("dir is not null").select("dir", F.posexplode(chain).alias("depth", "ancestor")).join(given, "ancestor").groupBy("dir").agg(F.max_by(F.struct("license", "ancestor"), "depth").alias("near"))
    out = spread_join(judged(plain), near, ["dir"], F.xxhash64("path"), crowded, "left")
    return out.select("doc_id", "path", "own_license", "cosine", F.coalesce("own_license", "near.license").alias("license"), F.when(F.col("own_license").isNull(), F.col("near.ancestor")).alias("inherited_from"))
