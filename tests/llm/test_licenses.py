"""License scans: templates, whole texts, wrapped headers, cosines and inheritance against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from waymark.llm import common, licenses


def test_templates():
    assert licenses.own_license("x\nLicensed under the Apache License, Version 2.0.\ny".encode(), False)[0] == "Apache-2.0"
    assert licenses.own_license(b"Licensed under CC BY-NC 4.0.", False)[0] == "CC-BY-NC-4.0"
    assert licenses.own_license(b"a licence to kill many words in a long line about nothing", False)[0] is None
    assert licenses.own_license(None, True) == (None, 0.0)


def test_whole_licenses_and_wrapped_headers():
    for name in licenses.WHOLE:
        text = licenses.whole_text(name)
        # Under another owner's line, wrapped otherwise, and without its last tenth.
        for t in (text, "Copyright (c) 2020 A. Body\n\n" + text, " ".join(text.split()), text[: len(text) * 9 // 10]):
            assert licenses.own_license(t.encode(), True)[0] == name
    assert licenses.own_license(b"Our house has many rooms, and the terms of the lease are kept in the hall.\n" * 50, True)[0] is None
    gnu = "{m} This {w} is free software: you can redistribute it and/or modify\n{m} it under the terms of the GNU {n}General Public License as published by\n{m} the Free Software Foundation, either version {v} of the License, or\n{m} (at your option) any later version.\n"
    for mark in ("#", " *", "//", ""):
        for w, n, v, want in (("program", "", "3", "GPL-3.0"), ("program", "", "2", "GPL-2.0"), ("library", "Lesser ", "3", "LGPL-3.0"), ("program", "Lesser ", "3", "LGPL-3.0"), ("library", "Lesser ", "2.1", "LGPL-2.1"), ("program", "Affero ", "3", "AGPL-3.0")):
            assert licenses.own_license(("x = 1\n" + gnu.format(m=mark, w=w, n=n, v=v) + "\nimport os\n").encode(), False)[0] == want
        bsd = f"{mark} Redistribution and use in source and binary forms, with or without\n{mark} modification, are permitted provided that the following conditions\n{mark} are met:\n"
        assert licenses.own_license(bsd.encode(), False)[0] == "BSD-3-Clause"


def brute_cosine(text, templates):
    """(cosine, name) of each template, by the formulas of TF-IDF over the templates' words."""
    words = lambda t: re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower())
    bags = [Counter(words(t)) for _, t in templates]
    idf = lambda w: math.log((1 + len(bags)) / (1 + sum(w in b for b in bags))) + 1
    rarest = max(idf(w) for b in bags for w in b)
    mine = {w: n * (idf(w) if any(w in b for b in bags) else rarest) for w, n in Counter(words(text)).items()}
    out = []
    for (name, _), b in zip(templates, bags, strict=True):
        theirs = {w: n * idf(w) for w, n in b.items()}
        norm = math.sqrt(sum(x * x for x in mine.values()) * sum(x * x for x in theirs.values()))
        out.append((sum(x * theirs.get(w, 0) for w, x in mine.items()) / norm if norm else 0.0, name))
    return out


def test_cosines():
    rng = random.Random(5)
    pool = [w for _, t in licenses.TEMPLATES for w in t.split()] + ["house", "garden", "2.0", "Version"]
    texts = [t for _, t in licenses.TEMPLATES] + [" ".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(60)] + ["", "...", "nothing of that"]
    for t in texts:
        want = brute_cosine(t, licenses.TEMPLATES)
        name, cosine = licenses.nearest_template(t)
        best = max(c for c, _ in want)
        assert cosine == pytest.approx(best, abs=1e-8)
        assert name is None if best == 0 else name == next(n for c, n in want if c >= best - 1e-9)
    whole = [(n, licenses.whole_text(n)) for n in licenses.WHOLE]
    for n, t in whole:
        cut = t[: len(t) * 3 // 4]
        assert licenses.nearest_whole(cut)[1] == pytest.approx(max(brute_cosine(cut, whole))[0], abs=1e-8)


def brute_scan(rows):
    own = [licenses.own_license(None if t is None else t.encode(), bool(p and re.search(r"(?i)(?:^|/)(?:licen[cs]e|copying|notice)[^/]*$", p))) for _, p, t in rows]
    parent = lambda p: p.rpartition("/")[0]
    given = {}
    for (_, p, _), (name, cosine) in zip(rows, own, strict=True):
        if name and p and re.search(r"(?i)(?:^|/)(?:licen[cs]e|copying|notice)[^/]*$", p):
            given.setdefault(parent(p), []).append((-cosine, p, name))
    out = []
    for (i, p, _), (name, cosine) in zip(rows, own, strict=True):
        found, at = None, None if p is None else parent(p)
        while name is None and at is not None:
            if at in given:
                found = at
                break
            at = None if at == "" else parent(at)
        out.append((i, p, name, round(cosine, 9), name or (min(given[found])[2] if found is not None else None), found))
    return out


@pytest.mark.parametrize("salts", [2, 64])
def test_scan(spark, monkeypatch, salts):
    monkeypatch.setattr(common, "SALTS", salts)
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0"
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c/x.txt", "none"), (3, "a/b/COPYING.md", apache), (4, "a/y.txt", None), (5, "z/y.txt", ""), (6, None, mit), (7, "a/b/z.txt", "Licensed under CC BY-NC 4.0."), (8, "top.txt", "x"), (4, "a/y.txt", None), (None, "a/b/c/d/e", "no id")]
    rows += [(20, "q/NOTICE", apache), (21, "q/license.txt", mit), (22, "q/LICENSE", licenses.whole_text("MPL-2.0")), (23, "q/r/s", "text " * 50_000), (24, "r/LICENCE", "house and garden"), (25, "r/x", "y")]
    rows += [(100 + i, f"q/many/{i}.txt", "plain text") for i in range(80)] + [(300, "w//x", None), (301, "/abs", None), (302, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "'a' AS dir", "'b' AS license", "'c' AS near", "1 AS is_file", "2 AS ancestor", "3 AS salt", "4 AS files")
    got = [(r["doc_id"], r["path"], r["own_license"], round(r["cosine"], 9), r["license"], r["inherited_from"]) for r in licenses.scan(docs.repartition(3)).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(brute_scan(rows), key=key)
    by_id = {r[0]: r for r in got}
    assert by_id[2][4:] == ("Apache-2.0", "a/b") and by_id[4][4:] == ("MIT", "a") and by_id[150][4:] == ("MPL-2.0", "q") and by_id[8][4:] == (None, None)
    assert licenses.scan(docs.limit(0)).count() == 0
    assert {r["license"] for r in licenses.scan(docs.withColumn("text", F.lit(None).cast("string"))).collect()} == {None}
