"""License scans against a plain Python version."""

import re

import pytest
from pyspark.sql import functions as F

from nimbora.llm import licenses

RULES = [(r, re.compile(r["regex"], re.ASCII)) for r in licenses.rules()]


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for i in range(len(words)):
        places += [(i, label) for phrase, label in licenses.BASE if words[i : i + len(phrase)] == phrase]
    hits = [(m.start(), m.end(), r["priority"], r["rule"], r["label"], r["weight"]) for r, c in RULES for m in c.finditer(low)]
    hits.sort(key=lambda h: (h[0], -h[1], -h[2], h[3]))
    reach, maximal = -1, []
    for h in hits:
        if h[1] > reach:
            maximal.append(h)
        reach = max(reach, h[1])
    kept = []
    for h in maximal:
        if kept and h[0] < kept[-1][1]:
            if h[2] > kept[-1][2]:
                kept[-1] = h
        else:
            kept.append(h)
    return len(words), places, kept, max([h[5] for h in kept] + [0.85] * bool(places) + [0.0])


TEXTS = [
    None,
    "",
    "MIT License",
    "Released under the MIT License. See the MIT License for more details.",
    "SPDX-License-Identifier: Apache-2.0\nLicensed under the Apache License, Version 2.0",
    "gnu General  Public\tLicense v3 and the GPLv3 licensed GNU Lesser General Public License",
    "mit-license apache-license general-public-license",
    "under the mit https://opensource.org/licenses/MIT creative commons attribution 4.0 license",
    "İté MIT É license BSD-3-Clause license, 3-clause BSD license " * 3,
    "mit license " * 400 + "x " * 20000,
    "the public domain into the public domain",
]


@pytest.mark.parametrize("extra", [False, True])
def test_matches_brute_force(spark, extra):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        docs = docs.withColumn("n_words", F.lit("clash")).withColumn("_words", F.lit(1)).withColumn("other", F.lit(2))
    out = licenses.scan_licenses(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        words, places, kept, score = brute(TEXTS[r["doc_id"]])
        assert r["n_words"] == words
        assert [tuple(p) for p in r["places"]] == places
        assert [(d["start"], d["end"], d["priority"], d["rule"], d["label"], d["weight"]) for d in r["detections"]] == kept
        assert r["license_score"] == score


def test_empty_table_and_rule_count(spark):
    assert len(licenses.rules()) >= 300
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_hits_take_time_in_proportion(spark):
    """100,000 hits in one text: every one is found, and ten times as many do not take a hundred times as long."""
    import time

    took = []
    for n in (10_000, 100_000):
        docs = spark.createDataFrame([(1, "mit license, " * n)], "doc_id long, text string")
        start = time.time()
        row = licenses.scan_licenses(docs).select("n_words", F.size("places").alias("n"), F.size("detections").alias("d"), F.array_min(F.transform("detections", lambda d: d["start"])).alias("a"), F.array_max(F.transform("detections", lambda d: d["end"])).alias("b")).first()
        took.append(time.time() - start)
        assert tuple(row) == (2 * n, n, n, 0, 13 * n - 2)
    assert took[1] < 40 * took[0] + 20


SENTENCES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "Redistribution and use in source and binary forms, with or without\n modification, are permitted provided that": "bsd",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published": "gpl",
    "You may not use this file except in compliance with the License.": "apache",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND': "warranty-disclaimer",
    "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT": "liability-disclaimer",
    "This is free and unencumbered software released into the public domain.": "unlicense",
}


def test_license_texts(spark):
    docs = spark.createDataFrame(list(enumerate(SENTENCES)), "doc_id long, text string")
    for r in licenses.scan_licenses(docs).collect():
        text = list(SENTENCES)[r["doc_id"]]
        assert {d["label"] for d in r["detections"]} == {SENTENCES[text]}
        assert [(d["start"], d["end"], d["priority"], d["rule"], d["label"], d["weight"]) for d in r["detections"]] == brute(text)[2]
