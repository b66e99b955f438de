"""License rules without any gate: what a rule's regular expression matches is found."""

import random
import re
from re import _constants, _parser

from nimbora.llm import licenses

RULES = licenses.rules()
COMPILED = [re.compile(r["regex"], re.ASCII) for r in RULES]


def some(tree, rng):
    """A text that the parsed pattern matches."""
    out = ""
    for op, arg in tree:
        if op is _constants.LITERAL:
            out += chr(arg)
        elif op is _constants.IN:
            kind, value = arg[0]
            out += rng.choice(" \n") if kind is _constants.CATEGORY else chr(value) if kind is _constants.LITERAL else "2"
        elif op is _constants.BRANCH:
            out += some(rng.choice(arg[1]), rng)
        elif op is _constants.SUBPATTERN:
            out += some(arg[-1], rng)
        elif op is _constants.MAX_REPEAT:
            out += "".join(some(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
        else:
            assert op is _constants.ASSERT_NOT
    return out


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    hits = [(m.start(), m.end(), r["priority"], r["rule"], r["label"], r["weight"]) for r, c in zip(RULES, COMPILED, strict=True) for m in c.finditer(low)]
    hits.sort(key=lambda h: (h[0], -h[1], -h[2], h[3]))
    reach, kept = -1, []
    for h in hits:
        if h[1] > reach:
            if not kept or h[0] >= kept[-1][1]:
                kept.append(h)
            elif h[2] > kept[-1][2]:
                kept[-1] = h
        reach = max(reach, h[1])
    return kept


def test_every_rule_fires_as_without_gates(spark):
    rng = random.Random(5)
    texts = []
    for r, c in zip(RULES, COMPILED, strict=True):
        for _ in range(4):
            text = some(_parser.parse(r["regex"]), rng)
            assert c.search(text) and r["gate"] in text and r["mark"] in text, (r, text)
            texts.append(rng.choice(["", "é", "x. "]) + text.upper() + rng.choice(["", "é", " of 1999"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in licenses.scan_licenses(docs).collect():
        want = brute(texts[row["doc_id"]])
        assert want
        assert [tuple(d[k] for k in ("start", "end", "priority", "rule", "label", "weight")) for d in row["detections"]] == want


def test_named_cases(spark):
    cases = {
        "Common Development and Distribution License": "cddl",
        "Python Software Foundation License": "python",
        "the SIL Open Font License": "ofl",
        "SPDX-License-Identifier: CC-BY-4.0": "cc-by",
        "SPDX-License-Identifier: EPL-2.0": "epl",
        "SPDX-License-Identifier: BUSL-1.1": "busl",
        "GPLv3 licensed": "gpl",
        "under the LGPLv2.1": "lgpl",
        "under Apache2": "apache",
        "https://creativecommons.org/licenses/by-sa/4.0": "cc-by-sa",
        "Creative Commons Attribution ShareAlike 4.0 International License": "cc-by-sa",
        "CC BY-NC 4.0": "cc-by-nc",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for row in licenses.scan_licenses(docs).collect():
        assert {d["label"] for d in row["detections"]} == {list(cases.values())[row["doc_id"]]}, list(cases)[row["doc_id"]]
