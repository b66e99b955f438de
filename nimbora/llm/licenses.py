"""License scans: ordered signature rules, gated by keywords, with overlaps resolved.

A table of rules is made from license families (below) and phrase forms, and from sentences of license texts: each rule is a
regular expression over the text with A-Z lower-cased, with a gate, a mark, a priority and a weight. Gate and mark are literals that every match of the rule
contains, so a rule is tried only where the text contains both, as words or within them. All matches, as character
intervals, are resolved in two ordered passes: an interval that lies inside another one is suppressed (of equal intervals the one of higher priority
stays), then of two that overlap in part the one of higher priority stays, the earlier one on ties.

Everything is column expressions of one scan: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.llm.common import LOWER, UPPER, whole_text

#: License families as (label, marks, title pattern, short name pattern, SPDX pattern, address pattern); the
#: marks are literals without which the title, the short name and the address cannot match.
FAMILIES = [
    ("mit", ("license", "mit", "opensource"), r"mit\s+license", r"mit", r"mit(?:-0)?", r"opensource\.org/licenses/mit"),
    ("apache", ("apache", "apache", "apache"), r"apache\s+(?:software\s+)?license(?:,?\s+version\s+[0-9.]+)?", r"apache(?:\s*|-)2(?:\.0)?", r"apache-[0-9.]+", r"apache\.org/licenses"),
    ("gpl", ("general", "general", "gnu"), r"(?:gnu\s+)?general\s+public\s+license(?:,?\s+(?:version\s+|v)[0-9.]+)?", r"gnu\s+general\s+public", r"gpl-[0-9.]+(?:-only|-or-later)?", r"gnu\.org/licenses/gpl"),
    ("gpl", ("gpl", "gpl", "gnu"), r"gnu\s+gpl(?:\s*v?[0-9.]+)?", r"gplv?[0-9.]*", r"gpl-[0-9.]+\+?", r"gnu\.org/copyleft/gpl"),
    ("lgpl", ("lesser", "lesser", "gnu"), r"(?:gnu\s+)?lesser\s+general\s+public\s+license", r"gnu\s+lesser\s+general\s+public", r"lgpl-[0-9.]+(?:-only|-or-later)?", r"gnu\.org/licenses/lgpl"),
    ("lgpl", ("lgpl", "lgpl", "gnu"), r"gnu\s+lgpl(?:\s*v?[0-9.]+)?", r"lgplv?[0-9.]*", r"lgpl-[0-9.]+\+?", r"gnu\.org/copyleft/lesser"),
    ("agpl", ("affero", "affero", "gnu"), r"(?:gnu\s+)?affero\s+general\s+public\s+license", r"gnu\s+affero\s+general\s+public", r"agpl-[0-9.]+(?:-only|-or-later)?", r"gnu\.org/licenses/agpl"),
    ("agpl", ("agpl", "agpl", "gnu"), r"gnu\s+agpl(?:\s*v?[0-9.]+)?", r"agplv?[0-9.]*", r"agpl-[0-9.]+\+?", r"gnu\.org/licenses/agpl"),
    ("gfdl", ("documentation", "gfdl", "gnu"), r"gnu\s+free\s+documentation\s+license", r"gfdl", r"gfdl-[0-9.]+", r"gnu\.org/licenses/fdl"),
    ("bsd", ("bsd", "bsd", "opensource"), r"(?:[234]-clause\s+|new\s+|simplified\s+|modified\s+)?bsd\s+license", r"bsd(?:-[234]-clause)?", r"bsd-[0-4]-clause", r"opensource\.org/licenses/bsd"),
    ("0bsd", ("bsd", "0bsd", "0bsd"), r"zero-clause\s+bsd\s+license", r"0bsd", r"0bsd", r"opensource\.org/licenses/0bsd"),
    ("mpl", ("mozilla", "mozilla", "mozilla"), r"mozilla\s+public\s+license(?:,?\s+(?:version\s+|v\.?\s*)[0-9.]+)?", r"mozilla\s+public", r"mpl-[0-9.]+", r"mozilla\.org/(?:en-us/)?mpl"),
    ("mpl", ("mpl", "mpl", "opensource"), r"mpl\s*(?:version\s+)?[0-9.]+", r"mpl", r"mpl-[0-9.]+", r"opensource\.org/licenses/mpl"),
    ("epl", ("eclipse", "eclipse", "eclipse"), r"eclipse\s+public\s+license(?:\s*-?\s*v?\s*[0-9.]+)?", r"eclipse\s+public", r"epl-[0-9.]+", r"eclipse\.org/legal/epl"),
    ("edl", ("eclipse", "eclipse", "eclipse"), r"eclipse\s+distribution\s+license", r"eclipse\s+distribution", r"edl-[0-9.]+", r"eclipse\.org/org/documents/edl"),
    ("cddl", ("distribution", "cddl", "cddl"), r"common\s+development\s+and\s+distribution\s+license", r"cddl", r"cddl-[0-9.]+", r"opensource\.org/licenses/cddl"),
    ("cpl", ("common", "cpl", "opensource"), r"common\s+public\s+license", r"cpl", r"cpl-[0-9.]+", r"opensource\.org/licenses/cpl"),
    ("isc", ("isc", "isc", "opensource"), r"isc\s+license", r"isc", r"isc", r"opensource\.org/licenses/isc"),
    ("zlib", ("zlib", "zlib", "zlib"), r"zlib(?:/libpng)?\s+license", r"zlib", r"zlib", r"zlib\.net/zlib_license"),
    ("libpng", ("libpng", "libpng", "libpng"), r"libpng\s+license", r"libpng", r"libpng(?:-2\.0)?", r"libpng\.org/pub/png/src/libpng-license"),
    ("boost", ("boost", "boost", "boost"), r"boost\s+software\s+license", r"boost", r"bsl-[0-9.]+", r"boost\.org/license"),
    ("unlicense", ("unlicense", "unlicense", "unlicense"), r"the\s+unlicense", r"unlicense", r"unlicense", r"unlicense\.org"),
    ("wtfpl", ("fuck", "wtfpl", "wtfpl"), r"do\s+what\s+the\s+fuck\s+you\s+want\s+to\s+public\s+license", r"wtfpl", r"wtfpl", r"wtfpl\.net"),
    ("cc0", ("cc0", "cc0", "creativecommons"), r"cc0\s+[0-9.]+\s+universal", r"cc0", r"cc0-[0-9.]+", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", ("attribution", "attribution", "creativecommons"), r"creative\s+commons\s+attribution(?:\s+[0-9.]+)?(?:\s+international)?\s+license", r"creative\s+commons\s+attribution", r"cc-by-[0-9.]+", r"creativecommons\.org/licenses/by/"),
    ("cc-by", ("cc", "cc", "creativecommons"), r"cc[\s-]+by[\s-]+[0-9.]+(?:\s+international)?(?:\s+licen[cs]e)?", r"cc[\s-]+by", r"cc-by-[0-9.]+", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", ("attribution", "attribution", "creativecommons"), r"creative\s+commons\s+attribution(?:-|\s+)share[\s-]?alike(?:\s+[0-9.]+)?(?:\s+international)?\s+license", r"creative\s+commons\s+attribution(?:-|\s+)share[\s-]?alike", r"cc-by-sa-[0-9.]+", r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-sa", ("cc", "cc", "creativecommons"), r"cc[\s-]+by[\s-]+sa[\s-]+[0-9.]+(?:\s+international)?(?:\s+licen[cs]e)?", r"cc[\s-]+by[\s-]+sa", r"cc-by-sa-[0-9.]+", r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-nc", ("attribution", "attribution", "creativecommons"), r"creative\s+commons\s+attribution(?:-|\s+)non-?commercial(?:\s+[0-9.]+)?(?:\s+international)?\s+license", r"creative\s+commons\s+attribution(?:-|\s+)non-?commercial", r"cc-by-nc-[0-9.]+", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nc", ("cc", "cc", "creativecommons"), r"cc[\s-]+by[\s-]+nc[\s-]+[0-9.]+(?:\s+international)?(?:\s+licen[cs]e)?", r"cc[\s-]+by[\s-]+nc", r"cc-by-nc-[0-9.]+", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", ("attribution", "attribution", "creativecommons"), r"creative\s+commons\s+attribution(?:-|\s+)no[\s-]?deriv(?:ative)?s(?:\s+[0-9.]+)?\s+license", r"creative\s+commons\s+attribution(?:-|\s+)no[\s-]?deriv(?:ative)?s", r"cc-by-nd-[0-9.]+", r"creativecommons\.org/licenses/by-nd/"),
    ("cc-by-nd", ("cc", "cc", "creativecommons"), r"cc[\s-]+by[\s-]+nd[\s-]+[0-9.]+(?:\s+international)?(?:\s+licen[cs]e)?", r"cc[\s-]+by[\s-]+nd", r"cc-by-nd-[0-9.]+", r"creativecommons\.org/licenses/by-nd/"),
    ("artistic", ("artistic", "artistic", "opensource"), r"artistic\s+license(?:\s+[0-9.]+)?", r"artistic", r"artistic-[0-9.]+", r"opensource\.org/licenses/artistic"),
    ("python", ("python", "psf", "python"), r"python\s+software\s+foundation\s+license", r"psf", r"psf-[0-9.]+", r"python\.org/psf/license"),
    ("php", ("php", "php", "php"), r"php\s+license", r"php", r"php-[0-9.]+", r"php\.net/license"),
    ("postgresql", ("postgresql", "postgresql", "postgresql"), r"postgresql\s+license", r"postgresql", r"postgresql", r"postgresql\.org/about/licen[cs]e"),
    ("ruby", ("ruby", "ruby", "ruby"), r"ruby(?:'s)?\s+license", r"ruby", r"ruby", r"ruby-lang\.org/en/about/license"),
    ("openssl", ("openssl", "openssl", "openssl"), r"openssl\s+license", r"openssl", r"openssl", r"openssl\.org/source/license"),
    ("ofl", ("font", "ofl", "scripts"), r"sil\s+open\s+font\s+license", r"ofl", r"ofl-[0-9.]+", r"scripts\.sil\.org/ofl"),
    ("eupl", ("european", "eupl", "joinup"), r"european\s+union\s+public\s+licen[cs]e", r"eupl", r"eupl-[0-9.]+", r"joinup\.ec\.europa\.eu"),
    ("osl", ("software", "osl", "opensource"), r"open\s+software\s+license", r"osl", r"osl-[0-9.]+", r"opensource\.org/licenses/osl"),
    ("afl", ("academic", "afl", "opensource"), r"academic\s+free\s+license", r"afl", r"afl-[0-9.]+", r"opensource\.org/licenses/afl"),
    ("ms-pl", ("microsoft", "ms-pl", "opensource"), r"microsoft\s+public\s+license", r"ms-pl", r"ms-pl", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", ("microsoft", "ms-rl", "opensource"), r"microsoft\s+reciprocal\s+license", r"ms-rl", r"ms-rl", r"opensource\.org/licenses/ms-rl"),
    ("upl", ("permissive", "upl", "opensource"), r"universal\s+permissive\s+license", r"upl", r"upl-[0-9.]+", r"opensource\.org/licenses/upl"),
    ("ncsa", ("ncsa", "ncsa", "opensource"), r"university\s+of\s+illinois/ncsa\s+open\s+source\s+license", r"ncsa", r"ncsa", r"opensource\.org/licenses/ncsa"),
    ("odbl", ("database", "odbl", "opendatacommons"), r"open\s+database\s+license", r"odbl", r"odbl-[0-9.]+", r"opendatacommons\.org/licenses/odbl"),
    ("sspl", ("server", "sspl", "mongodb"), r"server\s+side\s+public\s+license", r"sspl", r"sspl-[0-9.]+", r"mongodb\.com/licensing/server-side-public-license"),
    ("busl", ("business", "busl", "mariadb"), r"business\s+source\s+license", r"busl", r"busl-[0-9.]+", r"mariadb\.com/bsl"),
    ("elastic", ("elastic", "elastic", "elastic"), r"elastic\s+license(?:\s+[0-9.]+)?", r"elastic", r"elastic-[0-9.]+", r"elastic\.co/licensing"),
    ("public-domain", ("domain", "domain", "creativecommons"), r"(?:in|into|to)\s+the\s+public\s+domain", r"public\s+domain", r"public-domain", r"creativecommons\.org/publicdomain/mark"),
]

#: Phrase forms as (name, priority, weight, gate, what the mark is of, pattern); {t} title, {s} short name,
#: {x} SPDX name, {u} address. The gate is a literal of the pattern, the mark ("") where the pattern has no other.
FORMS = [
    ("tag", 100, 1.0, "spdx", "", r"spdx-license-identifier:\s*(?:{x})"),
    ("grant", 90, 0.95, "under", "t", r"(?:licensed|released|distributed|available|provided|published)\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:{t})"),
    ("address", 85, 0.9, "", "u", r"https?://(?:www\.)?(?:{u})"),
    ("title", 80, 0.85, "", "t", r"(?<![0-9a-z])(?:{t})(?![0-9a-z])"),
    ("reference", 70, 0.8, "details", "t", r"see\s+(?:the\s+)?(?:{t})\s+for\s+(?:more\s+)?details"),
    ("short grant", 65, 0.7, "under", "s", r"under\s+(?:the\s+)?(?:{s})(?:\s+licen[cs]e)?(?![0-9a-z])"),
    ("short license", 60, 0.6, "license", "s", r"(?<![0-9a-z])(?:{s})[\s-]+license(?![0-9a-z])"),
    ("short licensed", 60, 0.6, "licensed", "s", r"(?<![0-9a-z])(?:{s})[\s-]+licensed(?![0-9a-z])"),
    ("short licence", 60, 0.6, "licence", "s", r"(?<![0-9a-z])(?:{s})[\s-]+licence(?![0-9a-z])"),
    ("short licenced", 60, 0.6, "licenced", "s", r"(?<![0-9a-z])(?:{s})[\s-]+licenced(?![0-9a-z])"),
]

#: Sentences of license texts as (label, priority, weight, gate, mark, pattern).
SENTENCES = [
    ("mit", 75, 0.9, "permission", "charge", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person\s+obtaining\s+a\s+copy"),
    ("boost", 75, 0.9, "permission", "organization", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person\s+or\s+organization\s+obtaining\s+a\s+copy"),
    ("isc", 75, 0.9, "permission", "fee", r"permission\s+to\s+use,\s+copy,\s+modify,?\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee"),
    ("bsd", 75, 0.9, "redistribution", "permitted", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,?\s+with\s+or\s+without\s+modification,?\s+(?:are|is)\s+permitted"),
    ("bsd", 74, 0.8, "redistributions", "copyright", r"redistributions\s+(?:of\s+source\s+code|in\s+binary\s+form)\s+must\s+(?:retain|reproduce)\s+the\s+above\s+copyright\s+notice"),
    ("bsd", 74, 0.8, "endorse", "software", r"to\s+endorse\s+or\s+promote\s+products\s+derived\s+from\s+this\s+software"),
    ("gpl", 92, 0.95, "redistribute", "general", r"you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+general\s+public\s+license"),
    ("lgpl", 92, 0.95, "redistribute", "lesser", r"you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+lesser\s+general\s+public\s+license"),
    ("agpl", 92, 0.95, "redistribute", "affero", r"you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+affero\s+general\s+public\s+license"),
    ("apache", 75, 0.8, "compliance", "license", r"you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+license"),
    ("mpl", 92, 0.95, "mozilla", "source", r"this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public\s+license"),
    ("zlib", 74, 0.8, "altered", "marked", r"altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked\s+as\s+such"),
    ("unlicense", 92, 0.95, "unencumbered", "domain", r"this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain"),
    ("cc0", 74, 0.9, "waives", "copyright", r"waives\s+all\s+(?:of\s+)?(?:his\s+or\s+her\s+|their\s+)?copyright\s+and\s+related"),
    ("warranty-disclaimer", 50, 0.5, "provided", "warrant", r"software\s+is\s+provided\s+(?:by\s+the\s+(?:copyright\s+holders?|authors?|regents)(?:\s+and\s+contributors)?\s+)?[\"'`]{0,2}as\s+is[\"'`]{0,2},?\s+(?:and\s+any\s+express\s+or\s+implied\s+warranties|without\s+(?:any\s+)?(?:express\s+or\s+implied\s+)?warranty)"),
    ("warranty-disclaimer", 50, 0.5, "warranty", "fitness", r"implied\s+warranty\s+of\s+merchantability\s+or\s+fitness\s+for\s+a\s+particular\s+purpose"),
    ("liability-disclaimer", 50, 0.5, "liable", "event", r"in\s+no\s+event\s+shall\s+the\s+(?:authors?|regents|copyright\s+(?:holders?|owners?))(?:\s+(?:or|and)\s+(?:copyright\s+holders|contributors))?\s+be\s+liable\s+for\s+any\s+(?:claim|direct|damages)"),
]

#: The base phrases, as their words, and their labels.
BASE = [(["mit", "license"], "mit"), (["apache", "license"], "apache"), (["general", "public", "license"], "gpl")]

#: What stands between words of lower-cased text; words are runs of letters, digits and characters beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def rules() -> list[dict]:
    """The ordered rule table: one rule for each family and phrase form, then those of license texts."""
    made = []
    for label, marks, title, short, tag, address in FAMILIES:
        for form, priority, weight, gate, part, pattern in FORMS:
            regex = pattern.format(t=title, s=short, x=tag, u=address)
            mark = {"t": marks[0], "s": marks[1], "u": marks[2]}.get(part, gate)
            made.append({"rule": len(made), "label": label, "gate": gate or mark, "mark": mark, "form": form, "priority": priority, "weight": weight, "regex": regex})
    for label, priority, weight, gate, mark, regex in SENTENCES:
        made.append({"rule": len(made), "label": label, "gate": gate, "mark": mark, "form": "text", "priority": priority, "weight": weight, "regex": regex})
    return made


def _literal(rows: list[dict], schema: str) -> Column:
    """A constant array of structs; the optimizer folds it into one literal."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")


HIT = "struct<start:int,end:int,priority:int,rule:int,label:string,weight:double>"


def _named(value: Column, use) -> Column:
    """``use`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), use)[0]


def _folded(items: Column, state: Column, state_kind: str, step) -> Column:
    """Folds ``items`` in order: a struct of the last ``state`` and ``kept``, the hits that were kept.

    ``step`` takes (state, item) and gives the next state and an array of the hits that the item adds. A fold copies what it
    has gathered at every step, so one list for all would take time with the square of their number. Items are cut into
    pieces, the cube root of their number in size; a first pass carries only the state from piece to piece, a
    second one folds every piece from its state.
    """
    size = F.greatest(F.lit(16), F.ceil(F.cbrt(F.size(items))).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / size).cast("int")), lambda k: F.slice(items, k * size + 1, size))

    def carried(acc: Column, part: Column) -> Column:
        after = F.aggregate(part, acc["state"], lambda at, item: step(at, item)[0])
        return F.struct(after.alias("state"), F.concat(acc["starts"], F.array(acc["state"])).alias("starts"))

    def one(acc: Column, item: Column) -> Column:
        after, added = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["kept"], added).alias("kept"))

    def pieces(cut: Column) -> Column:
        zero = F.struct(state.alias("state"), F.array().cast(f"array<{state_kind}>").alias("starts"))
        return _named(F.aggregate(cut, zero, carried), lambda run: F.struct(run["state"].alias("state"), F.flatten(F.transform(cut, lambda part, k: F.aggregate(part, F.struct(F.get(run["starts"], k).alias("state"), _no_hits().alias("kept")), one, lambda acc: acc["kept"]))).alias("kept")))

    return _named(parts, pieces)


def _matches(text: Column, rule: Column) -> Column:
    """All matches of one rule as intervals of characters."""
    between = F.split(text, rule["regex"], -1)
    found = F.regexp_extract_all(text, rule["regex"], F.lit(0))

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        start = at + pair["gap"]
        end = start + pair["hit"]
        hit = F.struct(start.alias("start"), end.alias("end"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["weight"].alias("weight"))
        return end, F.array(hit)

    def placed(hits: Column, gaps: Column) -> Column:
        pairs = F.transform(hits, lambda hit, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(hit).alias("hit")))
        return _named(pairs, lambda p: _folded(p, F.lit(0), "int", step)["kept"])

    return _named(F.struct(found.alias("hits"), between.alias("gaps")), lambda r: F.when(F.size(r["hits"]) > 0, placed(r["hits"], r["gaps"])).otherwise(_no_hits()))


def _place(word: Column, i: Column) -> Column:
    """The base phrase that starts at word ``i``, if any."""
    found = F.lit(None)
    for phrase, label in BASE:
        here = word == phrase[0]
        for k, expected in enumerate(phrase[1:], 1):
            here = here & (F.get("_words", i + k) == expected)
        found = F.when(here, F.struct(i.alias("word"), F.lit(label).alias("label"))).otherwise(found)
    return found


def _no_hits() -> Column:
    return F.array().cast(f"array<{HIT}>")


def _resolved(hits: Column) -> Column:
    """Suppresses contained intervals, then resolves partial overlaps by priority; hits come in any order."""
    keyed = F.transform(hits, lambda h: F.struct(h["start"], (-h["end"]).alias("back"), (-h["priority"]).alias("low"), h["rule"], h.alias("hit")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["hit"])

    def outer(reach: Column, h: Column) -> tuple[Column, Column]:
        return F.greatest(reach, h["end"]), F.when(h["end"] <= reach, _no_hits()).otherwise(F.array(h))

    def apart(last: Column, h: Column) -> tuple[Column, Column]:
        """``last`` holds the interval that may still give way, if any; it is kept once one begins behind it."""
        clash = (F.size(last) > 0) & (h["start"] < F.get(last, F.lit(0))["end"])
        weaker = clash & (h["priority"] <= F.get(last, F.lit(0))["priority"])
        return F.when(weaker, last).otherwise(F.array(h)), F.when(clash, _no_hits()).otherwise(last)

    maximal = _named(ordered, lambda x: _folded(x, F.lit(-1), "int", outer)["kept"])
    kept = _named(maximal, lambda x: _folded(x, _no_hits(), f"array<{HIT}>", apart))
    return _named(kept, lambda r: F.concat(r["kept"], r["state"]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Adds to each row of ``docs`` (doc_id, text, ...) what its whole text says of licenses.

    Adds ``n_words`` (words), ``places`` (array of (word, label): where a base phrase starts, words counted from 0),
    ``detections`` (array of (start, end, priority, rule, label, weight): the resolved rule matches as character
    intervals of the lower-cased text) and ``license_score`` (the largest weight among detections, at least 0.85
    where a base phrase occurs, else 0).

    Null and empty texts have no words, places or detections and score 0. Repeated rows are scanned each by itself,
    so ties cannot arise between rows; an empty table gives an empty result. Columns of ``docs`` with one of the
    added names are replaced; other columns pass through untouched. A text of any length is scanned whole.
    """
    clear = docs.drop("n_words", "places", "detections", "license_score", "_lower", "_words", "_gates")
    table = rules()
    gates = sorted({r[k] for r in table for k in ("gate", "mark")} | {"license"})
    # rules by mark, and those of a mark by gate, so that most are passed over together
    by_mark: dict[str, dict[str, list[dict]]] = {}
    for r in table:
        by_mark.setdefault(r["mark"], {}).setdefault(r["gate"], []).append({k: r[k] for k in ("regex", "label", "priority", "rule", "weight")})
    marks = [{"mark": m, "gates": [{"gate": g, "rules": rules_} for g, rules_ in inner.items()]} for m, inner in by_mark.items()]
    mark_list = _literal(marks, "mark:string,gates:array<struct<gate:string,rules:array<struct<regex:string,label:string,priority:int,rule:int,weight:double>>>>")

    words = clear.withColumn("_lower", F.translate(whole_text(), UPPER, LOWER)).withColumn("_words", F.array_remove(F.split("_lower", BETWEEN), ""))
    gated = words.withColumn("_gates", F.filter(F.split(F.lit(" ".join(gates)), " "), lambda g: F.contains(F.col("_lower"), g)))

    none = F.array().cast("array<struct<word:int,label:string>>")
    spots = F.transform("_words", lambda w, i: _place(w, i))
    places = F.when(F.array_contains("_gates", "license"), F.array_compact(spots)).otherwise(none)
    def passed(rows: Column, name: str, inner: str) -> Column:
        return F.flatten(F.transform(F.filter(rows, lambda r: F.array_contains("_gates", r[name])), lambda r: r[inner]))

    tried = passed(passed(mark_list, "mark", "gates"), "gate", "rules")
    hits = F.flatten(F.transform(tried, lambda r: _matches(F.col("_lower"), r)))
    found = gated.select(
        *[F.col(f"`{c}`") for c in clear.columns],
        F.size("_words").cast("long").alias("n_words"),
        places.alias("places"),
        F.when(F.size("_gates") > 0, _named(hits, lambda h: F.when(F.size(h) > 0, _resolved(h)).otherwise(_no_hits()))).otherwise(_no_hits()).alias("detections"),
    )
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0))
    return found.withColumn("license_score", F.when(F.size("places") > 0, F.greatest(best, F.lit(0.85))).otherwise(best))
