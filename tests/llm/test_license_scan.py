import re

import pytest
from cases import documents

from ticketlens.llm import license_scan
from ticketlens.llm.license_scan import GAP, PHRASES, RUN, TEMPLATES, Template

MIT = next(t.text for t in TEMPLATES if t.label == "mit" and len(t.text) > 100)
APACHE = next(t.text for t in TEMPLATES if t.label == "apache-2.0" and len(t.text) > 100)


def _words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def _spans(text, templates=TEMPLATES):
    """All places against all places, in plain Python."""
    words, out = _words(text), set()
    for template in templates:
        known = _words(template.text)
        votes = {(p - t, t) for t in range(len(known) - RUN + 1) for p in range(len(words) - RUN + 1) if words[p : p + RUN] == known[t : t + RUN]}
        groups, last = [], None
        for d in sorted({d for d, _ in votes}):
            if last is None or d - last > GAP:
                groups.append(set())
            groups[-1].add(d)
            last = d
        for group in groups:
            place = {}
            for d, t in sorted(votes):
                if d in group:
                    for k in range(RUN):
                        place.setdefault(t + k, t + k + d)
            first, end = min(place.values()), max(place.values())
            similarity = len(place) / max(len(known), end - first + 1)
            if similarity >= template.least:
                out.add((first, end, template.label, similarity))
    return sorted(out)


def _expected(text):
    words = _words(text)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    spans = _spans(text)
    starts = [i for i, _ in places]
    base = sorted({label for _, label in places})
    return (
        len(words),
        len(places),
        min(starts, default=None),
        max(starts, default=None),
        base,
        sorted({*base, *(s[2] for s in spans)}),
        spans,
        1.0 if places else max((s[3] for s in spans), default=0.0),
    )


def _tuple(r):
    return (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], [tuple(s) for s in r["spans"]], r["score"])


def _changed(text, *, swap=(), drop=(), put=()):
    words = text.split(" ")
    for i in swap:
        words[i] = "other"
    return " ".join(" ".join([w] + ["more"] * (i in put)) for i, w in enumerate(words) if i not in drop)


TEXTS = [
    f"Code. {MIT} The end.",
    "x " + _changed(MIT, swap=(20, 50)) + " y",
    _changed(MIT, drop=(30,), put=(60,)),
    _changed(MIT, swap=range(5, 80, 4)),
    f"{MIT}\n\n{APACHE}\n{MIT}",
    " ".join(MIT.split(" ")[:40]),
    "Released under the MIT License. Released under the MIT license. MIT License MIT License",
    "released UNDER the mit-license",
    "MIT Licenses and mit licence; a commit license",
    "Licensed under CC BY 4.0; Licensed under CC BY-NC 4.0.",
    "licensed under the apache license version 1 1, licensed under the GNU General Public License, version 3.",
    "GNU  General\tPublic\nLicense é gnu general public license",
    "ÀPACHE LICENSE apache license",
    "the software is provided " * 50,
    "permission is hereby granted free of " * 9,
]


def test_equals_brute_force(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)]
    found = {r["key"]: _tuple(r) for r in license_scan.scan(documents(spark, rows)).collect()}
    for i, text in enumerate(TEXTS):
        assert found[i] == _expected(text), text
    labels = {i: f[5] for i, f in found.items()}
    assert labels[0] == labels[1] == labels[2] == ["mit"] and labels[4] == ["apache", "apache-2.0", "mit"]
    assert labels[3] == labels[5] == labels[8] == []
    assert labels[9] == ["cc-by", "cc-by-4.0", "cc-by-nc-4.0"] and labels[10] == ["apache", "gpl", "gpl-3.0"]


def test_templates_are_a_parameter(spark):
    rows = [(1, "zero one two three four five six seven", "en", "s", 0), (2, "one two three FOUR five!", "en", "s", 0)]
    own = [Template("count", "One two, three four five."), Template("other", "a b c d e")]
    found = {r["key"]: r for r in license_scan.scan(documents(spark, rows), own, {"three four": "pair"}).collect()}
    assert [tuple(s) for s in found[1]["spans"]] == [(1, 5, "count", 1.0)] and found[2]["labels"] == ["count", "pair"]
    assert found[1]["n_base"] == 1 and found[1]["first_word"] == 3
    none = license_scan.scan(documents(spark, rows), (), {}).collect()
    assert all(r["labels"] == [] and r["score"] == 0 and r["n_base"] == 0 and r["first_word"] is None for r in none)
    with pytest.raises(ValueError, match="words or more"):
        license_scan.scan(documents(spark, rows), [Template("short", "a b c")])


def test_awkward_rows(spark, awkward, nothing):
    rows = license_scan.scan(awkward).collect()
    texts = {}
    for r in awkward.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append(_expected(r["text"]))
    assert len(rows) == sum(map(len, texts.values()))
    for key, want in texts.items():
        assert sorted(map(repr, want)) == sorted(repr(_tuple(r)) for r in rows if r["key"] == key)
    assert license_scan.scan(nothing).collect() == []


def test_copies_vote_once(spark):
    rows = [(i, TEXTS[1], "en", "s", 0) for i in range(400)] + [(None, TEXTS[1], "en", "s", 0)]
    docs = documents(spark, rows).repartition(9)
    assert license_scan.spans(docs).count() == 1
    assert {repr(_tuple(r)) for r in license_scan.scan(docs).collect()} == {repr(_expected(TEXTS[1]))}


def test_words_of_a_vote_are_compared(spark, monkeypatch):
    # With all hashes equal, only the words tell runs apart.
    monkeypatch.setattr(license_scan, "_runs", lambda words, run: license_scan.F.slice(license_scan.F.transform(words, lambda w: license_scan.F.lit(7)), license_scan.F.lit(1), license_scan.F.greatest(license_scan.F.size(words) - (run - 1), license_scan.F.lit(0))))
    rows = [(0, f"some words before. {_changed(MIT, swap=(33,))}", "en", "s", 0)]
    own = [t for t in TEMPLATES if t.label in ("mit", "isc")]
    assert [_tuple(r)[6] for r in license_scan.scan(documents(spark, rows), own).collect()] == [_spans(rows[0][1], own)]


def test_texts_are_cut_once_a_scan(spark, awkward):
    text = license_scan.scan(awkward)._jdf.queryExecution().executedPlan().toString()
    assert text.count("regexp_replace") == 1
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow"):
        assert node not in text
