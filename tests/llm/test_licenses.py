"""The license scan against a plain version of its rules, and the soundness of its prefilter."""

import random
import re

import pytest
from re import _parser as sre

from sparkcover.llm.license_rules import MAX_WORDS, license_rules
from sparkcover.llm.licenses import SLICE_WORDS, scan_licenses
from sparkcover.llm.queries import LICENSE_PHRASES

SCHEMA = "doc_id bigint, text string"
RULES = license_rules()


def sample(pattern, rng):
    """A random string that the pattern matches."""
    out = ""
    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "NOT_LITERAL":
            out += "q"
        elif name == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif name == "SUBPATTERN":
            out += sample(arg[3], rng)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, part = arg
            out += "".join(sample(part, rng) for _ in range(rng.randint(low, min(high, low + 4))))
        elif name == "IN":
            out += chr(arg[-1][1]) if str(arg[0][0]) != "NEGATE" else "q"
        else:
            raise AssertionError(name)
    return out


def spaced(text):
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def brute(text):
    words = spaced(text)
    listed = words.split(" ") if words else []
    places = []
    for phrase, label in LICENSE_PHRASES:
        p = phrase.split(" ")
        places += [(i, label) for i in range(len(listed)) if listed[i : i + len(p)] == p]
    spans = []
    for n, rule in enumerate(RULES):
        for m in re.finditer(f"(?<![^ ])(?:{rule.regex})(?![^ ])", words):
            start = words[: m.start()].count(" ")
            spans.append((n, start, start + m[0].count(" ") + 1))
    kept = [d for d in spans if not any(e[0] < d[0] and e[1] <= d[1] and e[2] >= d[2] for e in spans)]
    base = {label for _, label in places}
    labels = base | {RULES[d[0]].label for d in kept}
    score = max([RULES[d[0]].confidence for d in kept] + [0.5 if places else 0.0])
    first, last = (min(places)[0], max(places)[0]) if places else (None, None)
    return (
        len(listed), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score,
        sorted((RULES[n].label, n, a, b) for n, a, b in kept),
    )


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for r in scan_licenses(df, LICENSE_PHRASES).collect():
        got = (
            r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score,
            sorted((d.label, d.rule, d.start, d.end) for d in r.detections),
        )
        assert got == brute(texts[r.doc_id]), (r.doc_id, texts[r.doc_id][:300])


def test_every_match_holds_its_keyword_and_stays_short():
    rng = random.Random(3)
    assert len(RULES) > 200
    for rule in RULES:
        for _ in range(20):
            text = sample(sre.parse(rule.regex), rng)
            assert re.fullmatch(rule.regex, text) and rule.keyword in text, (rule, text)
            assert len(text.split(" ")) <= MAX_WORDS


def test_every_rule_fires_through_the_prefilter(spark):
    rng = random.Random(4)
    texts = []
    for rule in RULES:
        words = sample(sre.parse(rule.regex), rng).split(" ")
        texts.append("Ünrelated; ".join(["", ""]) + "".join(w.title() + rng.choice([" ", "-", ".\n", ", "]) for w in words) + "end")
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for r in scan_licenses(df, LICENSE_PHRASES).collect():
        found = {(d.start, d.end) for d in r.detections}
        at = spaced(texts[r.doc_id]).split(" ")
        n = len(at) - 2
        assert any(a <= 1 and b >= 1 + n for a, b in found), (RULES[r.doc_id], texts[r.doc_id], r.detections)


def test_notices_in_texts(spark):
    rng = random.Random(5)
    notices = [
        "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "mit license mit license",
        "under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "GNU Lesser General Public License v2.1",
        "SPDX-License-Identifier: BSD-3-Clause", "general public license general public license", "THE MIT-LICENSE", "permit license",
        "mit licenses", "Apache\tLicense", "the licence of the poet", "in the public domain",
    ]
    texts = []
    for _ in range(60):
        words = [rng.choice(["ba", "çou", "the", "İx", "a1", "😀", "license"]) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(notices))
        texts.append(" ".join(words))
    check(spark, [*texts, *notices, None, "", " .,;", "a", *notices[:2]])


def test_long_texts_are_cut_into_slices(spark):
    filler = [f"w{i}" for i in range(3 * SLICE_WORDS + 17)]
    for k, at in enumerate([0, SLICE_WORDS - 3, SLICE_WORDS - 1, SLICE_WORDS, 2 * SLICE_WORDS + 5, len(filler)]):
        filler.insert(at + 8 * k, "licensed under the gnu lesser general public license version 3")
    check(spark, [" ".join(filler), "general public license " * 900, "x " * 400_000 + "MIT License " + "y " * 100_000])


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "MIT License", 5, "x", "y")], f"{SCHEMA}, n_words int, Labels string, row string")
    got = scan_licenses(df, LICENSE_PHRASES)
    assert got.columns == ["doc_id", "text", "row", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    assert tuple(got.first())[2:9] == ("y", 2, 1, 0, 0, "mit", "mit")
    assert scan_licenses(df.limit(0), LICENSE_PHRASES).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_registered_query_on_given_documents(spark, sf):
    from sparkcover.llm.queries import op11_license_scan

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    query = op11_license_scan(spark, f"/root/testdata/{sf}")
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    for r in query.collect():
        assert tuple(r)[1:] == brute(docs[r.doc_id])[:7]
