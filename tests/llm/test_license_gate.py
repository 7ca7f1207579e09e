import random
import re
import re._parser as parser
import time

from loomgraph.llm import license_scan as L


def sample(regex, rng):
    """A text that the regex matches."""

    def walk(tree):
        out = ""
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "MAX_REPEAT":
                low, high, part = arg
                out += "".join(walk(part) for _ in range(rng.randint(low, min(high, 4))))
            elif name == "SUBPATTERN":
                out += walk(arg[3])
            elif name == "BRANCH":
                out += walk(rng.choice(arg[1]))
            else:
                assert name == "IN", name
                kind, what = rng.choice(arg)
                out += chr(what if str(kind) == "LITERAL" else rng.randint(*what))
        return out

    return walk(parser.parse(regex))


def test_no_match_without_keyword_and_gate_word():
    rng = random.Random(2)
    gate = re.compile(L.gate(), re.A)
    for _, label, _, regex, words in L.rules():
        for _ in range(40):
            text = sample(regex, rng)
            assert all(f" {w}" in f" {text}" for w in words) and gate.search(text), (label, words, text)


def test_rules_are_many_and_written_by_hand():
    made = L.rules()
    assert len({r[3] for r in made}) == len(made) > 250 and {r[0] for r in made} == set(range(6))


def test_every_rule_is_reached(spark):
    rng = random.Random(3)
    rows = [(i, f"zz {sample(regex, rng)} zz", label) for i, (_, label, _, regex, _) in enumerate(L.rules())]
    for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(4)).collect():
        assert r.labels and r.score > 0, rows[r.doc_id]


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    """Every rule on every text, by Python's re; every pair of detections compared."""
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    joined, found = f" {' '.join(words)} ", []
    for priority, label, strength, regex, _ in L.rules():
        for m in re.finditer(f" (?:{regex})(?= )", joined):
            first = joined[: m.start()].count(" ")
            found.append((first, first + m[0].count(" "), priority, label, strength))
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and (b[2] < a[2] or b[2] == a[2] and b[1] - b[0] > a[1] - a[0])
    kept = [a for a in found if not any(inside(a, b) for b in found)]
    base = sorted(i for _, phrase in L.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    labels = {label for label, phrase in L.BASE if f" {phrase} " in joined}
    best = max([s for *_, s in kept] + [0.5 if labels else 0.0])
    return len(words), len(base), base[0] if base else None, base[-1] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | {d[3] for d in kept})), best, sorted(kept)


def as_brute(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, sorted(tuple(d) for d in r.found)


def test_against_brute_force(spark, docs, rows):
    """Rules, priority and containment on phrases that overlap, touch and repeat, beside the texts of all odd kinds."""
    rng = random.Random(4)
    texts = [t for _, t, *_ in rows]
    for _ in range(400):
        parts = [sample(rng.choice(L.rules())[3], rng) if rng.random() < 0.6 else rng.choice(["mit", "license", "the", "x", "public", "© 2020", "or later", "2 0"]) for _ in range(rng.randint(1, 12))]
        texts.append(rng.choice([" ", "\n", " - "]).join(w.upper() if rng.random() < 0.2 else w for w in parts) + rng.choice(["", ".", " "]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: as_brute(r) for r in L.scan(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_many_hits_in_one_text(spark):
    text = "Apache License 2.0, foo " * 50_000
    began = time.time()
    (r,) = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).drop("found").collect()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (250_000, 50_000, 0, 249_995, "apache,apache-2.0")
    assert time.time() - began < 30  # linear; about 6 s alone


def test_german_prose_is_no_license(spark):
    said = ["Ich fahre mit dem Zug. Copyright (c) 2020", "mit der Lizenz, license and mit dem", "Released mit Freude under Protest"]
    for r in L.scan(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).collect():
        assert "mit" not in r.labels.split(",")


def test_sentences_without_other_license_words(spark):
    said = [
        ("This project is released under MIT.", "mit"), ("distributed under the BSD 3 Clause", "bsd-3-clause"), ("Zero-Clause BSD", "0bsd"), ("as in FreeBSD", "bsd-2-clause"),
        ("Permission is hereby granted, free of charge", "permission-notice"), ("General Public License 1.0", "gpl-1.0"), ("Library General Public License 2.0", "lgpl-2.0"), ("Open Data Commons Database License 1.0", "odbl-1.0"),
        ("GPLv3", "gpl-3.0"), ("licensed under Apache-2.0", "apache-2.0"), ("BSD-3-Clause", "bsd-3-clause"), ("MIT no attribution", "mit-0"), ("Copyright ©2021 Ann", "copyright-notice"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)] + [(99, "a plain text")], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in L.scan(df).collect()}
    assert all(label in got[i] for i, (_, label) in enumerate(said)) and got[99] == [""]
