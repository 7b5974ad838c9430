"""Cases that a query must find in whole texts, by brute force where its SQL cannot say them."""

import random
import re
from collections import Counter

from clearspark.llm import license_scan, secrets_scan

# op7


def licenses(text):
    """{label: best share} of every template in every line and in every window of the template's length."""
    low = lambda s: [w for w in re.split(license_scan.SPLIT, s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
    every, found = low(text), {}
    for template, label in license_scan.TEMPLATES:
        own, n = set(template.split()), len(template.split())
        blocks = [low(x) for x in text.split("\n")] + [every[i : i + n] for i in range(len(every))]
        share = max(len(own & set(b)) / len(own) for b in blocks)
        if share >= license_scan.THRESHOLD - 1e-9:
            found[label] = max(share, found.get(label, 0))
    return found


def test_wrapped_licenses(spark):
    heads = {
        "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that",
        "mpl": " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy",
        "isc": "Permission to use, copy,\nmodify, and/or distribute\nthis software for any\npurpose with or without fee",
    }
    random.seed(7)
    words = sorted({w for t, _ in license_scan.TEMPLATES for w in t.split()}) + ["lorem", "ipsum"] * 9
    texts = list(heads.values()) + [("filler\n" * 3000) + heads["bsd"], " ".join(heads["bsd"].replace("in source", "in source" + " x" * 9).split())]
    for t, _ in license_scan.TEMPLATES * 6:
        mixed = [x for w in t.split() for x in ([w] if random.random() < 0.9 else []) + ([random.choice(words)] if random.random() < 0.1 else [])]
        texts.append("".join(w + random.choice("  \n") for w in random.choices(words, k=8) + mixed + random.choices(words, k=8)))
    rows = license_scan.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    got = {}
    for r in rows:
        best = got.setdefault(r.doc_id, {})
        for x in r.found:
            best[x.label] = max(x.score, best.get(x.label, 0))
    assert got == {i: licenses(t) for i, t in enumerate(texts)}
    assert [sorted(got[i]) for i in range(4)] == [["bsd"], ["mpl"], ["isc"], ["bsd"]]


# op9


def test_background_counts_all_candidates(spark):
    rng = random.Random(5)
    made = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    rows = [(i, f"password={made('abcdef', 18)} id {made('0123456789ABCDEFG-_', 20)}7. and short x9") for i in range(300)] + [(400, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = Counter()
    for _, text in rows:
        for value in re.findall(r"[A-Za-z0-9+/_.=-]+", re.sub("password=[a-f]+", " ", text or "")):
            value = value.rstrip(".")
            if len(value) >= 6:
                classes = [0, *(next((n[0] for n, own in secrets_scan.CLASSES if ord(c) in own), ord(c)) for c in value), 0]
                want.update(zip(classes, classes[1:]))
    assert secrets_scan.learn(docs, "text", 20).pairs == want


def test_automaton_holds_whole_values():
    rng = random.Random(6)
    made = lambda signs, n: "".join(rng.choice(signs) for _ in range(n)).encode()
    digits, tail = "0123456789", "GHIJKLMNOP"
    automaton = secrets_scan.Automaton([made(digits, 52) + made(tail, 12) for _ in range(300)])
    per_sign = lambda v: automaton.likelihood(v.translate(secrets_scan._CLASS_OF)) / len(v)
    assert per_sign(made(digits, 52) + made(tail, 12)) >= automaton.floor
    assert per_sign(made(digits, 52) + made("ghijklmnop", 12)) < automaton.floor
    assert per_sign(made(digits, 52) + made(tail, 5)) < automaton.floor
