import random
import re

from inkgraph.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = []
    for label, phrase in licenses.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x[1] for x in places}))


def test_base_is_brute_force(spark):
    rng = random.Random(3)
    vocab = ["CC", "by", "cc", "General", "public", "license", "all", "rights", "reserved", "x", "İx", "Kk", "4.0", "été"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["", None, "cc-by cc by cc", "All rights\nreserved.", "cc by " * 3000, "\U0001f600 cc by"]
    rows = [(i, t, 5, "a") for i, t in enumerate(texts)] + [(None, "cc by", 1, "b"), (None, "cc by", 1, "b"), (0, texts[0], 5, "a")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, n_words int, label string")).collect()
    want = sorted((repr((i, *brute(t))) for i, t, *_ in rows))
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_changed_notices(spark):
    rows = [
        (1, "x Released under the terms of MIT License y", ""),
        (2, "Released under the MIT License.", "mit"),
        (3, "a Licensed under the new Apache License, Version 2.0. b", "apache-2.0"),
        (4, "Permission is hereby granted, free of charge, to anyone obtaining a copy of this software", ""),
        (5, "Permission is hereby granted, free of charge, to any other person obtaining a copy of this software", "mit"),
        (6, "licensed under the", ""),
        (7, "license apache the under licensed version", ""),
    ]
    got = licenses.scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    labels = {r.doc_id: r.labels for r in got.collect()}
    assert {k: labels[k] for k in (2, 3, 5, 6, 7)} == {r[0]: r[2] for r in rows if r[0] in (2, 3, 5, 6, 7)}
    spans = licenses.find_spans(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).where("doc_id = 3").collect()
    assert [(r.label, r.start_word, r.end_word) for r in spans] == [("apache-2.0", 1, 10)]


def test_strewn_words_are_no_span(spark):
    words = "permission to use copy modify and or distribute this software for any purpose".split()
    strewn = " ".join(" ".join(words[i : i + 2]) + " zz zz" for i in range(0, len(words), 2))
    some = "Permission to use, copy, freely modify, and/or also distribute this software for just any purpose"
    got = licenses.scan_licenses(spark.createDataFrame([(1, strewn), (2, some), (3, "x " * 40 + strewn * 3)], "doc_id long, text string"))
    assert {r.doc_id: r.labels for r in got.collect()} == {1: "", 2: "isc", 3: ""}
