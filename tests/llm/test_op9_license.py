import re

from eventide.llm.op9_license import BASE, WORD, scan

TEXTS = [
    "This is CC-BY work. All rights reserved. ALL RIGHTS RESERVED", "cc by cc by cc, by", "cc by-nc and 'all  rights' reserved",
    "General\nPublic\tLicense general public licensee", "all all rights rights reserved all rights reserved", "by cc", "cc", "", None,
    "Licensed under the Apache License, Version 2.0.", "licensed under the new apache license version 2",
    "licensed something apache under version license the", "Released under the MIT License.", "x " * 3000 + "cc by " + "y " * 3000,
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "permission is hereby granted free of charge to any good person obtaining a copy of software and associated documentation files",
    "of the software to any person and in source form", "ÀÉ cc by cc by 漢字 all rights reserved",
]


def plain_base(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORD, lower)
    places = [(i, label) for label, phrase in BASE for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def test_base_equals_brute_force(spark):
    docs = spark.createDataFrame([(n, t, "x", 9) for n, t in enumerate(TEXTS)], "doc_id BIGINT, text STRING, labels STRING, row INT")
    got = {r.doc_id: r for r in scan(docs).collect()}
    assert len(got) == len(TEXTS)
    for n, t in enumerate(TEXTS):
        r = got[n]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_notices_whole_changed_and_scrambled(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id BIGINT, text STRING")
    got = {TEXTS[r.doc_id]: r for r in scan(docs, with_spans=True).collect()}
    assert got[TEXTS[9]].labels == "apache" and got[TEXTS[9]].score == 1.0
    assert [(s.start, s.end, s.label) for s in got[TEXTS[9]].spans] == [(0, 6, "apache")]
    assert got[TEXTS[10]].labels == "apache" or got[TEXTS[10]].score < 0.75
    assert got[TEXTS[11]].labels == "" and got[TEXTS[12]].labels == "mit" and got[TEXTS[14]].labels == "mit"
    changed = got[TEXTS[15]]  # a word put in and one left out: neighbouring diagonals
    assert changed.labels == "mit" and 0.75 <= changed.score < 1
    assert got[TEXTS[16]].labels == ""


def test_a_verified_diagonal_is_not_lost_to_weak_neighbours(spark):
    """A verbatim copy keeps its label whatever weak diagonals lie next to its own."""
    notice = "released under the mit license"
    texts = {notice + " mit license" * n for n in range(6)} | {"mit license " * n + notice for n in range(1, 6)}
    docs = spark.createDataFrame(list(enumerate(sorted(texts))), "doc_id BIGINT, text STRING")
    assert {(r.labels, r.score) for r in scan(docs).collect()} == {("mit", 1.0)}


def test_labels_of_further_licenses(spark):
    cases = {
        "mit": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
               "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
               "provided that the above copyright notice and this permission notice appear in all copies.",
        "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "unlicense": "This is free and unencumbered software released into the public domain.",
        "lgpl": "licensed under the GNU Lesser General Public License, version 3", "": "a plain text about software and licenses",
    }
    docs = spark.createDataFrame([(k, t) for k, t in cases.items()], "doc_id STRING, text STRING")
    for r in scan(docs).collect():
        assert r.doc_id == "" and r.labels == "" or r.doc_id in r.labels.split(","), r


def test_edge_rows(edge, empty):
    rows = scan(edge).collect()
    want = sorted(((r.doc_id, *plain_base(r.text)) for r in edge.collect()), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str) == want
    assert scan(empty).collect() == []


def test_no_python_and_one_shuffle(plain):
    plan = scan(plain)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
