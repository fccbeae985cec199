"""Licence scans against a plain search of every phrase at every word."""

import random
import re

from shoplens.llm import licenses

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plain(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in PHRASES.items() for n in [len(phrase.split())]
              for i in range(len(words) - n + 1) if words[i:i + n] == phrase.split()]
    return len(words), sorted(places)


def texts():
    rng = random.Random(9)
    bits = ["MIT", "license", "License,", "apache", "general", "public", "GENERAL", "é", "mit-license", "x", "the", "mit\nlicense.", "2.0"]
    out = [" ".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(200)]
    return [*out, "", None, "Licence MIT", "mit" * 500 + " mit license " * 400]


def test_base_places_equal_plain_search(spark):
    rows = [(k, t, 1) for k, t in enumerate(texts())] + [(3, "mit license", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = licenses.scanned(docs).collect()
    found = sorted((r.doc_id, r.n_words, sorted((m.start, m.label) for m in r.matches if m.base)) for r in got)
    assert found == sorted((d, *plain(t)) for d, t, _ in rows)
    assert licenses.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def scan(text):
    return licenses.LicenseIndex(licenses.BASE + licenses.NOTICES, {}, 0).scan(licenses.words_of(text.encode()))


def labels(text):
    return sorted({m["label"] for m in scan(text)})


def test_notices():
    assert labels("Released under the MIT License.") == ["mit"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc"]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl"]
    assert labels("licensed under the GNU Lesser General Public License, version 2.1") == ["gpl", "lgpl"]
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files") == ["mit"]
    assert labels("the license of the public in general; apache is a helicopter, mit a school") == []


def test_words_must_stand_in_relative_position():
    far = "redistribution and use in source and binary forms " + "word " * 50 + "with or without modification are permitted"
    near = "redistribution and use in source and binary forms, with or without any modification, are permitted"
    def share(text):
        return max([m["coverage"] for m in scan(text) if m["label"] == "bsd"], default=0)
    assert share(near) > 0.9 > share(far) and scan(near)[0]["start"] == 0


def test_document_frequencies(spark):
    docs = spark.createDataFrame([("mit mit",), ("MIT license",), (None,)], "text string")
    assert licenses.document_frequencies(docs, {b"mit", b"license", b"gnu"}) == ({b"mit": 2, b"license": 1}, 3)
