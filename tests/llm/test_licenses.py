"""Notices wrapped over lines, against brute force over lines and word windows."""

import random

import brute
import pytest

from stopover.llm import licenses

WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files",
    "gpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License",
    "apache": 'Licensed under the Apache License, Version 2.0;\nyou may not use this file except in compliance\nwith the License.',
    "cut": "Permission is hereby granted, free of charge, to any person\nobtaining something else",
    "none": "a text of no license at all",
}


def best(text):
    """Labels and best containment of a text."""
    labels, top = set(brute.licenses(text)[-1].split(",")) - {""}, 0.0
    w = brute.plain_words(text)
    for label, template in licenses.TEMPLATES:
        t = brute.plain_words(template)
        n = len(t)
        every = [brute.plain_words(x) for x in text.split("\n")] + [w[i : i + 2 * n] for i in range(0, max(len(w), 1), n)]
        score = max(len(set(t) & set(b)) / len(set(t)) for b in every)
        if score >= 0.8 - 1e-9:
            labels.add(label)
            top = max(top, score)
    return ",".join(sorted(labels)), pytest.approx(top)


def test_wrapped_notices(spark):
    rng = random.Random(3)
    filler = [*"abcdefghij", "the", "of", "license", "software", "and", "this", "is", "under"]
    texts = list(WRAPPED.values())
    for _ in range(150):
        around = [" ".join(rng.choices(filler, k=rng.randrange(60))) for _ in range(2)]
        notice = rng.choice(licenses.TEMPLATES)[1].split(" ")
        notice = " ".join(x for w in notice for x in (w, *rng.choices(["", "\n", "* x"], [8, 2, 1])) if rng.random() < 0.95)
        texts.append(around[0] + rng.choice(" \n") + notice + "\n" + around[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(docs, licenses.templates(spark)).collect()}
    assert got[0] == ("mit-notice", 1.0) and got[1] == ("gpl,gpl-notice", 1.0) and got[2] == ("apache,apache-notice", 1.0)
    assert got[3] == got[4] == ("", 0.0)
    assert got == {i: best(x) for i, x in enumerate(texts)}
