from __future__ import annotations

import random

import pytest

from ledger_mart.llm import license


def corpus(rng, n=200):
    word = lambda: "".join(rng.choices("the ing an er re on ti st".split(), k=rng.randint(1, 3)))
    return ["\n".join(" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return license.fit([license.words_of(t.split("\n")[-1]) for t in corpus(random.Random(1))])


def scan(documents, texts, model):
    return {r["doc_id"]: r for r in license.scan(documents(texts), model).collect()}


def test_every_template_is_found(documents, model):
    rng = random.Random(2)
    plain, cases = corpus(rng, 60), [(name, t) for name, ts in license.TEMPLATES.items() for t in ts]
    texts = [f"{a}\n{t}\n{a}" for (_, t), a in zip(cases, plain * 2)] + plain
    got = scan(documents, texts, model)
    found = [got[i]["families"][:1] == [name] and got[i]["paragraph"] == texts[i].split("\n").index(t) for i, (name, t) in enumerate(cases)]
    assert sum(found) >= 0.95 * len(cases)
    assert all(got[len(cases) + i]["families"] == [] for i in range(len(plain)))


@pytest.mark.parametrize(("text", "want"), [
    ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!", ["apache-2.0"]),
    ("Note: this package was released under the MIT License, see the file for more.", ["mit"]),
    ("the version of the work was released under the ground in public", []),
    ("You need a licence to drive; the software is free of charge.", []),
    ("All of this software is subject to review by the public domain office", []),
    (None, []), ("", []), (" \n\n", []), ("!!! ???", []),
    ("GPLv3", ["gpl-3.0"]), ("This tool is under the GNU GPL v3.", ["gpl-3.0"]), ("Apache-2.0 license", ["apache-2.0"]),
    ("Lesser General Public License, version 3", ["lgpl"]),
    ("SPDX-License-Identifier: CC-BY-4.0", ["cc-by"]), ("// SPDX-License-Identifier: ISC", ["isc"]),
    ("Creative Commons Attribution-NoDerivatives 4.0", ["cc-by-nd"]),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ["cc-by-nd"]),
    # licences that are in no family, of which the last five are not learned from
    ("SPDX-License-Identifier: EPL-2.0", []), ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", []),
    ("SPDX-License-Identifier: BSL-1.0", []), ("Distributed under the Boost Software License, Version 1.0.", []),
    ("Licensed under the European Union Public Licence, version 1.2.", []), ("Licensed under the Microsoft Public License, version 1.0.", []),
    ("Released under the PostgreSQL License.", []),
])
def test_lines(documents, model, text, want):
    assert scan(documents, [text], model)[0]["families"] == want


@pytest.mark.parametrize(("text", "want"), [
    ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache-2.0"}),
    ("SPDX-License-Identifier: (GPL-2.0-only AND BSD-3-Clause) OR EPL-2.0", {"gpl-2.0", "bsd"}),
    ("Licensed under the Apache License, Version 2.0. Released under the MIT License.", {"mit", "apache-2.0"}),
])
def test_several_families_in_one_line(documents, model, text, want):
    assert set(scan(documents, [text], model)[0]["families"]) == want


def test_several_and_in_a_very_long_line(documents, model):
    rng = random.Random(3)
    filler = " ".join(corpus(rng, 300)).replace("\n", " ")
    text = f"Released under the MIT License.\n{filler} Licensed under CC BY-NC 4.0. {filler}"
    row = scan(documents, [text], model)[0]
    assert set(row["families"]) == {"mit", "cc-by-nc"} and row["found"] == 2


def test_no_rows_and_repeated_rows(documents):
    assert license.licenses(documents([])).collect() == []
    rows = license.licenses(documents([(1, "Released under the MIT License.", "en", "s")] * 2 + [(None, "x", "en", "s")])).collect()
    assert sorted(r["license"] for r in rows) == ["mit", "mit", "unknown"]


def test_probabilities_are_calibrated(model):
    """Of examples not trained on, about as many are right as the model says."""
    rng = random.Random(9)
    filler = sorted({w for t in corpus(rng) for w in license.words_of(t)})
    cases = []
    for i, name in enumerate(license.TEMPLATES):
        for t in license.TEMPLATES[name]:
            for _ in range(6):
                words = [w for w in license.words_of(t) if rng.random() > 0.25] or license.words_of(t)
                cases.append((i, words + rng.choices(filler, k=10)))
    chance, _ = model.scores([w for _, w in cases])
    right = sum(c[:].argmax() == i for c, (i, _) in zip(chance, cases)) / len(cases)
    assert abs(chance.max(axis=1).mean() - right) < 0.12 and right > 0.8


MIT = """Copyright (c) 2019 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#"""


@pytest.mark.parametrize(("text", "want"), [(MIT, ["mit"]), (BSD, ["bsd"]), (GPL, ["gpl-3.0"])])
def test_wrapped_notices(documents, model, text, want):
    before = "\n".join(" ".join(x.split()[:9]) for x in corpus(random.Random(4), 3))
    for whole, first in ((text, 0), (f"{before}\n\n{text}\n\n{before}", len(before.split("\n")) + 1)):
        row = scan(documents, [whole], model)[0]
        assert row["families"] == want and row["found"] == 1
        assert row["paragraph"] == first + (2 if text is MIT else 0)


def test_a_blank_line_ends_a_paragraph(documents, model):
    row = scan(documents, ["Redistribution and use in source\n\nand binary forms, with or without\n \nmodification, are permitted"], model)[0]
    assert row["families"] == []
