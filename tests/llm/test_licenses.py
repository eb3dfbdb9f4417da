import random

import pytest

from cairn.llm import licenses as li


def noise(rng, n):
    return " ".join(rng.choice(["tha", "ene", "orti", "lich", "ess"]) for _ in range(n))


def test_scan_finds_statements_and_bodies(spark):
    rng = random.Random(1)
    docs, want = [], {}
    forms = [(name, text) for name, texts in li.TEMPLATES.items() for text in texts]
    for i, (name, text) in enumerate(forms):
        wrapped = text.replace(", ", ",\n") if i % 2 else text.upper()
        docs.append((i, f"{noise(rng, 20)}\n{wrapped}\n{noise(rng, 9)}", "x"))
        want[i] = name
    n = len(docs)
    docs += [(n, noise(rng, 50), "x"), (n + 1, "A driving licence is needed here", "x"), (n + 2, None, "x"), (n + 3, "", "x"), (None, forms[0][1], "x"), (n + 4, "Licensed under the GNU General Public License, version 7.", "x")]
    docs += [(n + 5, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "x"), (n + 6, "This project was released under the MIT License", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, license string")
    rows = li.license_scan(df).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.license)
        assert r.reduction >= li.REDUCTION and r.edits <= li.LOOSE * max(r.words, 3) + 1
    assert {k: v for k, v in got.items() if k is not None and k < n} == {k: {v} for k, v in want.items()}
    assert got[None] == {"MIT"} and got[n + 5] == {"MIT", "CC-BY-NC-4.0"} and not {n, n + 1, n + 2, n + 3, n + 4} & set(got)
    assert [r for r in rows if r.doc_id == n + 6 and r.license == "MIT"]
    assert li.license_scan(df.where("false")).count() == 0


def test_equal_to_brute_force_over_lines(spark):
    """Every line, marked or not, against every template by word edits, without compression and without marks."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, scanner = set(), li.Scanner()
    for r in docs.collect():
        for line in (r.text or "").split("\n"):
            w = li.words_of(line)
            have = set(w)
            for name, f, _ in scanner.forms:
                near = {x for x in f if x not in li.HARMLESS} <= have if len(f) < li.STATEMENT else len(have & set(f)) > 7
                if near and (got := scanner.compared(w, f)) and not li.denied(line, li.spans(line)[got[5]][0]):
                    want.add((r.doc_id, name))
    got = {(r.doc_id, r.license) for r in li.license_scan(docs).collect()}
    assert got == want and len(got) > 20


CASES = [
    ("Released under the Zlib License.", ["Zlib"]),
    ("Released under the BSD License.", []),
    ("Released under the Proprietary License.", []),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
    ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
    ("Licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("Licensed under the GNU General Public License version 3", ["GPL-3.0"]),
    ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]),
    ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]),
    ("This project is not licensed under the MIT License.", []),
    ("The project isn't released under the MIT License.", []),
    ("It was never ours. Released under the MIT License.", ["MIT"]),
    ("This work is compatible with the GNU General Public License, version 3.", []),
    ("SPDX-License-Identifier: MIT", ["MIT"]),
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0)", ["Apache-2.0", "MIT"]),
    ("SPDX-License-Identifier: GPL-3.0-or-later", ["GPL-3.0"]),
    ("SPDX-License-Identifier: Foo-1.0", []),
    ("This file is distributed under the terms of the Apache License, Version 2.0", ["Apache-2.0"]),
    (li._ISC + ".", []),  # two licenses share this part
    (li._BSD2, ["BSD-2-Clause"]),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU", []),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ["MIT"]),
    ("MIT License", []),
]


@pytest.mark.parametrize("words", [0, 25, 300])
@pytest.mark.parametrize("line, want", CASES)
def test_the_true_license_or_none(line, want, words):
    rng = random.Random(3)
    text = f"{noise(rng, words)}. {line} {noise(rng, words)}" if words else line
    if words and not want or not words or not line.startswith(("Permission", li._BSD2[:9])):
        assert sorted({h[3] for h in li.Scanner().scan(text)}) == want


def test_every_line_of_a_block_is_judged():
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0."]
    find = lambda text: sorted(h[3] for h in li.Scanner().scan(text))
    assert find("\n".join(lines)) == ["Apache-2.0", "CC-BY-NC-4.0", "MIT"]
    assert find("\n".join(["Copyright 2020 The Authors", *lines[:2]])) == ["CC-BY-NC-4.0", "MIT"]
    assert find("\n".join(["Copyright 2020 The Authors", *lines])) == ["Apache-2.0", "CC-BY-NC-4.0", "MIT"]
    assert find("İİ " + lines[0] + "\n" + "\n".join(lines[1:])) == ["Apache-2.0", "CC-BY-NC-4.0", "MIT"]
    for name, texts in li.TEMPLATES.items():  # a body over several lines is still one statement
        assert all(find(text.replace(", ", ",\n")) == [name] for text in texts)


def test_statements_within_running_text():
    rng = random.Random(2)
    for name, texts in li.TEMPLATES.items():
        for text in texts:
            for before, after in ((10, 5), (20, 10), (80, 40), (400, 400)):
                line = f"{noise(rng, before)} {text} {noise(rng, after)}"
                assert {h[3] for h in li.Scanner().scan(line)} == {name}, (name, before)
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    line = f"{noise(rng, 60)} {mit} {noise(rng, 50)} {apache} {noise(rng, 60)}"
    assert {(h[3], line[h[1] : h[2]]) for h in li.Scanner().scan(line)} == {("MIT", mit[:-1]), ("Apache-2.0", apache[:-1])}
    assert not list(li.Scanner().scan(f"{noise(rng, 30)} Licensed under the Apache License, Version 3.0. {noise(rng, 30)}"))


def test_alignment_and_difference():
    assert li.aligned(list("bcd"), list("abxcde")) == (1, 3, 5) and li.aligned(list("bcd"), list("abcxde")) == (1, 1, 3)
    assert li.difference("a b c".split(), "a x c d".split()) == "-b +x +d"
