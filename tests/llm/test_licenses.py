"""License notices that are planted, changed and absent."""

from __future__ import annotations

import random

from vertexloom.llm import licenses

FILLER = "thntion anred hestwh onand erthat theblen ination of the reouer".split()


def plain(rnd, n):
    return " ".join(rnd.choice(FILLER) for _ in range(n))


def test_planted_notices_are_found_and_others_are_not(spark):
    rnd = random.Random(4)
    rows, expected = [], []
    for name, _, notice in licenses.TEMPLATES:
        for form in (notice, notice.upper(), notice.replace(",", "").replace("  ", " ")):
            rows.append(f"{plain(rnd, 80)}\n{form}\n{plain(rnd, 300)}")
            expected.append(name)
    rows += ["Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-NC-SA 4.0.", "This work is licensed under the GNU Lesser General Public License, version 2."]
    rows += ["a license to write", "Released under the XYZ License.", None, "", plain(rnd, 5000)]
    expected += [""] * 8
    rows += ["Released under the MIT License.\n" + plain(rnd, 900) + "\nLicensed under CC BY-NC 4.0.", "license " * 8000]
    expected += ["CC-BY-NC-4.0,MIT", ""]
    df = spark.createDataFrame([(i, t, 2) for i, t in enumerate(rows)], "doc_id long, text string, notices int")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    wrong = [(rows[i], got[i].licenses, e) for i, e in enumerate(expected) if got[i].licenses != e]
    assert wrong == []
    first = got[3].notices[0]
    assert rows[3][first.start : first.end].lower().startswith("licensed under the apache")
    assert licenses.scan_licenses(df.limit(0)).collect() == []


def test_every_notice_of_a_list_is_found():
    scanner = licenses.TemplateScanner()
    rnd = random.Random(6)
    every = sorted({name for name, _, _ in licenses.TEMPLATES})
    for gap in (0, 3, 200):
        notices = list(licenses.TEMPLATES)
        rnd.shuffle(notices)
        text = "\n".join(f"{notice}\n{plain(rnd, gap)}" for _, _, notice in notices)
        found = scanner.scan(text)
        assert sorted({f.license for f in found}) == every
        assert sorted(f.license for f in found) == sorted(name for name, _, _ in notices)


def test_headers_texts_and_tags():
    scanner = licenses.TemplateScanner()
    names = lambda text: [f.license for f in scanner.scan(text)]
    gpl = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version {} of the License, or\n(at your option) any later version."
    assert names(gpl.format(2)) == ["GPL-2.0"] and names(gpl.format(3)) == ["GPL-3.0"]
    assert names(gpl.format(3).replace("General", "Lesser General").replace("program", "library")) == ["LGPL-3.0"]
    assert names("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-or-later\ncode") == ["MIT", "Apache-2.0", "GPL-2.0"]
    assert names("SPDX-License-Identifier: MIT-0\nReleased") == []


def brute_force(scanner, text):
    """Every template against all words of the text, whatever it saves."""
    lowered = text.translate(licenses._LOWER)
    words = [(m.group(), m.start(), m.end()) for m in licenses._WORD.finditer(lowered)]
    return licenses.chosen(scanner.tagged(0, lowered) + list(scanner.findings(words, least=-(10**9))))


def test_every_template_at_many_places_of_long_blocks():
    """Blocks of 4,000 to 12,000 characters full of license words: nothing is lost, nothing is taken for another license."""
    scanner, rnd = licenses.TemplateScanner(), random.Random(8)
    around = lambda n: " ".join(rnd.choice([*FILLER, "license", "copyright", "redistribution", "the", "this"]) for _ in range(n))
    for k, (name, _, notice) in enumerate(licenses.TEMPLATES):
        for n in range(0, 900, 100):
            text = f"{around(n + k)}. {notice} {around(900 - n)}"
            assert [f.license for f in scanner.scan(text)] == [name], (name, n)


def test_same_as_brute_force():
    scanner, rnd = licenses.TemplateScanner(), random.Random(9)
    for _ in range(150):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            words = rnd.choice(licenses.TEMPLATES)[2].split()
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(["", "x", "\n# ", "Lesser"])
            parts.append(rnd.choice([" ", "\n\n", " \n * "]).join(words) + " license " + " license ".join(plain(rnd, 40) for _ in range(rnd.choice([0, 1, 3, 15]))))
        text = "\n".join(parts)
        assert scanner.scan(text) == brute_force(scanner, text)


def test_size_reduction_decides():
    """The first clauses of the longer license are the shorter one word by word; what the longer template saves beside makes it win."""
    scanner = licenses.TemplateScanner()
    two, three = (next(t[2] for t in licenses.TEMPLATES if t[0] == name and len(t[2]) > 300) for name in ("BSD-2-Clause", "BSD-3-Clause"))
    changed = three.replace("copyright holder", "ACME Corporation")
    found = scanner.scan(changed)
    exact = [f for f in brute_force(scanner, two) if f.license == "BSD-2-Clause"]
    assert [f.license for f in found] == ["BSD-3-Clause"] and found[0].missing + found[0].added > 0 == exact[0].missing + exact[0].added
    lowered = changed.lower()
    words = [(m.group(), m.start(), m.end()) for m in licenses._WORD.finditer(lowered)]
    assert [scanner.words[k][0] for _, k, first in scanner.ranked(words) if first == 0][:2] == ["BSD-3-Clause", "BSD-2-Clause"]
    assert {f.license for f in scanner.findings(words)} == {"BSD-3-Clause", "BSD-2-Clause"}  # the saved bytes choose
