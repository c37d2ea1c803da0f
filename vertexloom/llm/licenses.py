"""License scans by conditional compression."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import LOWER, UPPER, arrow_batches, shield

# Short notices as they are usually written, (identifier, words that must all be there, notice).
TEMPLATES = (
    ("AGPL-3.0", "affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2.0 compliance", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "bsd 2-clause", "Use of this source code is governed by the BSD 2-Clause License."),
    ("BSD-3-Clause", "bsd 3-clause", "Use of this source code is governed by the BSD 3-Clause License."),
    ("CC-BY-4.0", "cc by 4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "cc by-nc 4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "cc by-sa 4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "cc0 1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "gnu general public 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "gnu general public 3", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "lesser 2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "lesser 3", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "mit license", "Released under the MIT License."),
    ("MIT", "permission granted free charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-2.0", "gnu general public 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "gnu general public 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "affero 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "lesser 2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "lesser 3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "redistributions source binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "redistributions source binary neither endorse", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "permission fee granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)
#: Identifiers that an SPDX tag may name beside those of the templates.
SPDX = {f"{n}{e}": n for n in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0") for e in ("-only", "-or-later", "+")}
TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\n]*)")
#: Words that tell licenses with much wording in common apart.
TELLING = frozenset("affero lesser library by by-nc by-sa by-nd by-nc-sa by-nc-nd noncommercial sharealike 2-clause 3-clause 1.0 1.1 2 2.0 2.1 3 3.0 4.0".split())
CUE = re.compile(r"licen[sc]|copyright|permission (?:is hereby|to use)|redistributi|free software|public domain|\bcc0\b|\bcc by\b|\bgpl\b|\bspdx\b", re.I)
#: Share of a template's words that a block must have, in order.
COVERAGE = 0.8
_LOWER = str.maketrans(UPPER, LOWER)
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


@dataclass(frozen=True)
class Finding:
    """A confirmed license: its place, the bytes that its template saved, and the differences in wording."""

    license: str
    start: int
    end: int
    saved: int
    missing: int
    added: int


Word = tuple[str, int, int]


def blocks(cues: Iterator[re.Match], found: list[Word], longest: int) -> Iterator[tuple[int, int]]:
    """First and last words of the places that may hold a notice; neighbouring ones are one, of any length.

    The longest template before a cue and its room, twice its words, after it belong to a
    block, so no notice around a cue is cut.
    """
    begins = [w[1] for w in found]
    first = last = None
    for m in cues:
        at = bisect_right(begins, m.start())
        low, high = max(0, at - longest), min(len(found), at + 2 * longest)
        if first is not None and low <= last:
            last = high
        else:
            if first is not None:
                yield first, last
            first, last = low, high
    if first is not None and last > first:
        yield first, last


class TemplateScanner:
    """Compressors primed with each template as raw dictionary, and the exact comparison of winners."""

    def __init__(self) -> None:
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.primed, self.words = [], []
        for name, must, notice in TEMPLATES:
            raw = zstandard.ZstdCompressionDict(" ".join(_WORD.findall(notice.lower())).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.primed.append(zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_dict_id=False))
            self.words.append((name, frozenset(must.split()), _WORD.findall(notice.lower())))
        self.longest = max(len(words) for _, _, words in self.words)
        self.tags = {spelled.lower(): name for spelled, name in [*((name, name) for name, _, _ in TEMPLATES), *SPDX.items()]}

    def saved(self, k: int, words: list[Word]) -> int:
        """Bytes that a template saves of a text, both as words with single spaces between."""
        raw = " ".join([w for w, _, _ in words]).encode()
        return len(self.plain.compress(raw)) - len(self.primed[k].compress(raw))

    def ranked(self, found: list[Word], least: int = 1) -> list[tuple[int, int, int]]:
        """Candidates among the words of a block: bytes saved, template and first word, most saved first.

        A candidate is the room of a template, twice its words, from one of its first words on.
        Only those of which it saves ``least`` bytes are any.
        """
        out = []
        for k, (_, _, words) in enumerate(self.words):
            heads = set(words[:3])
            for first, (word, _, _) in enumerate(found):
                if word in heads:
                    saved = self.saved(k, found[first : first + 2 * len(words)])
                    if saved >= least:
                        out.append((saved, k, first))
        return sorted(out, key=lambda x: (-x[0], x[1], x[2]))

    def confirm(self, k: int, first: int, found: list[Word]) -> tuple[int, int, int, int] | None:
        """Whether the wording of a candidate is the template's, but for small differences: first and last word, missing and added ones."""
        _, must, words = self.words[k]
        room, need = [w for w, _, _ in found[first : first + 2 * len(words)]], COVERAGE * len(words)
        if not must <= set(room) or (Counter(words) & Counter(room)).total() < need:
            return None
        match = [m for m in SequenceMatcher(None, words, room, autojunk=False).get_matching_blocks() if m.size]
        same = [i for m in match for i in range(m.b, m.b + m.size)]
        kept = {words[i] for m in match for i in range(m.a, m.a + m.size)}
        inside = set(same)
        extra = [w for i, w in enumerate(room[: same[-1] + 1]) if i >= same[0] and i not in inside]
        if must <= kept and len(same) >= need and not TELLING & set(extra):
            return first + same[0], first + same[-1], len(words) - len(same), len(extra)
        return None

    def findings(self, found: list[Word], least: int = 1) -> Iterator[Finding]:
        """Confirmed candidates of a block, those that save most first."""
        taken: dict[int, list[tuple[int, int]]] = {}
        for _, k, first in self.ranked(found, least):
            if any(a <= first <= b for a, b in taken.get(k, ())):
                continue
            # Which of a template's first words saves most may hang on a byte: the first one that reads best counts.
            places = [self.confirm(k, i, found) for i in range(max(0, first - 2), first + 1) if found[i][0] in self.words[k][2][:3]]
            place = min((p for p in places if p), key=lambda p: (p[2] + p[3], p[0]), default=None)
            if place:
                a, b, missing, added = place
                taken.setdefault(k, []).append((a, b))
                yield Finding(self.words[k][0], found[a][1], found[b][2], self.saved(k, found[a : b + 1]), missing, added)

    def tagged(self, begin: int, block: str) -> list[Finding]:
        """Every known identifier of the SPDX tags of the block."""
        return [
            Finding(self.tags[m.group()], begin + m.start(), begin + m.end(), 0, 0, 0)
            for tag in TAG.finditer(block)
            for m in re.compile(r"[a-z0-9.+-]+").finditer(block, *tag.span(1))
            if m.group() in self.tags
        ]

    def scan(self, text: str) -> list[Finding]:
        """Licenses of a text by place; of findings that overlap, the one whose template saves most of its place stays."""
        lowered = text.translate(_LOWER)
        found = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(lowered)]
        out: list[Finding] = self.tagged(0, lowered)
        for first, last in blocks(CUE.finditer(lowered), found, self.longest):
            out += self.findings(found[first:last])
        return chosen(out)


def chosen(found: list[Finding]) -> list[Finding]:
    """Findings that don't overlap, by place: those that save most first, then those with least different, then the longer ones."""
    out: list[Finding] = []
    for f in sorted(set(found), key=lambda f: (-f.saved, f.missing + f.added, f.start - f.end, f.license)):
        if all(f.end <= g.start or g.end <= f.start for g in out):
            out.append(f)
    return sorted(out, key=lambda f: f.start)


def scan_licenses(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Find license notices in every whole text.

    In the blocks around license words every place where a template may begin is compressed by
    zstandard, alone and with the template as a raw dictionary. Where that saves bytes the
    wording is compared word by word, the most saved first; a notice counts if no telling word
    of another license stands between and few words differ. Of notices that overlap the one stays whose template saves most of its
    place. SPDX tags give the known identifiers that they name.

    Returns the columns of ``df`` (those that clash with the new names give way) and
    ``licenses`` (distinct identifiers, sorted, comma-joined), ``n_notices`` long, ``notices``
    (array of license, start, end in code points, saved bytes, missing and added words).
    Defined cases: null and empty texts have no notice; very long
    texts are scanned whole; repeated rows are scanned each; empty input gives no rows.
    """
    arrow_batches(df.sparkSession)
    kind = "struct<licenses:string,n_notices:long,notices:array<struct<license:string,start:int,end:int,saved:int,missing:int,added:int>>>"

    @F.pandas_udf(kind)
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = TemplateScanner()
        for texts in parts:
            rows = []
            for text in texts:
                found = scanner.scan(text) if text and CUE.search(text) else []
                rows.append((",".join(sorted({f.license for f in found})), len(found), [vars(f) for f in found]))
            yield pd.DataFrame(rows, columns=["licenses", "n_notices", "notices"])

    inner, col, restored = shield(df)
    new = ["licenses", "n_notices", "notices"]
    found = inner.withColumn("found", scan(col(text_col)))
    return found.select(*[c for c, n in zip(restored, df.columns, strict=True) if n not in new], "found.*")
