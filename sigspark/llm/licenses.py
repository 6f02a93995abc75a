"""License scans by conditional compression.

A candidate block is a run of lines of a text in which a licensing word occurs
(lines less than GAP apart are one block; of a line over LONG characters, what is
within AROUND characters of such a word).  Case and punctuation are put aside.  Each block is compressed alone and with every
template as a raw zstandard dictionary; the templates are ranked by the share of the
block's compressed size that they save.  All that save anything are then confirmed by wording:
the block's words are aligned with the template's, and a template wins where
the share of its words found in order is at least WORDING.  The differences are
reported word by word, and the version that stands where the template has one.

A notice may begin before its first licensing word and end after its last one, so
templates are aligned in the block and the longest template's words (and half
as many) on both sides; what stands before and after a confirmed template is read
again, so each license of a block is reported, at its own place.

Every line of every text is looked at where it lies, nothing is shuffled.

Defined results: null and empty texts have no block; a block that no template
explains is reported as ``unknown``; ties go to the larger share of words, then to
the first template by name; repeated rows are reported row by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines between two licensing words of one block; least share of a template's words.
GAP, WORDING = 3, 0.75
#: Characters of a line that is cut into several blocks, and of such a block on either side of a licensing word
#: (a notice is aligned with the words around its block, so it may reach beyond).
LONG, AROUND = 4000, 800
#: zstandard level.
LEVEL = 19

# Wording of public license notices, by SPDX name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD notice": "Released under the BSD License",
    "CC-BY": "Licensed under CC BY 4.0",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND": "Licensed under CC BY-ND 4.0",
    "CC-BY-SA": "Licensed under CC BY-SA 4.0",
    "CC-BY long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work",
    "GPL": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "AGPL": "This work is licensed under the GNU Affero General Public License, version 3",
    "LGPL": "This work is licensed under the GNU Lesser General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
#: Words of the longest template, and characters in which as many are looked for on either side of a block.
LONGEST = max(len(t.split()) for t in TEMPLATES.values()) * 3 // 2
WIDE = 40 * LONGEST
LICENSING = r"licen[cs]e|licen[cs]ing|copyright|spdx|creative commons|public domain|permission is hereby|permission to use|redistribution and use|\bcc by\b|\bcc0\b|all rights reserved"

FIND = re.compile(LICENSING, re.I)
PIECE = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+")


@cache
def _compressors():
    import zstandard

    alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    raw = zstandard.DICT_TYPE_RAWCONTENT
    given = {k: zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(" ".join(pieces(t)).encode(), dict_type=raw)) for k, t in TEMPLATES.items()}
    return alone, given


def ranked(block: str) -> list[tuple[float, str]]:
    """(share of the compressed size saved, template), best first."""
    alone, given = _compressors()
    data = " ".join(pieces(block)).encode()
    size = len(alone.compress(data))
    return sorted(((1 - len(c.compress(data)) / size, k) for k, c in given.items()), key=lambda x: (-x[0], x[1]))


def pieces(text: str) -> list[str]:
    return PIECE.findall(text.lower())


@cache
def _wording(name: str) -> tuple[str, ...]:
    return tuple(pieces(TEMPLATES[name]))


def wording(block: list[str], name: str) -> tuple[float, str, str, str]:
    """(share of the template's words that the block has in order, version, words it lacks, words put between)."""
    want = _wording(name)
    ops = SequenceMatcher(None, want, block, autojunk=False).get_opcodes()
    lacks = [w for op, a, z, _, _ in ops if op in ("replace", "delete") for w in want[a:z]]
    equal = [o for o in ops if o[0] == "equal"]
    lo, hi = (equal[0][3], equal[-1][4]) if equal else (0, 0)
    more = [w for op, _, _, a, z in ops if op in ("replace", "insert") for w in block[max(a, lo) : min(z, hi)]]
    version = ""
    for op, a, z, c, d in ops:
        for w in want[a:z]:
            if w[0].isdigit() and op != "delete":
                version = w if op == "equal" else next((x for x in block[c:d] if x[0].isdigit()), "")
    return 1 - len(lacks) / len(want), version, " ".join(lacks), " ".join(more)


def candidate_blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """(first line, number of lines, block) around licensing words."""
    for first, lines, lo, hi in _blocks(text):
        yield first, lines, text[lo:hi]


def _blocks(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(first line, number of lines, first character, last + 1) of candidate blocks."""
    first = last = None
    lo = hi = at = 0
    for i, line in enumerate(text.split("\n")):
        start, at = at, at + len(line) + 1
        if not FIND.search(line):
            continue
        if len(line) > LONG:
            if first is not None:
                yield first, last - first + 1, lo, hi
                first = None
            for a, z in _stretches(line):
                yield i, 1, start + a, start + z
            continue
        if first is not None and i - last >= GAP:
            yield first, last - first + 1, lo, hi
            first = None
        if first is None:
            first, lo = i, start
        last, hi = i, start + len(line)
    if first is not None:
        yield first, last - first + 1, lo, hi


def _stretches(line: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for m in FIND.finditer(line):
        lo, hi = max(0, m.start() - AROUND), min(len(line), m.end() + AROUND)
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], hi
        else:
            out.append((lo, hi))
    return out


def explain(block: str) -> tuple[str, str, float, float, str, str]:
    """(license, version, saved, wording, lacks, more) of the template that explains a block best, or unknown."""
    words, order = pieces(block), ranked(block)
    won = [(share, saved, -k, name, version, lacks, more) for k, (saved, name) in enumerate(order) if saved > 0 for share, version, lacks, more in [wording(words, name)] if share >= WORDING]
    if not won:
        return "unknown", "", order[0][0], 0.0, "", ""
    share, saved, _, name, version, lacks, more = max(won)
    return name, version, saved, share, lacks, more


def _place(words: list[str], name: str) -> tuple[int, int]:
    """The words around the longest run that they share with a template, with room for half as many more."""
    want = _wording(name)
    m = SequenceMatcher(None, want, words, autojunk=False).find_longest_match()
    room = len(want) // 2
    return max(0, m.b - m.a - room), min(len(words), m.b - m.a + len(want) + room)


def _notices(text: str, spans: list[tuple[int, int]], words: list[str], lo: int, hi: int, a: int, z: int) -> Iterator[tuple[int, int, tuple]]:
    """(first word, last + 1, explanation) of templates confirmed in words lo to hi that meet the block, words a to z."""
    if not FIND.search(text[spans[a][0] : spans[z - 1][1]]):
        return
    order = ranked(" ".join(words[a:z]))
    saves = dict((name, saved) for saved, name in order)
    names = [k for saved, k in order if saved > 0]
    names += [k for saved, k in ranked(" ".join(words[lo:hi])) if saved > 0 and k not in names]
    won = []
    for k, name in enumerate(names):
        x, y = _place(words[lo:hi], name)
        share, version, lacks, more = wording(words[lo + x : lo + y], name)
        if share < WORDING:
            continue
        same = [b for b in SequenceMatcher(None, _wording(name), words[lo + x : lo + y], autojunk=False).get_matching_blocks() if b.size]
        first, last = lo + x + same[0].b, lo + x + same[-1].b + same[-1].size
        if first < z and last > a:
            won.append((share, saves[name], -k, first, last, (name, version, saves[name], share, lacks, more)))
    if not won:
        return
    *_, first, last, found = max(won)
    if a < first:
        yield from _notices(text, spans, words, lo, first, a, first)
    yield first, last, found
    if last < z:
        yield from _notices(text, spans, words, last, hi, last, z)


def notices(text: str) -> Iterator[tuple]:
    """(first line, lines, license, version, saved, wording, lacks, more, notice): every template confirmed around a candidate block, or what explains the block."""
    done = 0  # what notices of the block before reach to
    for first, lines, lo, hi in _blocks(text):
        block = text[lo:hi]
        base = min(lo, max(0, done, lo - WIDE))
        left = [m.span() for m in PIECE.finditer(text[base : lo])][-LONGEST:]
        spans = [(base + x, base + y) for x, y in left]
        a = len(spans)
        spans += [(lo + m.start(), lo + m.end()) for m in PIECE.finditer(block)]
        z = len(spans)
        spans += [(hi + m.start(), hi + m.end()) for m in PIECE.finditer(text[hi : hi + WIDE])][:LONGEST]
        if hi <= done or a == z:  # a part of a notice reported with the block before
            continue
        words = [text[x:y].lower() for x, y in spans]
        found = list(_notices(text, spans, words, 0, len(words), a, z))
        if not found:
            yield first, lines, *explain(block), block
            continue
        for x, y, why in found:
            start, stop = spans[x][0], spans[y - 1][1]
            done = max(done, stop)
            if len(found) == 1 and a <= x and y <= z:
                yield first, lines, *why, block
            else:
                line = first + text.count("\n", lo, start) if start >= lo else first - text.count("\n", start, lo)
                yield line, text.count("\n", start, stop) + 1, *why, text[start:stop]


def scan(docs: DataFrame, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """A row for each candidate block: ``keep``, first_line, n_lines, license, version, saved, wording, lacks, more, notice."""
    rows = docs.where(F.col(text).rlike(f"(?i){LICENSING}")).select(*keep, F.col(text).alias("__text"))
    n = len(rows.columns) - 1
    fields = "first_line long, n_lines long, license string, version string, saved double, wording double, lacks string, more string, notice string"
    schema = rows.drop("__text").schema
    for f in fields.split(", "):
        schema = schema.add(*f.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out = [], []
            for r, text in enumerate(b.column(n).to_pylist()):
                for found in notices(text):
                    row.append(r)
                    out.append(found)
            cols = list(zip(*out, strict=True)) if out else [()] * 9
            kinds = [pa.int64()] * 2 + [pa.string()] * 2 + [pa.float64()] * 2 + [pa.string()] * 3
            kept = [c.take(pa.array(row, pa.int64())) for c in b.columns[:n]]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=schema.names)

    return rows.mapInArrow(run, schema)
