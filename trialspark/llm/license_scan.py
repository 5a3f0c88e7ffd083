"""License scans by conditional compression, confirmed by exact wording differences."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution."
)
_BSD_3 = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)


def _gnu(kind: str, version: str, what: str = "program") -> list[str]:
    return [
        f"This work is licensed under the GNU {kind}General Public License, version {version}.",
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}"
        f"General Public License as published by the Free Software Foundation, either version {version} of the "
        "License, or (at your option) any later version.",
    ]


# Wording of common license statements, one list per license.
TEMPLATES = {
    "AGPL-3.0": _gnu("Affero ", "3"),
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", _BSD_2],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        _BSD_2 + _BSD_3,
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": [
        "Licensed under CC0 1.0.",
        "This work is licensed under the CC0 1.0 Universal Public Domain Dedication.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work.",
    ],
    "GPL-2.0": _gnu("", "2"),
    "GPL-3.0": _gnu("", "3"),
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-2.1": _gnu("Lesser ", "2.1", "library"),
    "LGPL-3.0": _gnu("Lesser ", "3", "library"),
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Words of which a candidate block has one at least; every template has one.
CUES = r"(?i)licen[sc]e|permission|redistribut|free\W+software|waived|public\W+domain"
SHARE = 0.9  # of a template's words that must stand in a block, in order

WORD = re.compile(r"[a-z0-9.]*[a-z0-9]")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@lru_cache(maxsize=1)
def compressors():
    plain = zstandard.ZstdCompressor(level=19, write_content_size=False, write_checksum=False, write_dict_id=False)
    known = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            # A raw dictionary needs eight bytes; the template is repeated as context only once.
            raw = zstandard.ZstdCompressionDict(" ".join(words(text)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own = zstandard.ZstdCompressor(
                level=19, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            known.append((name, words(text), own))
    return plain, known


def differences(block: list[str], template: list[str]) -> tuple[float, int, int]:
    """Share of the template's words found in order, and the first and last place they take in the block."""
    found = [m for m in SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks() if m.size]
    if not found:
        return 0.0, 0, 0
    return sum(m.size for m in found) / len(template), found[0].a, found[-1].a + found[-1].size


def reduction(block: list[str], plain, own) -> float:
    """Share of the block's compressed size that the template as raw dictionary saves."""
    data = " ".join(block).encode()
    alone = len(plain.compress(data))
    return (alone - len(own.compress(data))) / alone


def slack(n: int) -> int:
    """Words around a template of n words that may belong to its wording in a text."""
    return max(8, 3 * n // 10 + 1)


@lru_cache(maxsize=1 << 12)
def confirm(block: tuple[str, ...], which: int) -> tuple[float, float, int, int] | None:
    """``share, reduction, first, last`` of a template in a block, or None if its wording is another one."""
    plain, known = compressors()
    _, template, own = known[which]
    # No order of words can give a share above that of the words in common.
    if (Counter(block) & Counter(template)).total() < SHARE * len(template):
        return None
    share, first, last = differences(list(block), template)
    if share < SHARE or abs(last - first - len(template)) > 0.2 * len(template) + 1:
        return None
    return share, reduction(list(block[first:last]), plain, own), first, last


def wordings(text: list[str]) -> Iterator[tuple[int, float, int, float, str, int, int]]:
    """Each place of a candidate block where a template's wording is confirmed.

    A wording lacks at most one word in ten, so of one more than that many of
    the template's words one at least stands in its place: the places of its
    longest words are all places to look at, in a line of any length.
    """
    at: dict[str, list[int]] = {}
    for i, w in enumerate(text):
        at.setdefault(w, []).append(i)
    for which, (name, template, _) in enumerate(compressors()[1]):
        n, wide = len(template), slack(len(template))
        anchors = sorted(range(n), key=lambda i: -len(template[i]))[: int((1 - SHARE) * n + 1e-9) + 1]
        for start in sorted({i - k for k in anchors for i in at.get(template[k], ())}):
            lo = max(0, start - wide)
            if found := confirm(tuple(text[lo : max(0, start + n + wide)]), which):
                share, gain, first, last = found
                yield round(share * n), share, -abs(last - first - n), gain, name, lo + first, lo + last


def scan_block(text: list[str]) -> list[tuple[str, float, float]]:
    """``license, reduction, share of wording`` of every license statement in one block.

    Every template is compared word by word at every place where it may stand.
    Of statements whose wording overlaps (version 2 and 3, two and three
    clauses), the one with more words there wins, then the one with the greater
    share of its own, then the one that as raw dictionary saves more of the
    compressed size of these words.  Compression orders and is reported; it
    excludes nothing, and no number of statements ends the scan.
    """
    out, starts, ends = [], [], []
    best_first = sorted(set(wordings(text)), key=lambda x: (*(-v for v in x[:4]), *x[4:]))
    for _, share, _, gain, name, first, last in best_first:
        i = bisect_right(starts, first)  # places taken do not overlap, so both lists are in order
        if (i == 0 or ends[i - 1] <= first) and (i == len(starts) or last <= starts[i]):
            starts.insert(i, first)
            ends.insert(i, last)
            out.append((name, gain, share))
    return out


def candidates(text: list[str]) -> Iterator[list[str]]:
    """Runs of words around cues, far enough on both sides for every template.

    Line breaks, white space and comment signs are between words, so a wrapped
    statement is one run of words; runs that touch are one block.
    """
    most = max(len(template) for _, template, _ in compressors()[1])
    reach = most + slack(most)
    line = " ".join(text)
    ends = list(accumulate(len(w) + 1 for w in text))
    lo = hi = 0
    for m in re.finditer(CUES, line):
        at = bisect_right(ends, m.start())
        if at - reach > hi and hi:
            yield text[lo:hi]
            hi = 0
        lo, hi = lo if hi else max(0, at - reach), min(len(text), at + reach)
    if hi:
        yield text[lo:hi]


def scan_text(text: str | None) -> tuple[int, list[tuple[str, float, float]]]:
    """The number of candidate blocks and, for each license, its best reduction and wording share."""
    n, best = 0, {}
    for block in candidates(words(text or "")):
        n += 1
        for name, gain, share in scan_block(block):
            best[name] = max(best.get(name, (share, gain)), (share, gain))
    return n, [(name, round(best[name][1], 6), round(best[name][0], 6)) for name in sorted(best)]


SCHEMA = "doc_id long, n_candidates long, licenses array<string>, reductions array<double>, shares array<double>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [scan_text(t) for t in batch.column("text").to_pylist()]
        arrays = [
            batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()),
            pa.array([[x[0] for x in f] for _, f in found], pa.list_(pa.string())),
            pa.array([[x[1] for x in f] for _, f in found], pa.list_(pa.float64())),
            pa.array([[x[2] for x in f] for _, f in found], pa.list_(pa.float64())),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_candidates", "licenses", "reductions", "shares"])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_candidates, licenses, reductions, shares`` for every row of ``docs``.

    A block is a run of words around cues, over any number of lines.  Texts without a cue are told apart before Python sees
    them; null and empty texts have no licenses.  Repeated rows give repeated
    results, an empty table none.
    """
    cued = F.col("text").rlike(CUES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(cued, F.col("text")).alias("text"))
    return rows.mapInArrow(_scan, SCHEMA)
