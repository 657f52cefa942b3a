"""License scans by conditional compression.

Blocks of a text that have a cue word are candidates. For each template, a block's runs of sentences
about as long as it, and the block whole, are compressed alone and with the template as a raw
zstandard dictionary. Where that saves enough of the template's own compressed size, the exact
differences in wording decide: enough of the template's words must stand there in order, and no word
that tells licenses apart (numbers and the like) may differ. A block can hold several licenses.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import appended, id_text, table

#: Wordings of public licenses and notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Proprietary-notice": "All rights reserved.",
}
#: Words that tell licenses apart, besides all that hold a digit.
TELLING = {"affero", "lesser", "library", "by", "nc", "nd", "sa", "cc0", "mit", "apache", "mozilla", "bsd", "isc", "gnu", "not"}
CUE = re.compile(r"licen[cs]|copyright|\(c\)|all rights reserved|distribut|can obtain|permission|public domain|spdx|subject to the|warrant", re.I)
SENTENCE = re.compile(r"\n|(?<=[.;:!?])\s+(?=[A-Z\"(]|[0-9]{1,2}[.)]\s)")
WORD = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
LIST_NUMBER = re.compile(r"^\s*\(?(?:[0-9]{1,2}|[a-z])[.)](?=\s|$)")
#: Sentences without a cue that a block may hold between two with one.
GAP = 2
LEAST_REDUCTION, LEAST_WORDS = 0.25, 0.9


def words_of(text: str) -> list[str]:
    """A list's number at the start is layout, not a word."""
    return WORD.findall(LIST_NUMBER.sub("", text.lower()))


@lru_cache(maxsize=1)
def compressors() -> list[tuple[str, list[str], object, int]]:
    """Name, words, compressor and own compressed size of each template."""
    import zstandard

    of = lambda text: zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    return [(name, words_of(text), of(text), len(plain().compress(text.encode()))) for name, text in TEMPLATES.items()]


@lru_cache(maxsize=1)
def plain() -> object:
    import zstandard

    return zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False)


def sentences_of(text: str) -> list[tuple[int, int]]:
    edges = [0, *(x for m in SENTENCE.finditer(text) for x in m.span()), len(text)]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]


def candidates(text: str) -> list[tuple[int, int]]:
    """Start and end of each block: sentences or lines with a cue, with those between near ones."""
    if not CUE.search(text):
        return []
    sentences = sentences_of(text)
    out: list[tuple[int, int]] = []
    last = -GAP - 2
    for i, (a, b) in enumerate(sentences):
        if CUE.search(text, a, b):
            if out and i - last <= GAP + 1:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            last = i
    return out


def differences(template: list[str], block: list[str], after: list[str]) -> tuple[int, int, bool]:
    """Words of the template that the block lacks; words of the block between the first and last it
    shares that the template lacks; whether a telling word is among either. after: words that follow."""
    ops = difflib.SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    shared = [x for x in ops if x[0] == "equal"]
    if not shared:
        return len(template), 0, True
    first, last = shared[0][3], shared[-1][4]
    lacks = [w for op, a, b, _, _ in ops if op in ("delete", "replace") for w in template[a:b]]
    more = [w for op, _, _, a, b in ops if op in ("insert", "replace") for w in block[max(a, first) : min(b, last)]]
    # What follows right after the last shared word still belongs to a name or version.
    tail = [*block, *after][last : last + 2]
    telling = any(w in TELLING or w[0].isdigit() for w in [*lacks, *more, *(tail if lacks else ())])
    return len(lacks), len(more), telling


def runs(sizes: list[int], words: int) -> list[tuple[int, int]]:
    """First and end of the runs of sentences (sizes: their words) that can hold so many words: the
    least ones with enough, the next longer ones, and all."""
    out, j, held = {(0, len(sizes))}, 0, 0
    for i, n in enumerate(sizes):
        while j < len(sizes) and held < LEAST_WORDS * words:
            held += sizes[j]
            j += 1
        if held >= LEAST_WORDS * words:
            out |= {(i, j), (i, min(j + 1, len(sizes)))}
        held -= n
    return sorted(out)


def notices(block: str) -> list[tuple[int, int, str, float, int, int]]:
    """(start, end, license, part of the template's compressed size that it saves, words lacking,
    words more) of each confirmed place. Of places that overlap the one with most of its template's
    words counts."""
    places = sentences_of(block)
    said = [words_of(block[a:b]) for a, b in places]
    have = {w for x in said for w in x}
    alone: dict[str, int] = {}
    found = []
    for name, words, c, own in compressors():
        if sum(w not in have for w in words) > (1 - LEAST_WORDS) * len(words):
            continue
        for i, j in runs([len(x) for x in said], len(words)):
            a, b = places[i][0], places[j - 1][1]
            here = [w for x in said[i:j] for w in x]
            if sum(w not in here for w in set(words)) > (1 - LEAST_WORDS) * len(words):
                continue
            text = block[a:b]
            raw = text.encode()
            if text not in alone:
                alone[text] = len(plain().compress(raw))
            part = (alone[text] - len(c.compress(raw))) / own
            if part < LEAST_REDUCTION:
                continue
            lacks, more, telling = differences(words, here, [w for x in said[j : j + 2] for w in x][:2])
            if not telling and lacks <= (1 - LEAST_WORDS) * len(words) and more <= (1 - LEAST_WORDS) * len(words):
                found.append((lacks + more - len(words), b - a, a, b, name, part, lacks, more))
    out: list[tuple[int, int, str, float, int, int]] = []
    for _, _, a, b, *what in sorted(found):
        if all(b <= x[0] or x[1] <= a for x in out):
            out.append((a, b, *what))
    return sorted(out)


def judged(block: str) -> tuple[str, float, int, int] | None:
    """The first of a block's notices, without its place."""
    return next((x[2:] for x in notices(block)), None)


def scan(docs: DataFrame) -> DataFrame:
    """docs with _blocks (how many candidates) and _found: start, end, license, reduction, lacking and
    more of each confirmed one, in order of place (code points).

    A null or empty text has no blocks; equal rows are alike; an empty table gives none.
    """

    def start() -> Callable[[list], list[list]]:
        def make(texts: list) -> list[list]:
            n, found = [], []
            for text in texts:
                blocks = candidates(text or "")
                n.append(len(blocks))
                found.append([{"start": a + x[0], "end": a + x[1], "license": x[2], "reduction": round(x[3], 4), "lacking": x[4], "more": x[5]} for a, b in blocks for x in notices(text[a:b])])
            return [n, found]

        return make

    return appended(docs, "text", "_blocks long, _found array<struct<start: long, end: long, license: string, reduction: double, lacking: long, more: long>>", start)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """found: license:start:end:lacking:more of each, comma-joined."""
    out = scan(id_text(table(spark, sf_dir, "documents")))
    said = F.transform("_found", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"], x["lacking"], x["more"]))
    return out.select("doc_id", F.col("_blocks").alias("n_blocks"), F.size("_found").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(F.col("_found.license"))), ",").alias("licenses"), F.array_join(said, ",").alias("found"))
