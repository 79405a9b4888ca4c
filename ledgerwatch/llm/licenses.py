"""License scans by conditional compression.

A passage that repeats a license compresses far better once the compressor has read that license. Candidate blocks are runs of sentences or lines with a word that license texts use; windows of each template's length slide
over them (and as far beyond as the template reaches). Every window is compressed alone and with each template of that length as a zstandard raw dictionary, and the templates are ranked by what they save, as a share
of the template's own size. All that save enough go to the wording check: a stretch of the window's words no longer than the template and what may be added to it, holding enough of the template's words and all its
telling ones (numbers and names that tell licenses apart, such as ``2.0``, ``3``, ``nc``), is aligned with the template, and the words that are missing, added or changed are listed. A confirmed passage must itself shrink by
its template. Each occurrence is a finding; of findings of one license that overlap, the one that shrinks most stands.

A plain regular expression leaves documents without a candidate out before any Python runs. Whole texts are read. Null and empty texts have no block. Ties fall to the first template and place. Rights reserved in
the heading of a license's text are reported beside it. There is no shuffle, and equal texts give equal results; repeated rows are rows of their own. Very long texts are scanned as wholes, in time that grows
with the blocks that they hold. An empty table gives an empty result; columns other than the key and the text are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Share by which a template must shrink its passage, and share of its own compressed size that it must save in a window.
LEAST_REDUCTION, LEAST_SAVED = 0.25, 0.1
#: Words of a window; a template takes the first that is half as long again as its longest passage. Windows overlap by two thirds, so each passage lies whole in one.
WINDOWS = sorted(k << n for k in (9, 12) for n in range(9))
#: Share of a template's words that must stand in the passage, in order.
LEAST_WORDING = 0.85
#: Templates of fewer words may lack one.
SHORT = 8
#: Words of a notice at most; longer templates are texts.
NOTICE = 16
#: Words a passage may have besides, as a share of the template's.
MOST_ADDED = 0.3
# Each template keeps a cue when one of its words is left out; separators are any that the wording may have, so that a line break in a cue hides nothing.
CUES = (
    r"(?i)licen[cs]|copyright|permission|warrant|redistribut|spdx|liab|all\W+rights|rights\W+reserved|unencumbered|public\W+domain|creative\W+commons"
    r"|source\W+and\W+binary|\bcc\W*(?:by|0)|\b(?:gnu|apache|mozilla|eclipse|boost|bsd)\b|\bunder\W+(?:\w+\W+){0,2}mit\b"
)
SENTENCE = regex.compile(r"(?<=[.!?;:])[ \t]+|\n+")
TOKEN = regex.compile(r"[\p{L}\p{N}]+(?:\.\p{N}+)*")

# License notices and texts, in lower case.
TEMPLATES = {
    "MIT": [
        "released under the mit license.",
        "licensed under the mit license.",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions:",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software. the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "spdx-license-identifier: mit",
    ],
    "Apache-2.0": [
        "licensed under the apache license, version 2.0.",
        "released under the apache license 2.0.",
        "licensed under the apache license, version 2.0 (the \"license\"); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0",
        "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied.",
        "spdx-license-identifier: apache-2.0",
        "apache license version 2.0, january 2004 http://www.apache.org/licenses/",
        "subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare derivative works of, publicly display, publicly perform, sublicense, and distribute the work and such derivative works in source or object form.",
    ],
    "GPL-3.0": [
        "this work is licensed under the gnu general public license, version 3.",
        "released under the gnu general public license version 3.",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version.",
        "spdx-license-identifier: gpl-3.0",
        "gnu general public license version 3, 29 june 2007",
    ],
    "GPL-2.0": [
        "this work is licensed under the gnu general public license, version 2.",
        "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version.",
        "spdx-license-identifier: gpl-2.0",
        "gnu general public license version 2, june 1991",
    ],
    "LGPL-3.0": [
        "this library is licensed under the gnu lesser general public license, version 3.",
        "spdx-license-identifier: lgpl-3.0",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version.",
        "gnu lesser general public license version 3, 29 june 2007",
    ],
    "LGPL-2.1": [
        "this library is licensed under the gnu lesser general public license, version 2.1.",
        "spdx-license-identifier: lgpl-2.1",
        "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version.",
        "gnu lesser general public license version 2.1, february 1999",
    ],
    "AGPL-3.0": [
        "this program is licensed under the gnu affero general public license, version 3.",
        "spdx-license-identifier: agpl-3.0",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version.",
        "gnu affero general public license version 3, 19 november 2007",
    ],
    "MPL-2.0": [
        "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/.",
        "licensed under the mozilla public license, version 2.0.",
        "mozilla public license version 2.0 1. definitions",
        "spdx-license-identifier: mpl-2.0",
    ],
    "EPL-2.0": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "eclipse public license - v 2.0 the accompanying program is provided under the terms of this eclipse public license (\"agreement\"). any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement.",
        "licensed under the eclipse public license, version 2.0.",
        "spdx-license-identifier: epl-2.0",
    ],
    "BSL-1.0": [
        "distributed under the boost software license, version 1.0.",
        "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"software\") to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following:",
        "spdx-license-identifier: bsl-1.0",
    ],
    "Zlib": [
        "this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software.",
        "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "spdx-license-identifier: zlib",
    ],
    # what all BSD licenses begin with; the clauses tell them apart
    "BSD": [
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "BSD-2-Clause": [
        "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. this software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties",
        "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. this software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties",
        "released under the bsd 2-clause license.",
        "spdx-license-identifier: bsd-2-clause",
    ],
    "BSD-3-Clause": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "released under the bsd 3-clause license.",
        "spdx-license-identifier: bsd-3-clause",
    ],
    "ISC": ["permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "spdx-license-identifier: isc"],
    "Unlicense": ["this is free and unencumbered software released into the public domain.", "spdx-license-identifier: unlicense"],
    "CC0-1.0": ["released under cc0 1.0.", "licensed under cc0 1.0 universal public domain dedication.", "spdx-license-identifier: cc0-1.0"],
    "CC-BY-4.0": [
        "licensed under cc by 4.0.",
        "this work is licensed under the creative commons attribution 4.0 international license.",
        "you accept and agree to be bound by the terms and conditions of this creative commons attribution 4.0 international public license",
        "spdx-license-identifier: cc-by-4.0",
    ],
    "CC-BY-SA-4.0": [
        "licensed under cc by-sa 4.0.",
        "this work is licensed under the creative commons attribution-sharealike 4.0 international license.",
        "you accept and agree to be bound by the terms and conditions of this creative commons attribution-sharealike 4.0 international public license",
        "spdx-license-identifier: cc-by-sa-4.0",
    ],
    "CC-BY-NC-4.0": [
        "licensed under cc by-nc 4.0.",
        "this work is licensed under the creative commons attribution-noncommercial 4.0 international license.",
        "you accept and agree to be bound by the terms and conditions of this creative commons attribution-noncommercial 4.0 international public license",
        "spdx-license-identifier: cc-by-nc-4.0",
    ],
    "CC-BY-ND-4.0": [
        "licensed under cc by-nd 4.0.",
        "this work is licensed under the creative commons attribution-noderivatives 4.0 international license.",
        "you accept and agree to be bound by the terms and conditions of this creative commons attribution-noderivatives 4.0 international public license",
        "spdx-license-identifier: cc-by-nd-4.0",
    ],
    "CC-BY-NC-SA-4.0": [
        "licensed under cc by-nc-sa 4.0.",
        "this work is licensed under the creative commons attribution-noncommercial-sharealike 4.0 international license.",
        "you accept and agree to be bound by the terms and conditions of this creative commons attribution-noncommercial-sharealike 4.0 international public license",
        "spdx-license-identifier: cc-by-nc-sa-4.0",
    ],
    "CC-BY-NC-ND-4.0": [
        "licensed under cc by-nc-nd 4.0.",
        "this work is licensed under the creative commons attribution-noncommercial-noderivatives 4.0 international license.",
        "you accept and agree to be bound by the terms and conditions of this creative commons attribution-noncommercial-noderivatives 4.0 international public license",
        "spdx-license-identifier: cc-by-nc-nd-4.0",
    ],
    "proprietary": ["copyright. all rights reserved.", "all rights reserved. no part of this work may be reproduced without written permission."],
}
# Words that tell licenses apart; one in the template must be in the block, and the other way round within the aligned part.
TELLING = frozenset("mit apache gnu lesser affero general mozilla bsd cc cc0 by sa nc nd sharealike noncommercial noderivatives spdx gpl lgpl agpl mpl eclipse epl boost bsl isc zlib unlicense".split())

#: Windows of so many words are compressed by the level that finds every short match; of longer ones the usual level saves enough to tell.
CLOSELY = 18


def level(words: int) -> int:
    return 13 if words <= CLOSELY else 3


PLAIN = {k: zstandard.ZstdCompressor(level=k, write_content_size=False, write_checksum=False) for k in (3, 13)}


def compressor(text: str, k: int = 3) -> zstandard.ZstdCompressor:
    """One that has read ``text``."""
    read = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    read.precompute_compress(level=k)
    return zstandard.ZstdCompressor(level=k, write_content_size=False, write_checksum=False, write_dict_id=False, dict_data=read)


class Template:
    def __init__(self, name: str, k: int, text: str):
        self.name, self.k, self.words = name, k, TOKEN.findall(text)
        self.bag = Counter(self.words)
        self.telling = Counter({w: n for w, n in self.bag.items() if tells(w)})
        self.least = next(n for n in range(len(self.words) + 1) if enough(n, len(self.words)))
        self.reach = len(self.words) + int(MOST_ADDED * len(self.words))
        self.window = next(w for w in WINDOWS if 2 * w >= 3 * self.reach)
        k, form = level(self.window), " ".join(self.words)
        self.own, self.form, self.size = compressor(text), compressor(form, k), len(PLAIN[k].compress(form.encode()))

    def windows(self, words: list[str], bag: Counter) -> list[int]:
        """Where a passage can start: at a word of the template, with enough of its words and all its telling words within reach."""
        if any(bag.get(w, 0) < n for w, n in self.telling.items()) or sum(min(n, bag.get(w, 0)) for w, n in self.bag.items()) < self.least:
            return []
        at = [i for i, w in enumerate(words) if w in self.bag]
        have, common, told, end, out = Counter(), 0, 0, 0, []
        for i in at:
            while end < len(at) and at[end] < i + self.reach:
                w = words[at[end]]
                common += have[w] < self.bag[w]
                told += have[w] < self.telling[w]
                have[w] += 1
                end += 1
            if common >= self.least and told == self.telling.total():
                out.append(i)
            w = words[i]
            have[w] -= 1
            common -= have[w] < self.bag[w]
            told -= have[w] < self.telling[w]
        return out

    def passages(self, words: list[str], bag: Counter) -> list[tuple[int, int, dict]]:
        """First word, end and differences of each passage with the template's wording; of those that overlap, the one with the fewest differences."""
        out, best = [], None
        for i in self.windows(words, bag):
            if best and i >= best[1]:
                out.append(best)
                best = None
            if out and i < out[-1][1] or best and not best[2]["missing"] and not best[2]["added"]:
                continue
            # what follows can draw a notice's words away from their place, so all ends are tried; the longest run of a text holds its place
            for end in range(self.reach, self.least - 1, -1) if len(self.words) <= NOTICE else [self.reach]:
                if found := wording(self.words, words[i : i + end]):
                    break
            if found:
                a, b, diff = found
                if not best or (diff["matched"], -len(diff["added"])) > (best[2]["matched"], -len(best[2]["added"])):
                    best = (i + a, i + b, diff)
        return [*out, best] if best else out


class Scanner:
    def __init__(self):
        self.cue = regex.compile(CUES)
        self.templates = [Template(name, k, text) for name in sorted(TEMPLATES) for k, text in enumerate(TEMPLATES[name])]
        self.by_window = {w: [t for t in self.templates if t.window == w] for w in WINDOWS}

    def blocks(self, text: str) -> list[tuple[int, str]]:
        """Offset and text of each run of sentences with a cue."""
        spans, at = [], 0
        for m in SENTENCE.finditer(text):
            spans.append((at, m.start()))
            at = m.end()
        spans.append((at, len(text)))
        cues = [m.span() for m in self.cue.finditer(text)]
        out, run, k = [], None, 0
        for a, b in spans:
            while k < len(cues) and cues[k][1] <= a:
                k += 1
            if k < len(cues) and cues[k][0] < b:
                run = (run[0] if run else a, b)
            elif run:
                out.append((run[0], text[run[0] : run[1]]))
                run = None
        return [*out, (run[0], text[run[0] : run[1]])] if run else out

    def windows(self, blocks: list[tuple[int, str]], starts: list[int]) -> list[tuple[int, int, int]]:
        """(size, first word, end) of the windows over the blocks, which reach a window's length beyond them; ``starts``: where words start."""
        ranges = [(bisect_left(starts, at), bisect_left(starts, at + len(block))) for at, block in blocks]
        out = []
        for size, templates in self.by_window.items():
            done = -1
            for first, end in ranges if templates else []:
                at, end = max(0, first - size, done), min(len(starts), end + size)
                while at < end:
                    out.append((size, at, min(at + size, len(starts))))
                    if at + size >= end:
                        break
                    at += size // 3
                done = max(done, at + size // 3)
        return out

    def ranked(self, words: list[str], size: int) -> list[tuple[float, Template]]:
        """Templates of a window by what each saves, as a share of its own size."""
        raw = " ".join(words).encode()
        plain = len(PLAIN[level(size)].compress(raw))
        saved = [((plain - len(t.form.compress(raw))) / t.size, t) for t in self.by_window[size]]
        return sorted((x for x in saved if x[0] >= LEAST_SAVED), key=lambda x: -x[0])

    def scan(self, text: str) -> tuple[int, list[dict]]:
        blocks = self.blocks(text) if text else []
        if not blocks:
            return 0, []
        spans = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        words, places = [text[a:b].lower() for a, b in spans], {}
        for size, lo, hi in self.windows(blocks, [a for a, _ in spans]):
            near = words[lo:hi]
            bag = Counter(near)
            for _, t in self.ranked(near, size):
                for i, j, diff in t.passages(near, bag):
                    places[t.name, t.k, lo + i, lo + j] = (t, diff)
        return len(blocks), self.findings(text, spans, places)

    def findings(self, text: str, spans: list[tuple[int, int]], places: dict) -> list[dict]:
        """What shrinks by its template; of overlapping passages of one license the one with most of its words, then that which shrinks most."""
        found = []
        for (name, k, i, j), (t, diff) in places.items():
            at, end = spans[i][0], spans[j - 1][1]
            raw = " ".join(text[at:end].lower().split()).encode()
            gain = 1 - len(t.own.compress(raw)) / len(PLAIN[3].compress(raw))
            if gain >= LEAST_REDUCTION:
                lacking = len(diff["missing"]) + len(diff["added"])
                found.append(((-(diff["matched"] - lacking), -gain, k, at), {"license": name, "template": k, "offset": at, "length": end - at, "reduction": round(gain, 6), **diff}))
        taken: dict[str, list[tuple[int, int]]] = {}
        out = []
        for _, f in sorted(found, key=lambda x: x[0]):
            own = taken.setdefault(f["license"], [])
            span = (f["offset"], f["offset"] + f["length"])
            k = bisect_left(own, span)
            if (k and own[k - 1][1] > span[0]) or (k < len(own) and own[k][0] < span[1]):
                continue
            own.insert(k, span)
            out.append(f)
        return sorted(out, key=lambda f: (f["offset"], -f["reduction"], f["license"]))


def tells(word: str) -> bool:
    return word in TELLING or word[0].isdigit()


def enough(kept: int, wanted: int) -> bool:
    return kept >= LEAST_WORDING * wanted or wanted < SHORT and wanted - kept <= 1


def wording(wanted: list[str], words: list[str]) -> tuple[int, int, dict] | None:
    """Where the template's wording is among the words, and how it differs; None if too little of it is there, or a telling word differs."""
    runs = [m for m in SequenceMatcher(None, wanted, words, autojunk=False).get_matching_blocks() if m.size]
    # runs at either end may be words of a neighbour; the longest stretch of runs that is right counts
    for first, last in sorted(((p, q) for p in range(len(runs)) for q in range(p, len(runs))), key=lambda x: x[0] - x[1]):
        some = runs[first : last + 1]
        if not enough(sum(m.size for m in some), len(wanted)):
            continue
        kept = {i for m in some for i in range(m.a, m.a + m.size)}
        used = {i for m in some for i in range(m.b, m.b + m.size)}
        start, end = some[0].b, some[-1].b + some[-1].size
        missing = [w for i, w in enumerate(wanted) if i not in kept]
        added = [w for i, w in enumerate(words[start:end], start) if i not in used]
        if not any(map(tells, missing)) and not any(map(tells, added)) and len(added) <= MOST_ADDED * len(wanted):
            return start, end, {"matched": len(kept), "missing": missing, "added": added}
    return None


_scanners: list[Scanner] = []
FINDING = "license:string,template:int,offset:int,length:int,reduction:double,matched:int,missing:array<string>,added:array<string>"
FINDINGS = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("offset", pa.int32()), ("length", pa.int32()), ("reduction", pa.float64()), ("matched", pa.int32()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))]))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_blocks`` (candidates) and ``findings`` (license, place, size reduction, wording differences) of every row."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not _scanners:
            _scanners.append(Scanner())
        done = [_scanners[0].scan(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in done], pa.int32()), pa.array([x for _, x in done], FINDINGS)], [key, "n_blocks", "findings"])

    likely = df.select(key, F.when(F.col(text).rlike(CUES), F.col(text)).alias("t"))
    return map_batches(likely, lambda: run, f"`{key}` {key_type}, n_blocks int, findings array<struct<{FINDING}>>")


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_blocks, n_findings, licenses (names in order, joined by commas), best_reduction, differing_words, findings (JSON)."""
    found = scan(docs)
    return found.select(
        "doc_id",
        F.col("n_blocks").cast("long").alias("n_blocks"),
        F.size("findings").cast("long").alias("n_findings"),
        F.array_join(F.array_sort(F.array_distinct(F.col("findings.license"))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.col("findings.reduction")), F.lit(0.0)).alias("best_reduction"),
        F.aggregate("findings", F.lit(0), lambda n, x: n + F.size(x["missing"]) + F.size(x["added"])).cast("long").alias("differing_words"),
        F.to_json("findings").alias("findings"),
    )
