"""License scans by conditional compression.

A candidate block is a run of sentences with a license cue; where a block holds
no whole notice, blocks at most GAP characters apart and the words BEFORE and
AFTER them are looked at together, so wrapped notices and whole texts are found.
Blocks are compressed with zstandard
alone and with each template as a raw dictionary, and templates are ranked by
the bytes they save. Each template that saves a share of REDUCTION of what it
saves on its own text is then aligned, best first, to the part of the block
that is most like it, and confirmed by the exact differences of wording: the
template's words that the part lacks and the part's words that the template
lacks, in order. Decisive words (versions, lesser, affero, library, nc, nd, sa)
must be the same. A block may hold several confirmed notices; their parts don't
overlap. A notice that a word like "not" leads in, in its sentence, isn't one.
Tags (SPDX-License-Identifier, its first name) and names that fill a line of
their own count as notices too. Where no notice is confirmed, a template whose
decisive words clash with the block's isn't reported.

A template's parts are found by one count of its word pairs in the block, from
which the pairs of each part found are taken off, so the work is linear in the
block, however many notices it holds.

Cases: null and empty texts, and texts without a cue, have no row; a block
without a confirmed notice has one row, with the template that saves most (null
if none saves enough); repeated rows are scanned each by itself; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import accumulate
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches

# Wordings of common licenses, in natural order.
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_REST = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
#: Names and versions of the GNU licenses, their files of whole texts where there is one.
_GNU = (("GPL", "General", "2", "GPL-2"), ("GPL", "General", "3", "GPL-3"), ("LGPL", "Lesser General", "2.1", "LGPL-2.1"), ("LGPL", "Lesser General", "3", "LGPL-3"), ("AGPL", "Affero General", "3", None))
_GNU_NOTICE = "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."
_CREATIVE = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
RESERVED = "All-Rights-Reserved"
_DECISIVE = {"lesser", "library", "affero", "nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike"}
_VERSIONED = {"version", "v", "license", "licence", "gpl", "lgpl", "agpl", "gplv", "mpl", "apache", "by", "sa", "nc", "nd", "cc0", "zero", "sharealike", "noncommercial", "noderivatives", "attribution", "international"}
# What a sentence of a license notice mentions.
CUES = r"licen[cs]|copyright|\brights reserved\b|permission (is hereby|to use)|\bwarrant(y|ies)\b|\bSPDX\b|redistribut|public domain|\bCC (BY|0)|\bCC0\b|free software|\b[AL]?GPL|creative commons"
#: Characters between blocks that are looked at together, and before and after them.
GAP, BEFORE, AFTER = 4000, 200, 900
#: Template words that may be missing, and words that may be added, as shares of the template, for a confirmed notice; up to FEW words may be added to any.
MISSING, ADDED, FEW = 0.1, 0.35, 3
#: Of what a template saves on its own text, the share that it must save on a block.
REDUCTION = 0.4
LEVEL = 3
SCHEMA = "doc_id long, start long, end long, license string, reduction double, confirmed boolean, missing string, added string, candidates array<string>"

_CUE = re.compile(CUES, re.IGNORECASE)
_END = re.compile(r"[.!?](?=\s|$)|\n")
_WORD = re.compile(r"\w+(?:[-.]\w+)*")


def _made() -> list[tuple[str, str]]:
    """All templates: whole texts, notices and references."""
    whole = lambda name: (files(__package__) / "license_texts" / f"{name}.txt").read_text()
    out = [("MIT", f"{_MIT} {_MIT_WARRANTY}"), ("MIT", _MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License.")]
    out += [("Apache-2.0", whole("Apache-2.0")), ("Apache-2.0", f"{_APACHE} {_APACHE_REST}"), ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0.")]
    for short, kind, version, file in _GNU:
        name = f"{short}-{version}" if "." in version else f"{short}-{version}.0"
        out += [(name, whole(file))] if file else []
        out += [(name, _GNU_NOTICE.format(what=what, colon=colon, comma=comma, kind=kind, version=version)) for what, colon, comma in (("program", ":", ","), ("library", ";", ";"))]
        out += [(name, f"This work is licensed under the GNU {kind} Public License, version {version}."), (name, f"Released under the {short}v{version}.")]
    out += [("MPL-2.0", whole("MPL-2.0")), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.")]
    out += [("BSD-3-Clause", f"{_BSD_TERMS} {_BSD_NAMES} {_BSD_WARRANTY}"), ("BSD-2-Clause", f"{_BSD_TERMS} {_BSD_WARRANTY}"), ("ISC", f"{_ISC} {_ISC_WARRANTY}"), ("ISC", _ISC)]
    for short, long in _CREATIVE:
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out += [(f"CC-{short}-{version}", f"Licensed under CC {short} {version}."), (f"CC-{short}-{version}", f"This work is licensed under a Creative Commons {long} {version} International License."), (f"CC-{short}-{version}", f"Creative Commons {long} {version}.")]
    out += [("CC0-1.0", whole("CC0-1.0")), ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."), (RESERVED, "All rights reserved.")]
    return out


def _named() -> list[tuple[str, str]]:
    """Tags, names and short references."""
    out = [("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0"), ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0")]
    out += [("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."), ("BSL-1.0", "Boost Software License, Version 1.0"), ("Unlicense", "This is free and unencumbered software released into the public domain.")]
    out += [("Apache-2.0", "Licensed under the Apache License 2.0."), ("Apache-2.0", "Apache License, Version 2.0"), ("MIT", "MIT License"), ("ISC", "ISC License")]
    for short, _, version, _ in _GNU:
        name = f"{short}-{version}" if "." in version else f"{short}-{version}.0"
        out += [(name, f"Licensed under the {short} v{version}."), *((name, f"{TAG}: {name}-{kind}") for kind in ("only", "or-later"))]
    names = dict.fromkeys(x for x, _ in TEMPLATES + out if x != RESERVED)
    return out + [(x, f"{TAG}: {x}") for x in names]


TEMPLATES = _made()
#: What leads in an identifier.
TAG = "SPDX-License-Identifier"
EVERY = TEMPLATES + _named()
#: Templates that begin with the tag; names that count only where they fill a line.
_TAGGED = {k for k, (_, text) in enumerate(EVERY) if text.startswith(TAG)}
_ALONE = {k for k, (_, text) in enumerate(EVERY) if k >= len(TEMPLATES) and text in ("MIT License", "ISC License", "Boost Software License, Version 1.0", "Apache License, Version 2.0")}
_NOT = re.compile(r"\b(?:not|never|neither|isn't|aren't|wasn't)\b[^.!?\n]*$", re.IGNORECASE)
#: Characters before a notice where a word that denies it may stand, and of a block whose judgement is kept for the next one like it.
DENIED, KEPT = 40, 4096


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def decisive(words: list[str]) -> set[str]:
    """The words of a notice that may not differ: kinds, and versions near the words that announce them."""
    parts = [p for w in words for p in (w.split("-") if not w[0].isdigit() else [w])]
    out = {p for p in parts if p in _DECISIVE}
    for k, p in enumerate(parts):
        if p in _VERSIONED:
            out |= {x.removesuffix(".0") for x in parts[k + 1 : k + 3] if re.fullmatch(r"\d(\.\d)?", x)}
        if found := re.fullmatch(r"(?:[al]?gpl)?v(\d(?:\.\d)?)", p):
            out.add(found[1].removesuffix(".0"))
    return out


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of runs of sentences that have a cue; sentences end at . ! ? before white space, and at line feeds."""
    out: list[tuple[int, int]] = []
    at = 0
    while found := _CUE.search(text, at):
        begin = max(text.rfind("\n", at, found.start()) + 1, at)
        for stop in _END.finditer(text, begin, found.start()):
            begin = stop.end()
        stop = _END.search(text, found.end())
        end = len(text) if stop is None else stop.end() - (stop[0] == "\n")
        begin += len(text[begin:end]) - len(text[begin:end].lstrip())
        if out and not text[out[-1][1] : begin].strip():
            out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
        at = end
    return out


@lru_cache(maxsize=1)
def _prepared():
    """The plain compressor, and of each template its compressor, what it saves on its own text, words, decisive words and places of word pairs."""
    import zstandard as z

    def made(text: bytes | None):
        raw = {} if text is None else {"dict_data": z.ZstdCompressionDict(text, dict_type=z.DICT_TYPE_RAWCONTENT)}
        return z.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **raw)

    alone, out = made(None), []
    for _, text in EVERY:
        data = " ".join(text.split()).encode()
        given, words, pairs = made(data), _words(text), defaultdict(list)
        for k in range(len(words) - 1):
            pairs[words[k], words[k + 1]].append(k)
        out.append((given, len(alone.compress(data)) - len(given.compress(data)), words, decisive(words), pairs))
    return alone, out


class Votes:
    """Offsets of parts of ``words`` that are like a template, by the word pairs they share with it; kept up to date as parts are claimed."""

    def __init__(self, length: int, pairs: dict, words: list[str]):
        self.step, self.pairs, self.words, self.count = max(8, length // 3), pairs, words, defaultdict(int)
        self._add(0, len(words) - 1, 1)
        self.heap = [(-n, b) for b, n in self.count.items()]
        heapify(self.heap)

    def _add(self, begin: int, end: int, by: int) -> None:
        for j in range(begin, end):
            for i in self.pairs.get((self.words[j], self.words[j + 1]), ())[:16]:
                b = (j - i) // self.step
                self.count[b] += by
                self.count[b + 1] += by

    def best(self) -> int | None:
        """The offset with most votes, the smallest of equals; None without votes."""
        while self.heap and self.count[self.heap[0][1]] != -self.heap[0][0]:
            _, b = heappop(self.heap)
            if self.count[b]:
                heappush(self.heap, (-self.count[b], b))
        return self.heap[0][1] if self.heap else None

    def claim(self, first: int, end: int) -> None:
        begin, stop = max(0, first - 1), min(end, len(self.words) - 1)
        self._add(begin, stop, -1)
        self.words[first:end] = [""] * (end - first)
        self._add(begin, stop, 1)


def aligned(wanted: list[str], votes: Votes) -> tuple[int, int, list[str], list[str]] | None:
    """(first, last + 1, missing, added): the part of the words most like ``wanted``; None if no two words in a row agree.

    Word pairs vote for the offset of the part, then matching runs near it are
    joined as long as they outweigh the words between them.
    """
    b, words, step = votes.best(), votes.words, votes.step
    if b is None:
        return None
    low, high = max(0, (b - 1) * step - 4), min(len(words), (b + 1) * step + len(wanted) + 4)
    runs = [r for r in SequenceMatcher(None, wanted, words[low:high], autojunk=False).get_matching_blocks() if r.size]
    best, score, begin, last = (0.0, 0, 0), 0.0, 0, None
    for k, r in enumerate(runs):
        between = 0 if last is None else 0.5 * (r.b - last.b - last.size) + 0.25 * (r.a - last.a - last.size)
        if score - between <= 0:
            score, begin, between = 0.0, k, 0
        score, last = score - between + r.size, r
        best = max(best, (score, begin, k + 1), key=lambda x: x[0])
    kept = runs[best[1] : best[2]]
    if not kept:
        return None
    first, end = kept[0].b + low, kept[-1].b + kept[-1].size + low
    mine, theirs = {r.a + k for r in kept for k in range(r.size)}, {r.b + low + k for r in kept for k in range(r.size)}
    return first, end, [w for k, w in enumerate(wanted) if k not in mine], [words[k] for k in range(first, end) if k not in theirs]


def _fills_line(window: str, begin: int, end: int) -> bool:
    """Whether a span stands in a line with signs and white space only."""
    before, after = window.rfind("\n", 0, begin) + 1, window.find("\n", end)
    return not re.search(r"\w", window[before:begin]) and not re.search(r"\w", window[end : len(window) if after < 0 else after])


def judge(window: str) -> tuple[tuple[tuple[int, int, str, float, str, str], ...], str | None, float, tuple[str, ...]]:
    """(confirmed notices as (start, end, license, reduction, missing, added); best license, its reduction and all names by reduction) of a block's text."""
    return _short(window) if len(window) <= KEPT else _judged(window)


def _judged(window: str):
    alone, prepared = _prepared()
    data = " ".join(window.split()).encode()
    size = len(alone.compress(data))
    tagged = "spdx" in window.lower()
    saved = [(size - len(given.compress(data)), k) for k, (given, *_) in enumerate(prepared) if tagged or k not in _TAGGED]
    ranked = sorted(((s, k) for s, k in saved if s >= REDUCTION * prepared[k][1]), key=lambda x: (-x[0], x[1]))
    found = list(_WORD.finditer(window))
    words, out = [m[0].lower() for m in found], []
    whole = decisive(words)
    for s, k in ranked:
        _, own, wanted, must, pairs = prepared[k]
        votes = Votes(len(wanted), pairs, words)
        while part := aligned(wanted, votes):
            first, end, missing, added = part
            few = 0 if k in _TAGGED or k in _ALONE else max(FEW, ADDED * len(wanted))
            good = len(missing) <= MISSING * len(wanted) and len(added) <= few and "" not in added
            if not good or decisive(words[first:end]) != must:
                break
            start, stop = found[first].start(), found[end - 1].end()
            votes.claim(first, end)
            if k in _ALONE and not _fills_line(window, start, stop) or _NOT.search(window[max(0, start - DENIED) : start]):
                continue
            stop += len(window[stop : stop + 3]) - len(window[stop : stop + 3].lstrip(".)\"'/"))
            out.append((start, stop, EVERY[k][0], min(1.0, s / own), " ".join(missing), " ".join(added)))
    names = tuple(dict.fromkeys(EVERY[k][0] for _, k in ranked))
    if any(x[2] != RESERVED for x in out):
        out = [x for x in out if x[2] != RESERVED]
    agree = [x for x in ranked if not whole or not prepared[x[1]][3] or whole & prepared[x[1]][3]]
    best = agree[0] if agree else None
    return tuple(sorted(out)), best and EVERY[best[1]][0], min(1.0, best[0] / prepared[best[1]][1]) if best else 0.0, names


_short = lru_cache(maxsize=4096)(_judged)  # at most 16 million characters


def notices(text: str) -> list[tuple]:
    """(start, end, license, reduction, confirmed, missing, added, candidates) of a text's blocks."""
    out, groups = [], []
    for block in blocks(text):
        if groups and block[0] - groups[-1][-1][1] <= GAP:
            groups[-1].append(block)
        else:
            groups.append([block])
    for group in groups:
        judged = [(a, b, judge(text[a:b])) for a, b in group]
        sure = [(a + x[0], a + x[1], *x[2:], names) for a, _, (found, _, _, names) in judged for x in found]
        if not all(found and not any(x[4] for x in found) for _, _, (found, *_) in judged):
            low, high = max(0, group[0][0] - BEFORE), min(len(text), group[-1][1] + AFTER)
            found, *_, names = judge(text[low:high])
            if sum(x[1] - x[0] for x in found) > sum(x[1] - x[0] for x in sure):
                sure = [(low + x[0], low + x[1], *x[2:], names) for x in found]
        out += [(a, b, name, share, True, missing, added, list(names)) for a, b, name, share, missing, added, names in sure]
        sure.sort(key=lambda x: x[:2])
        starts, ends = [x[0] for x in sure], list(accumulate((x[1] for x in sure), max))
        clear = lambda a, b: not (n := bisect_left(starts, b)) or ends[n - 1] <= a
        out += [(a, b, best, share, False, "", "", list(names)) for a, b, (_, best, share, names) in judged if clear(a, b)]
    return sorted(set((*x[:7], tuple(x[7])) for x in out), key=lambda x: x[:2])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string())]
    for batch in batches:
        rows = [(i, *x) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for x in notices(text)]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def scan(docs: DataFrame) -> DataFrame:
    """A row for each confirmed notice, and for each block without one: doc_id, start, end (code points, end exclusive), license, reduction (of what its template saves on itself), confirmed, missing, added, candidates (by reduction)."""
    small_batches(docs.sparkSession)
    return docs.filter(F.col("text").rlike(f"(?i){CUES}")).select("doc_id", "text").mapInArrow(_scan, SCHEMA)
