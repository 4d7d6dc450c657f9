"""License scan by conditional compression.

Blocks of text near a license word, of all lines up to a blank one, are compressed plainly and with each template as
a zstandard raw dictionary. A template is a candidate if it shrinks the block by a share of what it saves where it stands
whole in other text; so neither the length of the block nor that of the template matters. The candidates are tried by falling
reduction, and the first whose wording is confirmed wins: the exact differences between the template and the stretch of
the block that it aligns with. What it covers is taken out and the rest of the block is ranked again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewise.llm.common import map_text, read

# Public license notices and texts, as (license id, template).
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software.")
_MIT_DISCLAIMER = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
                   "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
                   "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
                   "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
           "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
           "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
           "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.")
_GNU = ("This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free "
        "Software Foundation{comma} either version {version} of the License, or (at your option) any later version.")
_TEXTS = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _MIT), ("MIT", f"{_MIT} {_MIT_DISCLAIMER}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"{_APACHE} See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", _GNU.format(what="program", mark=";", name="GNU General Public License", comma=";", version="2")),
    ("GPL-3.0", _GNU.format(what="program", mark=":", name="GNU General Public License", comma=",", version="3")),
    ("LGPL-2.1", _GNU.format(what="library", mark=";", name="GNU Lesser General Public License", comma=";", version="2.1")),
    ("LGPL-3.0", _GNU.format(what="program", mark=":", name="GNU Lesser General Public License", comma=",", version="3")),
    ("AGPL-3.0", _GNU.format(what="program", mark=":", name="GNU Affero General Public License", comma=",", version="3")),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
             "redistribute it freely, subject to the following restrictions"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
                     "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
                     "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
                     "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]
#: License id and the names by which notices call it.
_NAMES = {
    "MIT": ["MIT License"], "ISC": ["ISC License"], "Zlib": ["zlib License"], "Unlicense": ["The Unlicense"], "0BSD": ["BSD Zero Clause License"],
    "Apache-2.0": ["Apache License 2.0", "Apache License Version 2.0", "Apache 2.0 License"], "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"], "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License Version 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License Version 2.0"], "BSL-1.0": ["Boost Software License 1.0"],
    "EUPL-1.2": ["EUPL Version 1.2", "licensed under EUPL 1.2", "European Union Public License 1.2"], "CC0-1.0": ["under CC0 1.0", "under CC0-1.0"],
    **{f"{a}GPL-{v}": [f"GNU {b}General Public License Version {v.removesuffix('.0')}", f"GNU {b}General Public License v{v}",
                       *(f"{verb} {a}GPL{x}{v.removesuffix('.0')}" for verb in ("under", "under the", "under the GNU") for x in ("v", " v", " version ")),
                       f"{a}GPLv{v.removesuffix('.0')} license"]
       for a, b, v in (("", "", "2.0"), ("", "", "3.0"), ("L", "Lesser ", "2.1"), ("L", "Lesser ", "3.0"), ("A", "Affero ", "3.0"))},
    **{f"CC-{k}-{v}": [f"CC {k} {v}", f"CC-{k} {v}", f"CC-{k}-{v}", f"Licensed under CC-{k} {v}"] for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")}}

TEMPLATES = _TEXTS + [(i, f"SPDX-License-Identifier: {i}") for i in _NAMES] + [(i, n) for i, names in _NAMES.items() for n in names]

TRIGGER = r"licen[cs]|copyright|rights reserved|permission|redistribut|public domain|creative commons|free software|unencumbered|\bcc[- ]?(?:by|0)\b|spdx|\b[al]?gpl|eupl"
_TRIGGER = re.compile(TRIGGER, re.IGNORECASE)
_WORD = re.compile(r"\w+(?:[.+-]\w+)*")
#: A line without a word character between two lines, also behind a comment mark.
_GAP = re.compile(r"\n[^\w\n]*(?=\n)")
#: Blocks that come within so many characters are one; a block reaches at least so far around its license words.
REACH = 160
#: Most words of a template that may be missing or changed, as a share.
MOST_DIFFERENT = 0.15
#: Least reduction of a candidate, as a share of what its template saves where it stands whole.
LEAST_SHARE = 0.4
#: Longest template that is looked for in stretches of that many characters on either side of a license word. Longer ones
#: are looked for in the whole block, where the few bytes that a short one saves would be lost among others.
SHORT, NEAR = 100, 200
#: Text in which a template's own saving is measured, as letters cost less in a longer text than alone.
_AROUND = "the quick brown fox jumps over the lazy dog while five boxing wizards pack my box with two dozen liquor jugs and sphinxes of black quartz judge a vow "


def _parameters() -> zstandard.ZstdCompressionParameters:
    """The same search with and without a dictionary, so that sizes differ by its matches alone."""
    return zstandard.ZstdCompressionParameters(window_log=17, chain_log=15, hash_log=13, search_log=5, min_match=4, target_length=16,
                                               strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_dict_id=False)


def _folded(text: str) -> str:
    return text.casefold().replace("licence", "license")


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(_folded(m.group()).strip("."), m.start(), m.end()) for m in _WORD.finditer(text)]


class Templates:
    """The compressors and words of all templates."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.plain = zstandard.ZstdCompressor(compression_params=_parameters())
        self.all = []
        for name, text in templates:
            folded = _folded(text)
            # a raw dictionary of under 8 bytes would not be used
            with_it = zstandard.ZstdCompressor(compression_params=_parameters(), dict_data=zstandard.ZstdCompressionDict(
                folded.encode().rjust(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            whole = (_AROUND + folded + " " + _AROUND[::-1]).encode()
            saving = max(1, len(self.plain.compress(whole)) - len(with_it.compress(whole)))
            self.all.append((name, [w for w, _, _ in _words(text)], len(text), with_it, saving))
        #: Room for the longest template with comment marks and list numbers.
        self.reach = max([REACH, *(t[2] * 5 // 4 for t in self.all)])

    def rank(self, block: str) -> list[tuple[int, float, int]]:
        """(bytes saved, share of the template's own saving, template) of all candidates, the largest reduction first."""
        near: list[list[int]] = []
        for m in _TRIGGER.finditer(block):
            if not near or m.end() + NEAR // 2 > near[-1][1]:
                near.append([max(0, m.start() - NEAR), m.end() + NEAR])
        parts = {True: [_folded(block[a:b]).encode() for a, b in near], False: [_folded(block).encode()]}
        sizes = {k: [len(self.plain.compress(p)) for p in v] for k, v in parts.items()}
        found = []
        for i, (_, _, length, with_it, own) in enumerate(self.all):
            short = length <= SHORT
            saved = max((n - len(with_it.compress(p)) for n, p in zip(sizes[short], parts[short], strict=True)), default=0)
            if saved >= LEAST_SHARE * own:
                found.append((saved, saved / own, i))
        return sorted(found, key=lambda x: (-x[0], -x[1], x[2]))


def _list_number(text: str, start: int, end: int) -> bool:
    """A number of one or two digits in front of an item: 1. or 1) or (1)."""
    return end - start <= 2 and text[start:end].isdigit() and text[end:end + 1] in (".", ")") and not text[end + 1:end + 2].strip()


def wording(template: list[str], words: list[tuple[str, int, int]], text: str) -> tuple[int, int, list[str]]:
    """First and end word of the aligned stretch, and its differences from the template. Numbers of list items are none."""
    plain = [w for w, _, _ in words]
    pairs = [b for b in SequenceMatcher(None, template, plain, autojunk=False).get_matching_blocks() if b.size]
    if not pairs:
        return 0, 0, [f"-{w}" for w in template]
    # the stretch around the longest common run, as far as the template reaches
    core, slack = max(pairs, key=lambda b: b.size), 3 + int(MOST_DIFFERENT * len(template))
    lo, hi = max(0, core.b - core.a - slack), core.b + len(template) - core.a + slack
    pairs = [b for b in SequenceMatcher(None, template, plain[lo:hi], autojunk=False).get_matching_blocks() if b.size]
    first, end = lo + pairs[0].b, lo + pairs[-1].b + pairs[-1].size
    out = []
    for op, i, j, k, m in SequenceMatcher(None, template, plain[first:end], autojunk=False).get_opcodes():
        if op != "equal":
            added = [w for w, a, b in words[first + k:first + m] if op != "insert" or not _list_number(text, a, b)]
            out += [f"-{w}" for w in template[i:j]] + [f"+{w}" for w in added]
    return first, end, out


def blocks(text: str, reach: int = REACH) -> list[tuple[int, int]]:
    """Stretches of ``reach`` characters around license words, ended by blank lines, joined where they come within REACH."""
    gaps = [m.span() for m in _GAP.finditer(text)]
    starts, ends = [a for a, _ in gaps], [b for _, b in gaps]
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        before, after = bisect_right(ends, m.start()), bisect_left(starts, m.end())
        lo = max(0, m.start() - reach, ends[before - 1] if before else 0)
        hi = min(len(text), m.end() + reach, starts[after] if after < len(starts) else len(text))
        if out and lo <= out[-1][1] + REACH:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


#: Words that tell licenses apart: numbers, marks of CC, names of families.
_TELLING = re.compile(r"[-+](?:.*\d.*|by|nc|sa|nd|by-.*|cc.*|lesser|affero|mit|apache|bsd|mozilla|eclipse|boost|isc|zlib|unlicense|eupl|[al]?gpl.*|attribution-.*)")


def _differs(differences: list[str], size: int) -> bool:
    """Too many differences, or one in a telling word."""
    return len(differences) > MOST_DIFFERENT * size or any(_TELLING.fullmatch(d) for d in differences)


def _confirmed(known: Templates, i: int, text: str) -> tuple[int, int, list[str]] | None:
    """First and end character and differences of the stretch that has the wording of template ``i``."""
    words, template = _words(text), known.all[i][1]
    first, end, differences = wording(template, words, text)
    if end == first or _differs(differences, len(template)):
        return None
    return words[first][1], words[end - 1][2], differences


def scan_block(known: Templates, block: str, at: int) -> list[dict]:
    """Confirmed licenses of a block: the first candidate that is confirmed wins, and is taken out wherever it stands."""
    found, todo = [], [(block, at)]
    while todo:
        text, base = todo.pop()
        for _, share, i in known.rank(text):
            pieces, rest = [(text, base)], []
            while pieces:
                piece, start = pieces.pop()
                hit = _confirmed(known, i, piece) if _TRIGGER.search(piece) else None
                if hit is None:
                    rest.append((piece, start))
                    continue
                lo, hi, differences = hit
                found.append({"license": known.all[i][0], "start": start + lo, "end": start + hi, "reduction": round(share, 4),
                              "exact": not differences, "differences": differences})
                pieces += [(piece[:lo], start), (piece[hi:], start + hi)]
            if len(rest) > 1 or rest[0][0] is not text:
                todo += [(t, b) for t, b in rest if _TRIGGER.search(t)]
                break
    return found


def _windows(known: Templates, lo: int, hi: int):
    """A long block in pieces that overlap by the longest template."""
    size = 4 * known.reach
    step = size - 2 * known.reach
    for a in range(lo, max(lo + 1, hi - 2 * known.reach), step):
        yield a, min(a + size, hi)


def scan(text: str, known: Templates) -> tuple[int, list[dict]]:
    """Number of candidate blocks and the licenses found in a text, by place; of finds that overlap the one nearest to its template."""
    spans = blocks(text, known.reach)
    found: list[dict] = []
    for lo, hi in spans:
        here = [x for a, b in _windows(known, lo, hi) for x in scan_block(known, text[a:b], a)]
        kept: list[dict] = []
        for x in sorted(here, key=lambda x: (len(x["differences"]), x["start"] - x["end"], x["start"])):
            # those kept do not overlap, so only the neighbours in their order can
            k = bisect_left(kept, x["start"], key=lambda y: y["start"])
            if (k == 0 or kept[k - 1]["end"] <= x["start"]) and (k == len(kept) or x["end"] <= kept[k]["start"]):
                kept.insert(k, x)
        found += kept
    return len(spans), sorted(found, key=lambda x: x["start"])


FINDING = T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                        T.StructField("reduction", T.DoubleType()), T.StructField("exact", T.BooleanType()),
                        T.StructField("differences", T.ArrayType(T.StringType()))])
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()),
                             ("exact", pa.bool_()), ("differences", pa.list_(pa.string()))]))
FIELDS = [T.StructField("n_blocks", T.LongType()), T.StructField("licenses", T.ArrayType(T.StringType())),
          T.StructField("findings", T.ArrayType(FINDING))]


def license_scan(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",),
                 templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Candidate blocks, distinct license ids and findings of each text, one row per input row.

    A finding has the license id, its first and end character in the text, the winning
    template's size reduction (as a share of what it saves where it stands whole), and the words missing (-) or added (+) against
    the template. Null and empty texts have no block; equal findings at one place count once. A long block is
    scanned in windows of four times the longest template, so the work grows with the length of a text.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(t: pa.Array) -> list[pa.Array]:
        known = Templates(chosen)
        n = len(t)
        hit = np.flatnonzero(pc.fill_null(pc.match_substring_regex(t, TRIGGER, ignore_case=True), False).to_numpy(zero_copy_only=False))
        count, findings = np.zeros(n, np.int64), [[] for _ in range(n)]
        for i in hit.tolist():
            count[i], findings[i] = scan(t[i].as_py(), known)
        names = [sorted({x["license"] for x in f}) for f in findings]
        return [pa.array(count), pa.array(names, pa.list_(pa.string())), pa.array(findings, _ARROW)]

    return map_text(docs, text, list(carry), FIELDS, run)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))
