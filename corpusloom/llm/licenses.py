"""License scan by conditional compression.

A text is cut into pieces: lines without their comment marks, cut further at sentences and every ``PIECE_WORDS`` words. A piece with a
cue word is the seed of candidate blocks. A block is compressed by zstandard alone and with each license template as raw dictionary;
what the template saves is its rank. For each template that saves anything the block grows over neighbouring pieces, as long as the
template explains a good part of them (``SHARE`` of their compressed size, over up to ``SKIP`` pieces at once). Every template is then
confirmed by the exact differences of wording, those that save most first: all but ``SLACK`` of its words must stand in the block in
order, with few others between, and the words that name the license must all be there. A block may confirm several
licenses whose words don't overlap, so a dual license gives two rows. The differences are part of the result. An SPDX expression gives a seed for each of its
licenses; what stands behind WITH is an exception and none. A short name behind a negation names no license.

Defined results: a null or empty text gives no row; a block that no template confirms gives no row; equal blocks of one text give a
row each; long texts are scanned wholly; repeated rows repeat theirs; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_batch, text_list

CUE = r"licen[sc]|copyright|permission (is hereby|to use)|redistribut|public domain|creative commons|cc[ -]by|cc0|spdx"
SLACK = 0.1
#: Pieces longer than so many words are cut; so many pieces a template may miss between two that it explains; the share of them that it must explain.
PIECE_WORDS, SKIP, SHARE = 40, 2, 0.35
MEMO = 20_000
WORD = re.compile(r"[\w.+-]*\w")
SPDX = re.compile(r"SPDX-License-Identifier:\s*(.*)", re.IGNORECASE)
#: A template of so many words at most is a name rather than a wording; so many words before it may hold a negation.
NAME_WORDS, BEFORE = 8, 4
NEGATIONS = {"not", "no", "nor", "never", "isn", "aren", "without"}
COMMENT = re.compile(r"^\s*(?:/\*+|\*+/|//+|#+|\*+|--+|;+|%+|!+|>+|<!--|dnl\b|REM\b)?\s*|\s*(?:\*/|-->)\s*$")

# --- Fixed values: license, the words that name it, and a wording: public texts, headers, statements and names. ---
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, {1}. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
_GNU_SHORT = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, {1}."
_STATED = "This work is licensed under the {}."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_MPL_END = " If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."


_EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License {0} which is available at https://www.eclipse.org/legal/epl-{1}/"
_EPL_1 = "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"
_CDDL = 'The contents of this file are subject to the terms of the Common Development and Distribution License{0} (the "License"). You may not use this file except in compliance with the License.'
_GFDL = "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version {0} or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."
_WTFPL = "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"
_OFL = "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at: https://openfontlicense.org"


def _gnu() -> list[tuple[str, tuple[str, ...], str]]:
    out = []
    for short, kind, words, versions in (("GPL", "", ("gnu", "general"), ("2", "3")), ("LGPL", "Lesser ", ("lesser",), ("2.1", "3")), ("AGPL", "Affero ", ("affero",), ("3",))):
        for v in versions:
            name = f"{short}-{v}" if "." in v else f"{short}-{v}.0"
            for form in (_GNU, _GNU_SHORT):
                out.append((f"{name}-or-later", (*words, v, "later"), form.format(kind, f"either version {v} of the License, or (at your option) any later version")))
                out.append((name, (*words, v), form.format(kind, f"version {v} of the License")))
            out.append((name, (*words, v), _STATED.format(f"GNU {kind}General Public License, version {v}")))
            out.append((name, (*words, v), f"GNU {kind}General Public License, version {v}"))
            out += [(f"{name}{end}", (f"{name}{end}".lower(),), f"SPDX-License-Identifier: {name}{end}") for end in ("", "-only", "-or-later")]
    return out


def _named() -> list[tuple[str, tuple[str, ...], str]]:
    out = []
    names = (("MIT", ("mit",), "MIT License"), ("ISC", ("isc",), "ISC License"), ("Apache-2.0", ("apache", "2.0"), "Apache License, Version 2.0"), ("BSD-3-Clause", ("bsd", "3-clause"), "BSD 3-Clause License"), ("BSD-2-Clause", ("bsd", "2-clause"), "BSD 2-Clause License"), ("MPL-2.0", ("mozilla", "2.0"), "Mozilla Public License, version 2.0"), ("EPL-2.0", ("eclipse", "2.0"), "Eclipse Public License 2.0"), ("EPL-1.0", ("eclipse", "1.0"), "Eclipse Public License 1.0"), ("Artistic-2.0", ("artistic", "2.0"), "Artistic License 2.0"), ("OFL-1.1", ("font", "1.1"), "SIL Open Font License, Version 1.1"), ("CDDL-1.0", ("distribution", "1.0"), "Common Development and Distribution License, version 1.0"), ("GFDL-1.3", ("documentation", "1.3"), "GNU Free Documentation License, version 1.3"))
    for license_id, needed, name in names:
        out += [(license_id, needed, f"{form}{name}") for form in ("Released under the ", "Licensed under the ", "This work is licensed under the ", "")]
        out.append((license_id, (license_id.lower(), "spdx-license-identifier"), f"SPDX-License-Identifier: {license_id}"))
        out += [(license_id, (license_id.lower(), form.lower()), f"{form} under {license_id}") for form in ("Dual-licensed", "Licensed")]
    out += [(x, (x.lower(), "spdx-license-identifier"), f"SPDX-License-Identifier: {x}") for x in ("Unlicense", "Zlib", "BSL-1.0", "WTFPL", "CDDL-1.1", "GFDL-1.3-or-later", "GFDL-1.3-only")]
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        out.append((f"CC-{kind}-4.0", (kind.lower(), "4.0"), f"Licensed under CC {kind} 4.0."))
        out.append((f"CC-{kind}-4.0", (f"cc-{kind.lower()}-4.0",), f"SPDX-License-Identifier: CC-{kind}-4.0"))
    for kind, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial")):
        out.append((f"CC-{kind}-4.0", (long.lower(), "4.0"), f"This work is licensed under a Creative Commons {long} 4.0 International License."))
    return out


TEMPLATES = (
    ("MIT", ("permission", "hereby", "sublicense"), f"{_MIT} {_AS_IS}"),
    ("MIT", ("permission", "hereby", "sublicense"), _MIT),
    ("MIT", ("permission", "hereby", "restriction"), _MIT.partition(", including")[0]),
    ("BSD-3-Clause", ("redistribution", "endorse"), _BSD + _BSD3 + _BSD_END),
    ("BSD-3-Clause", ("redistribution", "endorse"), _BSD + _BSD3),
    ("BSD-2-Clause", ("redistribution", "binary"), _BSD + _BSD_END),
    ("BSD-2-Clause", ("redistribution", "binary"), _BSD),
    ("ISC", ("permission", "fee", "granted"), _ISC),
    ("Unlicense", ("unencumbered", "commercial"), _UNLICENSE),
    ("Unlicense", ("unencumbered",), _UNLICENSE.partition(" Anyone")[0]),
    ("Zlib", ("as-is", "redistribute"), _ZLIB),
    ("BSL-1.0", ("organization", "derivative"), _BOOST),
    ("Apache-2.0", ("apache", "2.0"), _APACHE),
    ("Apache-2.0", ("apache", "2.0"), _APACHE.partition(" You may obtain")[0]),
    ("MPL-2.0", ("mozilla", "2.0"), _MPL + _MPL_END),
    ("MPL-2.0", ("mozilla", "2.0"), _MPL),
    ("EPL-2.0", ("eclipse", "2.0"), _EPL.format("2.0", "2.0")),
    ("EPL-2.0", ("eclipse", "v2.0"), _EPL.format("v2.0", "v20.html")),
    ("EPL-2.0", ("eclipse", "2.0"), _EPL.format("2.0", "2.0").partition(" which is")[0]),
    ("EPL-1.0", ("eclipse", "v1.0"), _EPL_1),
    ("EPL-1.0", ("eclipse", "v1.0"), _EPL_1.partition(" which accompanies")[0].partition("reserved. ")[2]),
    ("CDDL-1.0", ("development", "distribution", "1.0"), _CDDL.format(", Version 1.0 only")),
    ("CDDL-1.0", ("development", "distribution", "license"), _CDDL.format("")),
    ("GFDL-1.3-or-later", ("documentation", "1.3", "later"), _GFDL.format("1.3")),
    ("GFDL-1.2-or-later", ("documentation", "1.2", "later"), _GFDL.format("1.2")),
    ("WTFPL", ("fuck", "public"), _WTFPL),
    ("WTFPL", ("fuck", "public"), "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("OFL-1.1", ("font", "1.1"), _OFL),
    ("CC0-1.0", ("cc0", "1.0"), "Dedicated to the public domain under CC0 1.0."),
    ("CC0-1.0", ("cc0-1.0",), "SPDX-License-Identifier: CC0-1.0"),
    *_gnu(),
    *_named(),
)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@lru_cache(maxsize=1)
def known_ids() -> frozenset[str]:
    return frozenset(name.lower() for name, _, _ in TEMPLATES)


@lru_cache(maxsize=1)
def _compressors() -> tuple:
    plain, own = zstandard.ZstdCompressor(level=9), []
    for _, _, t in TEMPLATES:
        d = zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=9)
        own.append(zstandard.ZstdCompressor(dict_data=d, level=9))
    return plain, own, [words(t) for _, _, t in TEMPLATES]


@lru_cache(maxsize=MEMO)
def plain_size(block: str) -> int:
    return len(_compressors()[0].compress(block.encode()))


@lru_cache(maxsize=4 * MEMO)
def saving(block: str, template: int) -> int:
    """Bytes that the template saves."""
    return plain_size(block) - len(_compressors()[1][template].compress(block.encode()))


def ranking(block: str) -> list[tuple[int, int]]:
    """(bytes saved, template) of every template that saves some, those that save most first."""
    saved = sorted(((saving(block, i), -i) for i in range(len(TEMPLATES))), reverse=True)
    return [(s, -i) for s, i in saved if s > 0]


def wording(block: list[str], template: list[str]) -> tuple[int, int, list[str], int, int] | None:
    """(template words missing or other, words between that are others, the differences, first and last word in the block); None if nothing agrees."""
    ops = SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    same = [o for o in ops if o[0] == "equal"]
    if not same:
        return None
    lost = sum(b - a for tag, a, b, _, _ in ops if tag in ("delete", "replace"))
    first, last = same[0][3], same[-1][4]
    inner = [(tag, template[a:b], block[max(c, first) : min(d, last)]) for tag, a, b, c, d in ops if tag != "equal"]
    inner = [x for x in inner if x[1] or x[2]]
    return lost, sum(len(x[2]) for x in inner), [f"{tag}:{' '.join(a)}>{' '.join(b)}" for tag, a, b in inner], first, last


def operands(expression: str) -> list[str]:
    """The licenses of an SPDX expression, in their order."""
    out, exception = [], False
    for x in re.findall(r"[A-Za-z0-9.+-]+", expression):
        if x.upper() in ("OR", "AND", "WITH"):
            exception = x.upper() == "WITH"
        elif exception:
            exception = False
        elif not out or not x.islower():  # words of prose behind the tag
            out.append(f"{x[:-1]}-or-later" if x.endswith("+") else x)
    return out


def choices(sentence: str) -> list[str]:
    """A sentence that offers several licenses by their ids, as one sentence for each; none for any other sentence."""
    m = re.search(r"\blicensed under (?:the )?(.+)", sentence, re.IGNORECASE)
    ids = [x for x in re.split(r"\s*(?:[,/]|\bor\b|\band\b)\s*", m[1].strip(" .;:"))] if m else []
    return [sentence[: m.start(1)] + x for x in ids] if len(ids) > 1 and all(x.lower() in known_ids() for x in ids) else []


def pieces(text: str) -> list[tuple[int, str]]:
    """(line, piece) of the whole text, empty lines left out; an SPDX expression, or a choice of ids, is a piece for each of its licenses."""
    out = []
    for n, line in enumerate(text.split("\n")):
        if (tag := SPDX.search(line)) and (several := operands(COMMENT.sub("", tag[1]))) and (len(several) > 1 or "+" in tag[1]):
            out += [(n, f"SPDX-License-Identifier: {x}") for x in several]
            continue
        for sentence in re.split(r"(?<=[.;:]) +", COMMENT.sub("", line)):
            if several := choices(sentence):
                out += [(n, x) for x in several]
                continue
            tokens = sentence.split()
            out += [(n, " ".join(tokens[i : i + PIECE_WORDS])) for i in range(0, len(tokens), PIECE_WORDS)]
    return out


def grown(parts: list[str], at: int, template: int) -> tuple[int, int]:
    """The pieces from, to (exclusive) of the block around piece ``at`` that the template explains."""
    lo, hi = at, at + 1
    limit = 2 * len(_compressors()[2][template]) + PIECE_WORDS

    def explained(a: int, b: int) -> bool:
        old, new = " ".join(parts[lo:hi]), " ".join(parts[a:b])
        more = plain_size(new) - plain_size(old)
        return saving(new, template) - saving(old, template) >= max(3, SHARE * more)

    moved = True
    while moved and sum(len(p.split()) for p in parts[lo:hi]) < limit:
        moved = False
        for k in range(1, SKIP + 1):
            if hi + k <= len(parts) and explained(lo, hi + k):
                hi, moved = hi + k, True
                break
        for k in range(1, SKIP + 1):
            if lo - k >= 0 and explained(lo - k, hi):
                lo, moved = lo - k, True
                break
    return lo, hi


_cue = re.compile(CUE, re.IGNORECASE)


@lru_cache(maxsize=MEMO)
def hits_in(block: str) -> tuple[tuple[str, int, int, str, int, int], ...]:
    """(license, bytes saved, words that differ, differences, first word, last word) of the licenses confirmed in a block, not overlapping."""
    found, out = words(block), []
    have = {w: found.count(w) for w in set(found)}
    for saved, i in ranking(block):
        name, needed, _ = TEMPLATES[i]
        template = _compressors()[2][i]
        slack = SLACK * len(template)
        if len(template) - sum(min(have.get(w, 0), template.count(w)) for w in set(template)) > slack:
            continue  # too few common words, in whatever order
        w = wording(found, template)
        if w is None or w[0] > slack or w[1] > max(1, slack) or not set(needed) <= set(found[w[3] : w[4]]):
            continue
        if len(template) <= NAME_WORDS and NEGATIONS & set(found[max(0, w[3] - BEFORE) : w[3]]):
            continue
        if all(w[4] <= a or w[3] >= b for *_, a, b in out):
            out.append((name, saved, w[0] + w[1], "; ".join(w[2]), w[3], w[4]))
    return tuple(out)


def licenses_of(text: str) -> list[tuple[int, str, int, int, str]]:
    """(line, license, bytes saved, words that differ, differences) of a whole text."""
    if not _cue.search(text):
        return []
    numbered = pieces(text)
    parts = [p for _, p in numbered]
    sizes = [len(words(p)) for p in parts]
    blocks: dict[tuple[int, int], None] = {}
    for at, part in enumerate(parts):
        if _cue.search(part):
            blocks[at, at + 1] = None
            for _, i in ranking(part):
                blocks[grown(parts, at, i)] = None
    found = []
    for lo, hi in blocks:
        base = sum(sizes[:lo])
        for name, saved, differs, how, a, b in hits_in(" ".join(parts[lo:hi])):
            piece, left = lo, a
            while left >= sizes[piece]:
                left -= sizes[piece]
                piece += 1
            found.append((saved, base + a, base + b, numbered[piece][0], name, differs, how))
    # Of overlapping finds in different blocks the one that saves most stays.
    kept: list[tuple] = []
    for x in sorted(found, key=lambda x: (-x[0], x[1], x[2], x[4])):
        if all(x[2] <= y[1] or x[1] >= y[2] for y in kept):
            kept.append(x)
    return [(line, name, saved, differs, how) for saved, _, _, line, name, differs, how in sorted(kept, key=lambda x: x[1])]


def scan(docs: DataFrame) -> DataFrame:
    """A row for each license that is confirmed in a block."""
    schema = "doc_id long, line long, license string, saved_bytes int, n_different int, differences string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = [(doc, *hit) for doc, text in zip(batch.column("doc_id").to_pylist(), text_list(batch.column("text")), strict=True) for hit in licenses_of(text)]
        if not rows:
            return None
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "line", "license", "saved_bytes", "n_different", "differences"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike(f"(?i){CUE}")).mapInArrow(each_batch(run), schema)
