"""Licence recognition by sentences and ordered rules.

A text is cut into sentences, at line ends as well as across wrapped lines. A sentence is
normalised (case, spelling of licence, punctuation) and looked up among the sentences known
from licences and licence notices; each known sentence has an identifier, and several
wordings may share one. A wording that is itself cut (at the colon of an SPDX line, say) is
looked up as neighbouring sentences joined. The identifiers of a text, in order, are matched against rules: a
rule is a licence and the ordered identifiers that state it, between which other sentences
may stand, at most ``GAP``. At each place the longest rule that matches wins, so a licence
is named by its most specific statement and its sentences are not used a second time.

Texts without any of the trigger words that every known sentence has are settled by a
built-in expression and never leave the JVM.

A whole licence text is known by its title and a sentence that ends it (or the appendix on how to
apply it): the match reaches from the one to the last of the other before the next title, and
statements within it, its own notice for instance, are part of it and no licence of their own.

Defined results: a null or empty text has no licence. Rows are handled one by one, so
repeated rows have equal results; a null doc_id is kept. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = 2

# Wordings of licence statements, as published with the licences.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-named": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This software is released under the MIT License.", "MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT"),
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "mit-warranty": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",),
    "mit-liability": ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",),
    "isc-named": ("Licensed under the ISC License.", "ISC License", "SPDX-License-Identifier: ISC"),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "isc-warranty": ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",),
    "isc-liability": ("IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",),
    "bsd2-named": ("Licensed under the BSD 2-Clause License.", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"),
    "bsd3-named": ("Licensed under the BSD 3-Clause License.", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd-names": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "bsd-warranty": tuple(f"THIS SOFTWARE IS PROVIDED BY THE {by} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED." for by in ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS", "AUTHOR")),
    "bsd-liability": tuple(f"IN NO EVENT SHALL THE {who} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE." for who in ("COPYRIGHT HOLDER OR CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS", "REGENTS OR CONTRIBUTORS", "AUTHOR")),
    "apache2-named": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "Licensed under the Apache License 2.0.", "Released under the Apache License, Version 2.0.", "This project is licensed under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "apache2-compliance": ("you may not use this file except in compliance with the License.",),
    "apache2-where": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "apache2-unless": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",),
    "apache2-see": ("See the License for the specific language governing permissions and limitations under the License.",),
    "apache2-title": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",),
    "apache2-copyright": ("Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",),
    "gpl3-title": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "gpl2-title": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "lgpl3-title": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "lgpl21-title": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",),
    "agpl3-title": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "gnu-verbatim": ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",),
    "gpl-details": ("See the GNU General Public License for more details.",),
    "gpl-received": ("You should have received a copy of the GNU General Public License along with this program.", "You should have received a copy of the GNU General Public License along with this program; if not, see <https://www.gnu.org/licenses/>."),
    "gpl3-named": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", "Licensed under the GPLv3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0"),
    "gpl2-named": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "Licensed under the GPLv2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0"),
    "gpl3-later": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "gpl2-later": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-2.0-or-later"),
    "gpl-warranty": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "lgpl3-named": ("Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "agpl3-named": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "mpl2-named": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "mpl2-title": ("Mozilla Public License Version 2.0",),
    "mpl2-where": ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "unlicense-anyone": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "unlicense-named": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "zlib-named": ("Licensed under the zlib License.", "SPDX-License-Identifier: Zlib"),
    "zlib-warranty": ("This software is provided 'as-is', without any express or implied warranty.",),
    "zlib-liability": ("In no event will the authors be held liable for any damages arising from the use of this software.",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "boost-title": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "boost-grant": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",),
    "boost-named": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "reserved": ("All rights reserved under copyright.", "Copyright. All rights reserved."),
}
#: Creative Commons terms; wordings are made from them for each version.
_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
_ZERO = ("Licensed under CC0 1.0.", "Released under the CC0 1.0 Universal license.", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.")

# Rules, each a licence and the identifiers that state it in order.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-named",)), ("MIT", ("mit-grant",)), ("MIT", ("mit-named", "mit-grant")), ("MIT", ("mit-grant", "mit-notice", "mit-warranty")), ("MIT", ("mit-named", "mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")), ("MIT", ("mit-named", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("ISC", ("isc-named",)), ("ISC", ("isc-grant",)), ("ISC", ("isc-named", "isc-grant")), ("ISC", ("isc-grant", "isc-warranty", "isc-liability")), ("ISC", ("isc-named", "isc-grant", "isc-warranty", "isc-liability")),
    ("BSD-2-Clause", ("bsd2-named",)), ("BSD-3-Clause", ("bsd3-named",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")), ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd2-named", "bsd-grant", "bsd-source", "bsd-binary")), ("BSD-3-Clause", ("bsd3-named", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    *((name, (*start, "bsd-grant", "bsd-source", "bsd-binary", *names, "bsd-warranty", "bsd-liability")) for name, start, names in (("BSD-2-Clause", (), ()), ("BSD-2-Clause", ("bsd2-named",), ()), ("BSD-3-Clause", (), ("bsd-names",)), ("BSD-3-Clause", ("bsd3-named",), ("bsd-names",)))),
    ("Apache-2.0", ("apache2-named", "apache2-compliance", "apache2-where", "apache2-unless", "apache2-see")), ("Apache-2.0", ("apache2-title",)), ("Apache-2.0", ("apache2-copyright",)),
    ("GPL-3.0", ("gpl3-title",)), ("GPL-3.0", ("gpl3-title", "gnu-verbatim")), ("GPL-2.0", ("gpl2-title",)), ("GPL-2.0", ("gpl2-title", "gnu-verbatim")), ("AGPL-3.0", ("agpl3-title",)), ("AGPL-3.0", ("agpl3-title", "gnu-verbatim")),
    ("LGPL-3.0", ("lgpl3-title",)), ("LGPL-3.0", ("lgpl3-title", "gnu-verbatim")), ("LGPL-2.1", ("lgpl21-title",)), ("LGPL-2.1", ("lgpl21-title", "gnu-verbatim")),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-warranty", "gpl-details", "gpl-received")), ("GPL-2.0-or-later", ("gpl2-later", "gpl-warranty", "gpl-details", "gpl-received")),
    ("MPL-2.0", ("mpl2-title",)), ("MPL-2.0", ("mpl2-named", "mpl2-where")), ("Unlicense", ("unlicense-named", "unlicense-anyone")), ("Zlib", ("zlib-grant",)), ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")), ("BSL-1.0", ("boost-title",)), ("BSL-1.0", ("boost-grant",)), ("BSL-1.0", ("boost-title", "boost-grant")),
    ("Apache-2.0", ("apache2-named",)), ("Apache-2.0", ("apache2-named", "apache2-compliance")), ("Apache-2.0", ("apache2-named", "apache2-compliance", "apache2-where")),
    ("GPL-3.0-only", ("gpl3-named",)), ("GPL-2.0-only", ("gpl2-named",)), ("GPL-3.0-or-later", ("gpl3-later",)), ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-warranty")), ("GPL-2.0-or-later", ("gpl2-later", "gpl-warranty")),
    ("LGPL-3.0", ("lgpl3-named",)), ("AGPL-3.0", ("agpl3-named",)), ("MPL-2.0", ("mpl2-named",)), ("Unlicense", ("unlicense-named",)), ("Zlib", ("zlib-named",)), ("BSL-1.0", ("boost-named",)), ("all-rights-reserved", ("reserved",)),
)

# Sentences that end whole licence texts, and which licence a title begins with the ends that it may have.
ENDS: dict[str, tuple[str, ...]] = {
    "terms-end": ("END OF TERMS AND CONDITIONS",),
    "gpl-end": ("If this is what you want to do, use the GNU Lesser General Public License instead of this License.", "If this is what you want to do, use the GNU Library General Public License instead of this License."),
    "agpl-end": ("For more information on this, and how to apply and follow the GNU AGPL, see <https://www.gnu.org/licenses/>.", "For more information on this, and how to apply and follow the GNU AGPL, see <http://www.gnu.org/licenses/>."),
    "lgpl3-end": ("If the Library as you received it specifies that a proxy can decide whether future versions of the GNU Lesser General Public License shall apply, that proxy's public statement of acceptance of any version is permanent authorization for you to choose that version for the Library.",),
    "lgpl21-end": ("That's all there is to it!",),
    "mpl2-end": ("This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",),
}
WHOLE: dict[str, tuple[str, tuple[str, ...]]] = {
    "gpl3-title": ("GPL-3.0", ("terms-end", "gpl-end")), "gpl2-title": ("GPL-2.0", ("terms-end", "gpl-end")), "agpl3-title": ("AGPL-3.0", ("terms-end", "agpl-end")), "lgpl3-title": ("LGPL-3.0", ("lgpl3-end",)),
    "lgpl21-title": ("LGPL-2.1", ("terms-end", "lgpl21-end")), "mpl2-title": ("MPL-2.0", ("mpl2-end",)), "apache2-title": ("Apache-2.0", ("terms-end", "apache2-see")),
}

#: Every known sentence of a rule has one of these, whatever its case.
TRIGGER = r"(?i)licen[cs]e|copyright|permission|redistribut|warrant|public\s+domain|released\s+under|liable|anyone\s+is\s+free|copy\s+of\s+the\s+mpl"

_WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")
_STOP = re.compile(r"[.:;!?]+(?=\s|$)")
_TEXT = re.compile(r"\S")
_LINE = re.compile(r"[^\r\n]+")
_PARAGRAPH = re.compile(r"(?:[^\r\n]+(?:\r?\n(?![ \t]*\r?(?:\n|$)))?)+")

SCHEMA = "doc_id long, licenses array<string>, n_sentences int, matches array<struct<license:string,start:int,end:int>>"


def normalised(sentence: str) -> str:
    """Words in lower case with one blank between; no punctuation but inside words."""
    return " ".join(_WORD.findall(sentence.lower().replace("licence", "license")))


def _known() -> tuple[dict[str, str], tuple[tuple[str, tuple[str, ...]], ...]]:
    """The identifier of each wording, and all rules."""
    known, rules = {}, list(RULES)
    for name, wordings in SENTENCES.items():
        for wording in wordings:
            known[wording] = name
    for short, long in _COMMONS.items():
        for version in _VERSIONS:
            name = f"cc-{short.lower()}-{version}"
            for wording in (f"Licensed under CC {short} {version}.", f"Released under CC {short} {version}.", f"This work is licensed under CC {short} {version}.", f"Licensed under a Creative Commons {long} {version} International License.", f"This work is licensed under a Creative Commons {long} {version} International License.", f"SPDX-License-Identifier: CC-{short}-{version}"):
                known[wording] = name
            rules.append((f"CC-{short}-{version}", (name,)))
    for wording in _ZERO:
        known[wording] = "cc0"
    return known, (*rules, ("CC0-1.0", ("cc0",)))


KNOWN_WORDINGS, ALL_RULES = _known()
_END_WORDINGS = {wording: name for name, wordings in ENDS.items() for wording in wordings}
KNOWN = {normalised(wording): name for wording, name in (KNOWN_WORDINGS | _END_WORDINGS).items()}
_BY_FIRST: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
for _rule in sorted(ALL_RULES, key=lambda r: -len(r[1])):
    _BY_FIRST.setdefault(_rule[1][0], []).append(_rule)


def _leading() -> set[str]:
    """The normalised leading sentences of the wordings that are cut into several."""
    out = set()
    for wording in (*KNOWN_WORDINGS, *_END_WORDINGS):
        ends = [high for _, high in _cut(wording, 0, len(wording))]
        out |= {normalised(wording[:high]) for high in ends[:-1]}
    return out


def _cut(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    at = low
    for stop in _STOP.finditer(text, low, high):
        if stop.end() <= high:
            yield at, stop.end()
            at = stop.end()
    if at < high:
        yield at, high


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number) of the sentences within lines and of those across lines, in order.

    The number counts sentences along the text, so it tells how many stand between two.
    """
    spans = {span for line in _LINE.finditer(text) for span in _cut(text, *line.span())}
    within = sorted(spans)
    for paragraph in _PARAGRAPH.finditer(text):
        spans.update(_cut(text, *paragraph.span()))
    starts = {}
    for low, _ in within:
        starts.setdefault(low, len(starts))
    out, last = [], 0
    for low, high in sorted(spans):
        last = starts.get(low, last)
        out.append((low, high, last))
    return out


LEADING = _leading()


def _found(text: str) -> list[tuple[str, int, int, int, int]]:
    """The known wordings of a text in order: identifier, start, end, numbers of the first and last sentence.

    The same words cut at a line's end and across lines are found once, and none within another.
    """
    cut, follow = [], {}
    for low, high, number in sentences(text):
        start = low + len(text[low:high]) - len(text[low:high].lstrip())
        cut.append((start, high, number))
        follow.setdefault(start, []).append((high, normalised(text[low:high])))
    numbers = {}
    for start, _, number in cut:
        numbers.setdefault(number, start)
    starts = [numbers[number] for number in sorted(numbers)]
    out = {}
    for start, high, number in cut:
        reached = [(high, normalised(text[start:high]))]
        while reached:
            end, key = reached.pop()
            if key in KNOWN:
                last = max(number, bisect.bisect_left(starts, end) - 1)
                out.setdefault((start, KNOWN[key]), (KNOWN[key], start, end, number, last))
            if key in LEADING:
                after = _TEXT.search(text, end)
                reached += [(e, f"{key} {more}") for e, more in follow.get(after.start() if after else -1, ())]
    found, upto = [], 0
    for one in sorted(out.values(), key=lambda f: (f[1], -f[2])):
        if one[2] > upto:  # not the end of a wrapped wording that is known by itself too
            found.append(one)
            upto = one[2]
    return found


def recognise(text: str) -> tuple[list[tuple[str, int, int]], int]:
    """Matches (licence, start, end) of a text and how many known wordings of rules it has."""
    found = _found(text)
    titles = [k for k, f in enumerate(found) if f[0] in WHOLE]
    ends: dict[str, list[int]] = {}
    for k, f in enumerate(found):
        ends.setdefault(f[0], []).append(k)
    matches, at = [], 0
    while at < len(found):
        if found[at][0] in WHOLE:
            license_name, closing = WHOLE[found[at][0]]
            after = bisect.bisect_right(titles, at)
            stop = titles[after] if after < len(titles) else len(found)
            last = max((places[k - 1] for name in closing if (places := ends.get(name)) and (k := bisect.bisect_left(places, stop)) and places[k - 1] > at), default=None)
            if last is not None:
                matches.append((license_name, found[at][1], found[last][2]))
                at = last + 1
                continue
        for license_name, wanted in _BY_FIRST.get(found[at][0], ()):
            used = [at]
            for name in wanted[1:]:
                k, upto = used[-1] + 1, found[used[-1]][4] + GAP + 1
                while k < len(found) and found[k][3] <= upto and found[k][0] != name:
                    k += 1
                if k == len(found) or found[k][3] > upto:
                    break
                used.append(k)
            if len(used) == len(wanted):
                matches.append((license_name, found[at][1], found[used[-1]][2]))
                at = used[-1]
                break
        at += 1
    return matches, sum(f[0] not in ENDS for f in found)


def scan(documents: DataFrame) -> DataFrame:
    """Licences, number of known sentences and matches of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                matches, n = recognise(text) if text else ([], 0)
                out.append({"doc_id": doc_id, "licenses": sorted({m[0] for m in matches}), "n_sentences": n, "matches": [{"license": a, "start": b, "end": c} for a, b, c in matches]})
            kind = pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("licenses", pa.list_(pa.string())), ("n_sentences", pa.int32()), ("matches", pa.list_(kind))]))

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike(TRIGGER), F.col("text")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
