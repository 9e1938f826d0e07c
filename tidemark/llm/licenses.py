"""Operator 8: licence scans by sentence rules.

A text's lines are cut into sentences and normalised (lower case, letters and digits, single
spaces). Known licence sentences map to identifiers; everything else breaks a sequence only
where it is a sentence of its own inside it. The sequence of identifiers of a text is matched
against ordered rules: a rule's identifiers must follow each other in order with at most
``gap`` other sentences between two of them. Longer rules go first and a sentence serves one
rule only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.token_output import text_batches

# Public licence sentences with their usual variants, by identifier.
_PROGRAMS = ("This program", "This software", "This library", "This file")
_GPL = "{program} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, {either}{version}"
_BSD_HOLDERS = ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS", "AUTHOR AND CONTRIBUTORS", "AUTHORS AND CONTRIBUTORS", "AUTHOR", "AUTHORS", "COPYRIGHT HOLDERS", "COPYRIGHT HOLDER")
_BSD_LIABLE = ("COPYRIGHT HOLDER OR CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS", "REGENTS OR CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS", "AUTHORS OR CONTRIBUTORS", "AUTHOR", "AUTHORS", "COPYRIGHT HOLDERS", "COPYRIGHT HOLDER")
SENTENCES = {
    "apache_2": ["Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License', "This software is licensed under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "apache_title": ["Apache License Version 2.0, January 2004"],
    "apache_may_not": ["you may not use this file except in compliance with the License", "you may not use this software except in compliance with the License"],
    "apache_obtain": [f"You may obtain a copy of the License at {x}www.apache.org/licenses/LICENSE-2.0{y}" for x in ("http://", "https://", "") for y in ("", ".html", ".txt")],
    "as_is_basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache_see": ["See the License for the specific language governing permissions and limitations under the License"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "SPDX-License-Identifier: MIT"],
    "mit_grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"] + [f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so{x}' for x in (", subject to the following conditions", "")],
    "mit_title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "as_is": ["THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND"] + [f"THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND {x}" for x in ("NONINFRINGEMENT", "NON-INFRINGEMENT")],
    "no_event": [f"IN NO EVENT SHALL THE {x} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE" for x in ("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS", "COPYRIGHT HOLDERS")],
    "gpl_3_title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl_2_title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl_2": ["This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0"],
    "gpl_3": ["This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl_redistribute": [_GPL.format(program=x, either="either ", version=f"version 3 of the License{y}") for x in _PROGRAMS for y in (", or (at your option) any later version", "")] + [_GPL.format(program=x, either="", version="version 3 of the License") for x in _PROGRAMS],
    "gpl_2_redistribute": [_GPL.format(program=x, either="either ", version=f"version 2 of the License{y}") for x in _PROGRAMS for y in (", or (at your option) any later version", "")] + [_GPL.format(program=x, either="", version="version 2 of the License") for x in _PROGRAMS],
    "gpl_hope": [f"{x} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY{y}" for x in _PROGRAMS for y in ("", "; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE")],
    "gpl_see": ["See the GNU General Public License for more details"],
    "gpl_received": [f"You should have received a copy of the GNU General Public License along with {x}{y}" for x in _PROGRAMS for y in ("", "; if not, see http://www.gnu.org/licenses/", "; if not, see https://www.gnu.org/licenses/")],
    "cc_by_nc_4": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc_by_4": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc_by_sa_4": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "bsd_redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd_endorse": [f"Neither the name of the {x} may be used to endorse or promote products derived from this software without specific prior written permission" for x in ("copyright holder nor the names of its contributors", "copyright holders nor the names of its contributors", "copyright owner nor the names of its contributors", "author nor the names of its contributors", "University nor the names of its contributors")],
    "bsd_as_is": [f"THIS SOFTWARE IS PROVIDED BY THE {x} AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED" for x in _BSD_HOLDERS],
    "bsd_no_event": [f"IN NO EVENT SHALL THE {x} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE" for x in _BSD_LIABLE],
    "bsd_short": ["Licensed under the BSD License", "SPDX-License-Identifier: BSD-3-Clause"],
    "rights_reserved": ["All rights reserved"],
}
# Further licences by their public notices.
_GNU = "{program} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation; {either}version {version} of the License{later}"
_LATER = (", or (at your option) any later version", "")
SENTENCES |= {
    **{f"lgpl_{v}_redistribute": [_GNU.format(program=x, kind=k, either=e, version=n, later=y) for x in _PROGRAMS for k in ("Lesser", "Library") for e in ("either ", "") for y in _LATER] for v, n in (("2", "2"), ("2_1", "2.1"), ("3", "3"))},
    "agpl_redistribute": [_GNU.format(program=x, kind="Affero", either=e, version="3", later=y) for x in _PROGRAMS for e in ("either ", "") for y in _LATER],
    "lgpl_see": [f"See the GNU {k} General Public License for more details" for k in ("Lesser", "Library")],
    "agpl_see": ["See the GNU Affero General Public License for more details"],
    "lgpl_2_1_title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl_3_title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "agpl_title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "lgpl_2_1": ["This work is licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "lgpl_3": ["This work is licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "agpl_3": ["This work is licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "mpl_title": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "mpl_subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "mpl_copy": [f"If a copy of the MPL was not distributed with this file, You can obtain one at {x}mozilla.org/MPL/2.0/" for x in ("http://", "https://", "")],
    "isc_title": ["ISC License", "The ISC License"],
    "isc": ["Licensed under the ISC License", "Released under the ISC License", "SPDX-License-Identifier: ISC"],
    "isc_grant": [f"Permission to use, copy, modify, {x} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies" for x in ("and/or", "and")],
    "isc_as_is": [f'THE SOFTWARE IS PROVIDED "AS IS" AND {x} ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS' for x in ("THE AUTHOR DISCLAIMS", "THE AUTHORS DISCLAIM", "ISC DISCLAIMS")],
    "isc_no_event": [f"IN NO EVENT SHALL {x} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE" for x in ("THE AUTHOR", "THE AUTHORS", "ISC")],
    "cc0": ["CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "Licensed under CC0 1.0", "This work is licensed under CC0 1.0 Universal", "This work is licensed under a Creative Commons CC0 1.0 Universal License", "SPDX-License-Identifier: CC0-1.0"],
    "cc0_dedicated": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "unlicense_free": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "unlicense_more": [f"For more information, please refer to {x}unlicense.org{y}" for x in ("http://", "https://", "") for y in ("", "/")],
    "zlib_as_is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib_no_event": [f"In no event will the {x} be held liable for any damages arising from the use of this software" for x in ("authors", "author")],
    "zlib_grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "zlib_origin": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software", "The origin of this software must not be misrepresented"],
    "zlib": ["Licensed under the zlib License", "SPDX-License-Identifier: Zlib"],
}
#: Ordered rules: licence, sentence identifiers in order, permissive or not.
RULES = [
    ("Zlib", ("zlib_as_is", "zlib_no_event", "zlib_grant", "zlib_origin"), True),
    ("Unlicense", ("unlicense", "unlicense_free", "as_is", "no_event", "unlicense_more"), True),
    ("Unlicense", ("unlicense", "unlicense_free", "as_is", "no_event"), True),
    ("ISC", ("isc_title", "rights_reserved", "isc_grant", "isc_as_is", "isc_no_event"), True),
    ("ISC", ("isc_title", "isc_grant", "isc_as_is", "isc_no_event"), True),
    ("ISC", ("isc_grant", "isc_as_is", "isc_no_event"), True),
    ("LGPL-2.0", ("lgpl_2_redistribute", "gpl_hope", "lgpl_see"), False),
    ("LGPL-2.1", ("lgpl_2_1_redistribute", "gpl_hope", "lgpl_see"), False),
    ("LGPL-3.0", ("lgpl_3_redistribute", "gpl_hope", "lgpl_see"), False),
    ("AGPL-3.0", ("agpl_redistribute", "gpl_hope", "agpl_see"), False),
    ("MPL-2.0", ("mpl_title", "mpl_subject", "mpl_copy"), False),
    ("MPL-2.0", ("mpl_subject", "mpl_copy"), False),
    ("Unlicense", ("unlicense", "unlicense_free"), True),
    ("Zlib", ("zlib_grant", "zlib_origin"), True),
    ("CC0-1.0", ("cc0", "cc0_dedicated"), True),
    ("ISC", ("isc_title", "isc_grant"), True),
    ("BSD", ("rights_reserved", "bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is", "bsd_no_event"), True),
    ("BSD", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is", "bsd_no_event"), True),
    ("BSD", ("rights_reserved", "bsd_redistribution", "bsd_source", "bsd_binary", "bsd_as_is", "bsd_no_event"), True),
    ("BSD", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_as_is", "bsd_no_event"), True),
    ("MIT", ("mit_title", "mit_grant", "mit_notice", "as_is", "no_event"), True),
    ("Apache-2.0", ("apache_2", "apache_may_not", "apache_obtain", "as_is_basis", "apache_see"), True),
    ("Apache-2.0", ("apache_2", "apache_obtain", "as_is_basis", "apache_see"), True),
    ("Apache-2.0", ("apache_2", "apache_may_not", "apache_obtain", "as_is_basis"), True),
    ("MIT", ("mit_grant", "mit_notice", "as_is", "no_event"), True),
    ("GPL-3.0", ("gpl_redistribute", "gpl_hope", "gpl_see", "gpl_received"), False),
    ("GPL-2.0", ("gpl_2_redistribute", "gpl_hope", "gpl_see", "gpl_received"), False),
    ("BSD", ("bsd_redistribution", "bsd_source", "bsd_binary"), True),
    ("MIT", ("mit_grant", "mit_notice", "as_is"), True),
    ("BSD", ("rights_reserved", "bsd_redistribution"), True),
    ("GPL-3.0", ("gpl_redistribute", "gpl_hope"), False),
    ("GPL-2.0", ("gpl_2_redistribute", "gpl_hope"), False),
    ("Apache-2.0", ("apache_title",), True),
    ("GPL-3.0", ("gpl_3_title",), False),
    ("GPL-2.0", ("gpl_2_title",), False),
    ("GPL-2.0", ("gpl_2",), False),
    ("GPL-2.0", ("gpl_2_redistribute",), False),
    ("Apache-2.0", ("apache_2",), True),
    ("MIT", ("mit",), True),
    ("MIT", ("mit_grant",), True),
    ("GPL-3.0", ("gpl_3",), False),
    ("GPL-3.0", ("gpl_redistribute",), False),
    ("CC-BY-NC-4.0", ("cc_by_nc_4",), False),
    ("CC-BY-4.0", ("cc_by_4",), True),
    ("CC-BY-SA-4.0", ("cc_by_sa_4",), False),
    ("BSD", ("bsd_redistribution",), True),
    ("BSD", ("bsd_short",), True),
    ("LGPL-2.0", ("lgpl_2_redistribute",), False),
    ("LGPL-2.1", ("lgpl_2_1_redistribute",), False),
    ("LGPL-3.0", ("lgpl_3_redistribute",), False),
    ("AGPL-3.0", ("agpl_redistribute",), False),
    ("LGPL-2.1", ("lgpl_2_1_title",), False),
    ("LGPL-3.0", ("lgpl_3_title",), False),
    ("AGPL-3.0", ("agpl_title",), False),
    ("LGPL-2.1", ("lgpl_2_1",), False),
    ("LGPL-3.0", ("lgpl_3",), False),
    ("AGPL-3.0", ("agpl_3",), False),
    ("MPL-2.0", ("mpl_subject",), False),
    ("MPL-2.0", ("mpl_title",), False),
    ("ISC", ("isc_grant",), True),
    ("ISC", ("isc",), True),
    ("CC0-1.0", ("cc0",), True),
    ("CC0-1.0", ("cc0_dedicated",), True),
    ("Unlicense", ("unlicense",), True),
    ("Zlib", ("zlib_grant",), True),
    ("Zlib", ("zlib",), True),
    ("Proprietary", ("rights_reserved",), False),
]
GAP = 3
_ODD = re.compile(r"[^a-z0-9]+")
_END = re.compile(r"(?<=[.!?;])\s+|\n+")
# in normalised text; a text without any of these has no known sentence (tests hold every known sentence against it)
_RARE = re.compile(r"licen[sc]|permission|redistribut|copyright notice|provided as is|provided by the|rights reserved|free software|in the hope|may obtain a copy|may not use this|required by applicable|in no event|neither the name|mpl was not|cc0|creative commons|public domain|free to copy|be misrepresented|gnu|mozilla")
#: What may end a sentence that is not known itself, as in "Copyright 2020 Someone, all rights reserved."
_RESERVED = re.compile(r"all[^a-z0-9]+rights[^a-z0-9]+reserved[^a-z0-9]*$", re.IGNORECASE)


def normalised(sentence: str) -> str:
    return _ODD.sub(" ", sentence.lower()).strip()


def known_sentences() -> dict[str, str]:
    return {normalised(s): name for name, own in SENTENCES.items() for s in own}


def beginnings(known: dict[str, str]) -> set[str]:
    """Every run of first words of the known sentences."""
    return {" ".join(w[:k]) for w in (s.split(" ") for s in known) for k in range(1, len(w) + 1)}


def sentence_ids(text: str, known: dict[str, str], begun: set[str]) -> list[tuple[int, str, int, int]]:
    """(sentence number, identifier, start, end) of the known sentences; a sentence may end in "," or ":" too.

    Sentences of several lines count as one: a line that opens a known sentence is joined with
    those after it, as long as it stays the beginning of one, and the longest known one is taken.
    Lines without letters and digits do not count. All comparisons are of normalised words.
    """
    cuts, at = [], 0
    for m in _END.finditer(text):
        cuts.append((at, m.start()))
        at = m.end()
    cuts.append((at, len(text)))
    out, k, number = [], 0, 0
    while k < len(cuts):
        start, end = cuts[k]
        taken, found = k + 1, None
        sentence = normalised(text[start:end])
        if sentence.partition(" ")[0] in begun:
            words = ""
            for j in range(k, len(cuts)):
                own = normalised(text[cuts[j][0] : cuts[j][1]])
                words = f"{words} {own}".strip()
                if words not in begun:
                    break
                if own and words in known:
                    taken, found = j + 1, (number, known[words], start, cuts[j][1])
        if not found and sentence.endswith(" all rights reserved"):
            m = _RESERVED.search(text, start, end)
            found = m and (number, known["all rights reserved"], m.start(), end)
        if found:
            out.append(found)
        number += bool(found or sentence)
        k = taken
    return out


def match_rules(found: list[tuple[int, str, int, int]], gap: int = GAP) -> list[tuple[str, bool, int, int]]:
    """(licence, permissive, start, end) of the rules that the identifiers match, in the order of the rules."""
    free, out = [True] * len(found), []
    for licence, wanted, permissive in RULES:
        k = 0
        while k < len(found):
            used, at = [], k
            for name in wanted:
                while at < len(found) and (not free[at] or found[at][1] != name) and (not used or found[at][0] - found[used[-1]][0] <= gap + 1):
                    at += 1
                if at == len(found) or not free[at] or found[at][1] != name or (used and found[at][0] - found[used[-1]][0] > gap + 1):
                    break
                used.append(at)
                at += 1
            if len(used) < len(wanted):
                if not used:
                    break
                k = used[0] + 1
                continue
            for i in used:
                free[i] = False
            out.append((licence, permissive, found[used[0]][2], found[used[-1]][3]))
            k = used[0] + 1
    return sorted(out, key=lambda x: (x[2], x[3], x[0]))


def licence_scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences, starts, ends (code points), permissive of every document.

    ``permissive``: null without a licence, else whether all that were found are. Null and empty
    texts have no licence. Repeated rows are scanned each; texts are scanned whole, however long;
    further columns are not read; an empty table gives an empty result.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_sentences()
        begun = beginnings(known)
        for batch in batches:
            for ids, texts in text_batches(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [match_rules(sentence_ids(t, known, begun)) if t and _RARE.search(normalised(t)) else [] for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([[x[0] for x in f] for f in found], pa.list_(pa.string())),
                        pa.array([[x[2] for x in f] for f in found], pa.list_(pa.int64())),
                        pa.array([[x[3] for x in f] for f in found], pa.list_(pa.int64())),
                        pa.array([all(x[1] for x in f) if f else None for f in found], pa.bool_()),
                    ],
                    names=["doc_id", "licences", "starts", "ends", "permissive"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, licences array<string>, starts array<long>, ends array<long>, permissive boolean")
