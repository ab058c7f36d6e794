"""Licence recognition by sentences: a text's sentences, normalised, are mapped to the identifiers of
known licence sentences, and the sequence of identifiers is matched against ordered licence rules.

DataFrame expressions only, in one narrow stage; whole texts, nothing shuffled.

A text is cut after full stops, exclamation marks, question marks and semicolons before white
space, and at blank lines. A sentence that is not known as a whole is cut at its line ends and each
line looked up, so that notices are found both wrapped over lines and between lines of other text.
Normalised: lower case, marks and white space of any length one blank, comment signs dropped.

Where a sentence names the holder, that name is dropped first. A rule names a licence and the identifiers that
must follow one another among the recognised sentences; a longer rule of the same licence adds nothing to a
shorter one. "All rights reserved" tells a proprietary text only where no licence is found.

Sentences that speak of licences but are not known are counted, so that what the tables lack can be seen.

Edge cases: null and empty texts have no sentences and no licence; a sentence twice is in the
sequence twice; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts.
#: Identifier -> known sentences (any one of them).
SENTENCES: dict[str, list[str]] = {
    "MitGrant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "MitNotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.", "Permission is hereby granted subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "AsIs": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "NoLiability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "ApacheGrant": ['Licensed under the Apache License, Version 2.0 (the "License");'],
    "ApacheUse": ["you may not use this file except in compliance with the License."],
    "ApacheCopy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "ApacheAsIs": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "ApacheSee": ["See the License for the specific language governing permissions and limitations under the License."],
    "GplGrant3": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GplGrant2": ["This program is free software;", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "GplLater2": ["either version 2 of the License, or (at your option) any later version."],
    "LgplGrant3": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LgplGrant2": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"],
    "LgplLater21": ["either version 2.1 of the License, or (at your option) any later version."],
    "AgplGrant3": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "FsfNoWarranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "FsfImplied": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "FsfDetails": ["See the GNU General Public License for more details.", "See the GNU Lesser General Public License for more details.", "See the GNU Affero General Public License for more details."],
    "MplForm": ["This Source Code Form is subject to the terms of the Mozilla Public License, v."],
    "MplCopy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "BsdStyle": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file in the root directory of this source tree."],
    "BsdGrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BsdSource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "BsdBinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BsdEndorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BsdAsIs": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'],
    "CcZeroWaiver": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "This work is dedicated to the public domain under CC0 1.0."],
    "IscGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "UnlicenseFree": ["This is free and unencumbered software released into the public domain."],
    "BoostGrant": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'],
    "BoostSee": ["(See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "(See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "ZlibAsIs": ["This software is provided 'as-is', without any express or implied warranty."],
    "ZlibGrant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "EplGrant1": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "EplGrant2": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0."],
    "CddlGrant": ['The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").'],
    "PsfGrant": ["PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"],
    "Reserved": ["All rights reserved."],
}

#: Licence, as its SPDX identifier or a family's name -> names by which texts refer to it.
NAMES: dict[str, list[str]] = {
    "0BSD": ["Zero-Clause BSD License"],
    "AFL-3.0": ["Academic Free License, version 3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPLv3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License v2.0", "Apache-2.0 License", "Apache 2.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, version 2.0"],
    "BSD": ["BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "2-clause BSD License", "BSD 2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "3-clause BSD License", "BSD 3-Clause"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "CC-BY-3.0": ["Creative Commons Attribution 3.0 Unported License", "CC BY 3.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY 4.0 License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
    "CC-BY-NC-ND-4.0": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"],
    "CC-BY-SA-3.0": ["Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC BY-SA 3.0"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA 4.0 License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License"],
    "CDDL-1.0": ["Common Development and Distribution License", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"],
    "EPL-1.0": ["Eclipse Public License - v 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License - v 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "EUPL-1.2": ["European Union Public Licence v. 1.2", "EUPL 1.2"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPLv2", "GPLv2", "GPL v2 License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPLv3", "GPLv3", "GPL v3 License"],
    "ISC": ["ISC License"],
    "LGPL": ["GNU Lesser General Public License", "LGPL"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"],
    "MIT": ["MIT License", "MIT license (MIT)", "Expat License", "MIT"],
    "MIT-0": ["MIT No Attribution License", "MIT No Attribution"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, version 1.1"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "MS-PL": ["Microsoft Public License"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"],
    "PSF-2.0": ["Python Software Foundation License", "PSF License"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "WTFPL": ["Do What The Fuck You Want To Public License", "WTFPL"],
    "Zlib": ["zlib License", "zlib/libpng License"],
}
#: How texts refer to a licence by name.
REFERENCES = ["{}", "The {}", "License: {}", "Licensed under the {}.", "Licensed under the {}, see LICENSE.", "This project is licensed under the {} - see the LICENSE file for details."]
#: Names that say nothing of a licence when they stand alone.
BARE = {"MIT", "LGPL", "Unlicense", "Apache 2.0", "BSD 2-Clause", "BSD 3-Clause", "WTFPL"}
#: Licence -> the lines above its full text.
TITLES: dict[str, list[str]] = {
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": ["Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "OFL-1.1": ["SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"],
}
#: Suffixes with which machine-readable tags narrow a licence.
TAG_SUFFIXES = ("", "-only", "-or-later")

#: Licence, identifiers in order. Any rule of a licence that holds names it.
RULES: list[tuple[str, list[str]]] = [
    ("AGPL-3.0-or-later", ["AgplGrant3"]),
    ("Apache-2.0", ["ApacheGrant", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheGrant", "ApacheUse"]),
    ("BSD", ["BsdStyle"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("BSL-1.0", ["BoostSee"]),
    ("CC0-1.0", ["CcZeroWaiver"]),
    ("CDDL-1.0", ["CddlGrant"]),
    ("EPL-1.0", ["EplGrant1"]),
    ("EPL-2.0", ["EplGrant2"]),
    ("GPL-2.0-or-later", ["GplGrant2", "GplLater2"]),
    ("GPL-3.0-or-later", ["GplGrant3"]),
    ("ISC", ["IscGrant"]),
    ("LGPL-2.1-or-later", ["LgplGrant2", "LgplLater21"]),
    ("LGPL-3.0-or-later", ["LgplGrant3"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("MPL-2.0", ["MplForm"]),
    ("PSF-2.0", ["PsfGrant"]),
    ("Unlicense", ["UnlicenseFree"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    ("Zlib", ["ZlibGrant"]),
    *[(name, [f"Ref:{name}"]) for name in NAMES],
    *[(name + end, [f"Tag:{name}{end}"]) for name in NAMES for end in TAG_SUFFIXES],
    ("Proprietary", ["Reserved"]),
]
#: Holds only where nothing else does.
LAST_RESORT = "Proprietary"

#: After the marks that end a sentence, or at a blank line, a text is cut. \x01 stands for the cut.
ENDS = r"([.!?;])[ \t\r\n]+|\r?\n[ \t]*\r?\n"
#: Abbreviations in holders' names, after which no sentence ends.
SHORT = ("Inc. ", "Ltd. ", "Corp. ", "Co. ")
MARKS = r"[^a-z0-9]+"
#: (words that must be there, pattern, what takes its place) in normalised sentences: holders' names and what is licensed.
HOLDERS = [
    (" under ", "^(this [a-z]+ is |it is |is )?(licensed|released|distributed|published|available|made available) under (the terms of )?(the |a |an )?", "licensed under the "),
    ("nor the names of", "neither the names? of .{1,120}? nor the names of (its|the|their|any) ?(other )?contributors", "neither the name of the copyright holder nor the names of its contributors"),
    ("be liable for any", "in no event shall .{1,160}? be liable for any claim", "in no event shall the authors or copyright holders be liable for any claim"),
    ("as is and any express", "this software is provided by .{1,160}? as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
]
#: What a sentence of a licence has in it.
LIKE_PARTS = ("licen", "copyright", "warrant", "redistribution", "spdx")
LIKE = "(^| )(licen[cs]e[ds]?|licensing|copyright|warranty|warranties|redistributions?|spdx)( |$)"


def normalised(sentence: str) -> str:
    """What the expressions below make of a sentence, for the tables above."""
    out = re.sub(MARKS, " ", sentence.lower()).strip(" ")
    for words, pattern, instead in HOLDERS:
        if words in out:
            out = re.sub(pattern, instead, out)
    return out


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier. The tables' own sentences are whole ones, as texts are cut."""
    out: dict[str, str] = {}

    def add(sentence: str, name: str) -> None:
        norm = normalised(sentence)
        if out.setdefault(norm, name) != name:
            raise ValueError(f"two identifiers for {sentence!r}")

    for name, listed in SENTENCES.items():
        for s in listed:
            add(s, name)
    for name, listed in NAMES.items():
        for called in listed:
            for r in REFERENCES:
                if r not in ("{}", "The {}") or called not in BARE:
                    add(r.format(called), f"Ref:{name}")
        for end in TAG_SUFFIXES:
            add(f"SPDX-License-Identifier: {name}{end}", f"Tag:{name}{end}")
    for name, listed in TITLES.items():
        for s in listed:
            add(s, f"Ref:{name}")
    return out


def _replacing(words: str, pattern: str, instead: str):
    return lambda n: F.when(F.contains(n, F.lit(words)), F.regexp_replace(n, pattern, instead)).otherwise(n)


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_sentences, n_known, sentence_ids, licenses, n_unknown) of each row: sentences of the text, those
    recognised, their identifiers in order and the licences found, sorted, both comma-joined; sentences that
    speak of licences without being known."""
    known = known_sentences()
    table = F.create_map(*[x for s, i in known.items() for x in (F.lit(s), F.lit(i))])

    def norms(sentences: Column) -> Column:  # one pass a step: what a lambda uses twice is worked out twice
        out = F.transform(sentences, lambda s: F.trim(F.regexp_replace(F.lower(s), MARKS, " ")))
        for words, pattern, instead in HOLDERS:
            out = F.transform(out, _replacing(words, pattern, instead))
        return out

    def look(n: Column) -> Column:  # a set finds at once what a map is searched for
        return F.when(n.isin(*known), F.try_element_at(table, n))

    def judged(s: Column, n: Column) -> Column:
        lines = F.filter(F.transform(norms(F.split(s, "\n")), look), lambda x: x.isNotNull())
        ids = F.when(n.isin(*known), F.array(F.try_element_at(table, n))).when(F.contains(s, F.lit("\n")), lines).otherwise(F.array().cast("array<string>"))
        some = functools.reduce(Column.__or__, [F.contains(n, F.lit(w)) for w in LIKE_PARTS])
        return F.struct(ids.alias("ids"), (some & n.rlike(LIKE)).alias("like"))

    body = F.coalesce(docs[text], F.lit(""))
    for short in SHORT:
        body = F.replace(body, F.lit(short), F.lit(short.replace(".", "")))
    cut = F.split(F.regexp_replace(body, ENDS, "$1\x01"), "\x01")
    rows = docs.select(docs[key].alias("key"), F.filter(cut, lambda s: F.trim(F.regexp_replace(s, "[ \t\r\n]+", " ")) != "").alias("s"))
    found = rows.select("key", F.size("s").cast("long").alias("n_sentences"), F.zip_with("s", norms(F.col("s")), judged).alias("judged"))
    unknown = F.filter("judged", lambda j: (F.size(j["ids"]) == 0) & j["like"])
    found = found.select("key", "n_sentences", F.flatten(F.transform("judged", lambda j: j["ids"])).alias("ids"), F.size(unknown).cast("long").alias("n_unknown"))
    found = found.withColumn("sequence", F.concat(F.lit(","), F.concat_ws(",", "ids"), F.lit(",")))
    named = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains("sequence", F.lit(f",{','.join(ids)},")), F.lit(name)) for name, ids in RULES])))
    named = F.when(F.size(named) > 1, F.array_remove(named, LAST_RESORT)).otherwise(named)
    return found.select(F.col("key").alias(key), "n_sentences", F.size("ids").cast("long").alias("n_known"), F.concat_ws(",", "ids").alias("sentence_ids"), F.when(F.size("ids") > 0, F.concat_ws(",", F.array_sort(named))).otherwise(F.lit("")).alias("licenses"), "n_unknown")


def oracle() -> str:
    """The same over ``documents`` in DuckDB's SQL."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in known_sentences().items())
    norm = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' ')"
    for _, pattern, instead in HOLDERS:
        norm = f"regexp_replace({norm}, '{pattern}', '{instead}', 'g')"
    rules = ", ".join(f"('{name}', ',{','.join(ids)},')" for name, ids in RULES)
    body = "coalesce(text, '')"
    for short in SHORT:
        body = f"replace({body}, '{short}', '{short.replace('.', '')}')"
    return rf"""
WITH known(sentence, id) AS (VALUES {known}), rules(license, pattern) AS (VALUES {rules}),
cut AS (SELECT doc_id, list_filter(string_split(regexp_replace({body}, '([.!?;])[ \t\r\n]+|\r?\n[ \t]*\r?\n', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '[ \t\r\n]+', ' ', 'g'), ' ') <> '') AS s FROM documents),
numbered AS (SELECT doc_id, s, i, {norm.replace("{}", "s")} AS norm FROM (SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS i FROM cut)),
whole AS (SELECT n.*, k.id FROM numbered n LEFT JOIN known k ON k.sentence = n.norm),
lines AS (SELECT doc_id, i, unnest(string_split(s, chr(10))) AS l, unnest(range(len(string_split(s, chr(10))))) AS j FROM whole WHERE id IS NULL AND contains(s, chr(10))),
found AS (SELECT doc_id, i, 0 AS j, id FROM whole WHERE id IS NOT NULL UNION ALL SELECT doc_id, i, j, k.id FROM (SELECT doc_id, i, j, {norm.replace("{}", "l")} AS norm FROM lines) l JOIN known k ON k.sentence = l.norm),
per AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY i, j) AS ids FROM found GROUP BY doc_id),
all_named AS (SELECT DISTINCT doc_id, license FROM per JOIN rules ON contains(',' || ids || ',', pattern)),
named AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses FROM all_named a WHERE license <> '{LAST_RESORT}' OR NOT EXISTS (SELECT 1 FROM all_named b WHERE b.doc_id = a.doc_id AND b.license <> '{LAST_RESORT}') GROUP BY doc_id),
missed AS (SELECT doc_id, count(*) AS n FROM numbered n WHERE regexp_matches(norm, '{LIKE}') AND NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = n.doc_id AND f.i = n.i) GROUP BY doc_id)
SELECT c.doc_id, CAST(len(c.s) AS BIGINT) AS n_sentences, coalesce(p.n, 0) AS n_known, coalesce(p.ids, '') AS sentence_ids, coalesce(l.licenses, '') AS licenses, coalesce(m.n, 0) AS n_unknown
FROM cut c LEFT JOIN per p USING (doc_id) LEFT JOIN named l USING (doc_id) LEFT JOIN missed m USING (doc_id)"""
