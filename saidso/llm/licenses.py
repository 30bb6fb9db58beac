"""License scans by sentences.

A text is cut into sentences, each sentence is normalised and mapped to the identifier of a known licence sentence, and
the sequence of identifiers is matched against ordered rules: the first rule takes every run of identifiers it fits, the
next rule what is left. Known sentences that no rule takes are reported as they are.

Licences in files are wrapped and commented: comment marks are taken off lines, and a line break ends a sentence only after an
end mark, before a blank line and before a list's bullet. A sentence of several lines that is not known is looked up again
without its first line (a title or a notice of copyright), and then line by line.

One pass over each row; no shuffle, so no key can be hot. A text without any of the words that every known sentence has
is not cut at all. Defined results: a null or empty text, and one without known sentences, has none and no licences;
repeated rows each get their result; input columns named as results are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence wordings, normalised (lower case; all but letters, digits and dots as one space; no
# final dot), and the identifier of each. Every one has one of CUE_WORDS.
SENTENCES = {
    "released under the mit license": "MITRef",
    "licensed under the mit license": "MITRef",
    "this project is licensed under the mit license": "MITRef",
    "this software is released under the mit license": "MITRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITAsIs",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITLiable",
    "licensed under the apache license version 2.0": "Apache2Ref",
    "licensed under the apache license version 2.0 the license": "Apache2Ref",
    "this project is licensed under the apache license version 2.0": "Apache2Ref",
    "you may not use this file except in compliance with the license": "Apache2Comply",
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0": "Apache2Copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "Apache2AsIs",
    "see the license for the specific language governing permissions and limitations under the license": "Apache2See",
    "this work is licensed under the gnu general public license version 2": "GPL2Ref",
    "this work is licensed under the gnu general public license version 3": "GPL3Ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2Grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3Grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLAsIs",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPLTerms",
    "either version 2 of the license or at your option any later version": "GPL2Later",
    "either version 3 of the license or at your option any later version": "GPL3Later",
    "this program is distributed in the hope that it will be useful but without any warranty": "GPLNoWarranty",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GPLNotEven",
    "see the gnu general public license for more details": "GPLSee",
    "you should have received a copy of the gnu general public license along with this program": "GPLCopy",
    "this work is licensed under the gnu lesser general public license version 3": "LGPL3Ref",
    "this work is licensed under the gnu affero general public license version 3": "AGPL3Ref",
    "licensed under cc by 4.0": "CCBY4Ref",
    "licensed under cc by sa 4.0": "CCBYSA4Ref",
    "licensed under cc by nc 4.0": "CCBYNC4Ref",
    "licensed under cc by nd 4.0": "CCBYND4Ref",
    "licensed under cc by nc sa 4.0": "CCBYNCSA4Ref",
    "this work is licensed under a creative commons attribution 4.0 international license": "CCBY4Ref",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "CCBYSA4Ref",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "CCBYNC4Ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDNames",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDAsIs",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCAsIs",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "BSDLiable",
    "this source code form is subject to the terms of the mozilla public license v.2.0": "MPL2Ref",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BSLGrant",
    "distributed under the boost software license version 1.0": "BSLRef",
    "this software is provided as is without any express or implied warranty": "ZlibAsIs",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "this is free and unencumbered software released into the public domain": "UnlicenseGrant",
    "all rights reserved": "AllRights",
}
CUE_WORDS = "licen[sc]e|cc by|permission|warrant|copyright|redistribut|rights reserved|public domain"
# The rules in the order they apply.
RULES = (
    ("MIT", ("MITGrant", "MITNotice", "MITAsIs", "MITLiable")),
    ("MIT", ("MITGrant", "MITNotice", "MITAsIs")),
    ("Apache-2.0", ("Apache2Ref", "Apache2Comply", "Apache2Copy", "Apache2AsIs", "Apache2See")),
    ("GPL-3.0-or-later", ("GPLTerms", "GPL3Later", "GPLNoWarranty", "GPLNotEven", "GPLSee", "GPLCopy")),
    ("GPL-2.0-or-later", ("GPLTerms", "GPL2Later", "GPLNoWarranty", "GPLNotEven", "GPLSee", "GPLCopy")),
    ("GPL-3.0-or-later", ("GPLTerms", "GPL3Later", "GPLNoWarranty", "GPLNotEven", "GPLSee")),
    ("GPL-2.0-or-later", ("GPLTerms", "GPL2Later", "GPLNoWarranty", "GPLNotEven", "GPLSee")),
    ("GPL-3.0-or-later", ("GPLTerms", "GPL3Later")),
    ("GPL-2.0-or-later", ("GPLTerms", "GPL2Later")),
    ("GPL-3.0-or-later", ("GPL3Grant", "GPLAsIs", "GPLSee", "GPLCopy")),
    ("GPL-2.0-or-later", ("GPL2Grant", "GPLAsIs", "GPLSee", "GPLCopy")),
    ("GPL-3.0-or-later", ("GPL3Grant", "GPLAsIs", "GPLSee")),
    ("GPL-2.0-or-later", ("GPL2Grant", "GPLAsIs", "GPLSee")),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDNames", "BSDAsIs", "BSDLiable")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDAsIs", "BSDLiable")),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDNames", "BSDAsIs")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDAsIs")),
    ("ISC", ("ISCGrant", "ISCAsIs")),
    ("Zlib", ("ZlibAsIs", "ZlibGrant")),
    ("BSL-1.0", ("BSLGrant",)),
    ("BSL-1.0", ("BSLRef",)),
    ("GPL-3.0-or-later", ("GPL3Grant",)),
    ("GPL-2.0-or-later", ("GPL2Grant",)),
    ("MIT", ("MITRef",)),
    ("Apache-2.0", ("Apache2Ref",)),
    ("GPL-2.0-only", ("GPL2Ref",)),
    ("GPL-3.0-only", ("GPL3Ref",)),
    ("LGPL-3.0-only", ("LGPL3Ref",)),
    ("AGPL-3.0-only", ("AGPL3Ref",)),
    ("CC-BY-4.0", ("CCBY4Ref",)),
    ("CC-BY-SA-4.0", ("CCBYSA4Ref",)),
    ("CC-BY-NC-4.0", ("CCBYNC4Ref",)),
    ("CC-BY-ND-4.0", ("CCBYND4Ref",)),
    ("CC-BY-NC-SA-4.0", ("CCBYNCSA4Ref",)),
    ("ISC", ("ISCGrant",)),
    ("MPL-2.0", ("MPL2Ref",)),
    ("Unlicense", ("UnlicenseGrant",)),
    ("LicenseRef-all-rights-reserved", ("AllRights",)),
)
#: What is done to a text before it is cut, in order: line ends alike, comment marks off, "v. 2" in one, an address joined to the
#: sentence before it, a bullet's line set apart. Patterns without look-around, so that both engines read them alike.
PREPARED = (
    ("\r\n?", "\n"),
    (r"(?m)^[ \t]*(/\*+|\*+/|\*|//+|#+|;+|--+|%+|<!--)[ \t]*", ""),
    (r"(?m)[ \t]*(\*+/|-->)?[ \t]*$", ""),
    (r"(^|[^A-Za-z0-9])([vV]\.)[ \t\n]+([0-9])", "{1}{2}{3}"),
    (r"\n+[ \t]*(https?://)", " {1}"),
    (r"\n[ \t]*([-*•]|[0-9]{1,2}[.)]|\([0-9a-zA-Z]\))[ \t]+", "\n\n"),
)
#: Sentences end at a stop, question or exclamation mark, colon or semicolon before white space, and at blank lines.
SENTENCE_END = r"[.!?:;][ \t\n]+|\n[ \t]*\n[ \t\n]*"


def cue_pattern() -> str:
    """Any of the cue words, whatever stands between their words."""
    return "(?i)" + CUE_WORDS.replace(" ", "[^a-z0-9.]+")


def _groups(replacement: str, mark: str) -> str:
    """The numbered groups of a replacement in one engine's writing."""
    for i in (1, 2, 3):
        replacement = replacement.replace(f"{{{i}}}", f"{mark}{i}")
    return replacement


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of `text`, in order."""
    known = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))

    def look(s: Column) -> Column:
        return F.element_at(known, F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9.]+", " "), "^[ .]+|[ .]+$", ""))

    def found(s: Column) -> Column:
        first, rest = F.substring_index(s, "\n", 1), F.substring(s, F.locate("\n", s) + 1, F.length(s))
        lines = F.transform(F.split(s, "\n"), look)
        apart = F.when(look(rest).isNotNull(), F.array(look(first), look(rest))).otherwise(lines)
        return F.array_compact(F.when(look(s).isNotNull() | ~F.contains(s, F.lit("\n")), F.array(look(s))).otherwise(apart))

    body = text
    for pattern, put in PREPARED:
        body = F.regexp_replace(body, pattern, _groups(put, "$"))
    likely = F.filter(F.split(body, SENTENCE_END, -1), lambda s: s.rlike(cue_pattern()))
    return F.when(text.rlike(cue_pattern()), F.flatten(F.transform(likely, found))).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with license_sentences and licenses (arrays, in page order) and unmatched (known sentences no rule took)."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn("license_sentences", sentence_ids(body))
    line = F.array_join(F.transform("license_sentences", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    for name, ids in RULES:
        line = F.replace(line, F.lit("".join(f"<{i}>" for i in ids)), F.lit(f"[{name}]"))
    return (
        found.withColumn("_line", line)
        .withColumns({"licenses": F.regexp_extract_all("_line", F.lit(r"\[([^\]]+)\]"), F.lit(1)), "unmatched": F.regexp_extract_all("_line", F.lit("<([^>]+)>"), F.lit(1))})
        .drop("_line")
    )


def duckdb_sql(table: str = "documents") -> str:
    """The same in DuckDB SQL: doc_id, license_sentences, licenses, unmatched, comma-joined."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "map([" + ", ".join(map(quote, SENTENCES)) + "], [" + ", ".join(map(quote, SENTENCES.values())) + "])"
    line = "line"
    for name, ids in RULES:
        line = f"replace({line}, {quote(''.join(f'<{i}>' for i in ids))}, {quote(f'[{name}]')})"
    body = "coalesce(text, '')"
    for pattern, put in PREPARED:
        escaped = put.replace("\n", "' || chr(10) || '")
        body = f"regexp_replace({body}, {quote(pattern)}, '{_groups(escaped, chr(92))}', 'g')"
    look = lambda s: f"{known}[regexp_replace(regexp_replace(lower({s}), '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')]"
    return f"""
WITH cut AS (
  SELECT doc_id, string_split_regex({body}, {quote(SENTENCE_END)}) AS parts FROM {table}
), looked AS (
  SELECT doc_id, list_transform(parts, lambda s: {{'whole': {look('s')}, 'first': {look("split_part(s, chr(10), 1)")}, 'rest': {look("substr(s, strpos(s, chr(10)) + 1)")},
         'lines': list_transform(string_split(s, chr(10)), lambda l: {look('l')})}}) AS parts FROM cut
), ids AS (
  SELECT doc_id, list_filter(flatten(list_transform(parts, lambda p: CASE WHEN p.whole IS NOT NULL OR len(p.lines) = 1 THEN [p.whole] WHEN p.rest IS NOT NULL THEN [p.first, p.rest] ELSE p.lines END)), lambda i: i IS NOT NULL) AS ids FROM looked
), lined AS (
  SELECT doc_id, ids, array_to_string(list_transform(ids, lambda i: '<' || i || '>'), '') AS line FROM ids
), ruled AS (SELECT doc_id, ids, {line} AS line FROM lined)
SELECT doc_id, array_to_string(ids, ',') AS license_sentences,
       array_to_string(regexp_extract_all(line, '\\[([^\\]]+)\\]', 1), ',') AS licenses,
       array_to_string(regexp_extract_all(line, '<([^>]+)>', 1), ',') AS unmatched
FROM ruled"""
