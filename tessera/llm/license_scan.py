"""Licence scans by sentence rules, with SQL functions only.

A text's boundaries are hard (a full stop, question or exclamation mark before white space, unless it is the dot of ``v. 2``; lines
without letters or digits) or soft (other line ends, unless the next line goes on in lower case, and semicolons). A sentence stands between two
boundaries and may run over soft ones, so the lines of a wrapped notice join where they make up a known sentence, whatever their case, while a
line of its own is still one; the longest known sentence counts. A sentence is normalised: lower case, runs of anything but a-z, 0-9 and full
stops become one blank, no blanks or full stops at the ends. Known normalised sentences have identifiers; a text's identifiers, in order, are
matched against ordered rules: a rule that finds its sequence of neighbours gives its licence and uses these up, so later
(more general) rules don't see them. One row for each input row, no shuffle.

Before that, names that vary are made alike: whoever's name isn't to endorse a product (up to 200 characters), whatever program
"is free software" (up to 60 characters on its line). A tag with an expression (OR, AND, WITH, +, brackets) is a tag for each licence in it;
exceptions aren't told. That all rights are reserved, where it follows a copyright on its line or the line before, counts only if no licence is found.

Defined results: a null or empty text has no identifiers and no licences (empty strings, zeros); a licence is named once
however often its rule applies, in the order of rules; repeated rows and equal texts get equal results; a very long text
is scanned whole, in time in proportion to its length; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers of normalised sentences.
SENTENCES = {
    "apache-ref": "licensed under the apache license version 2.0",
    "apache-grant": "licensed under the apache license version 2.0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-ref": "released under the mit license",
    "mit-ref2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "see the gnu general public license for more details",
    "mpl2-ref": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "cc-by-nc-ref": "licensed under cc by nc 4.0",
    "cc-by-sa-ref": "licensed under cc by sa 4.0",
    "cc-by-ref": "licensed under cc by 4.0",
    "rights": "all rights reserved",
    "rights-notice": "all rights reserved beside copyright",
    "gpl2-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl21-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "lgpl3-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-warranty": "see the gnu lesser general public license for more details",
    "agpl3-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-warranty": "see the gnu affero general public license for more details",
    "bsd-advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "epl2-ref": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at",
    "epl2-ref2": "this program and the accompanying materials are made available under the terms of the eclipse public license v2.0",
    "cc0-waive": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "cc-by-long": "this work is licensed under a creative commons attribution 4.0 international license",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2.0",
    "spdx-gpl3": "spdx license identifier gpl 3.0 or later",
}
#: Other identifiers that a tag may name; their sentences follow from them.
TAGGED = ("0BSD", "BSL-1.0", "BSD-4-Clause", "CC-BY-NC-4.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later")
SENTENCES |= {f"spdx-{name.lower()}": "spdx license identifier " + name.lower().replace("-", " ") for name in TAGGED}
#: Older identifiers of tags that name no choice of versions.
BARE = ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
SENTENCES |= {f"spdx-{name.lower()}": "spdx license identifier " + name.lower().replace("-", " ") for name in BARE}
#: Ordered rules, licence and sequence of identifiers.
RULES = (
    ("Apache-2.0", ("apache-grant", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-as-is", "apache-see")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-later", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl-later",)),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-2.0-only", ("gpl2-only", "gpl-warranty")),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("LGPL-2.1-or-later", ("lgpl21-later", "lgpl-warranty")),
    ("LGPL-2.1-or-later", ("lgpl21-later",)),
    ("LGPL-3.0-or-later", ("lgpl3-later", "lgpl-warranty")),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("AGPL-3.0-or-later", ("agpl3-later", "agpl-warranty")),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("Unlicense", ("unlicense",)),
    ("EPL-2.0", ("epl2-ref",)),
    ("EPL-2.0", ("epl2-ref2",)),
    ("CC0-1.0", ("cc0-waive",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("GPL-3.0-or-later", ("spdx-gpl3",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("Apache-2.0", ("apache-ref",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref2",)),
    ("MIT", ("spdx-mit",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    *[(name, (f"spdx-{name.lower()}",)) for name in TAGGED],
    *[(f"{name}-only", (f"spdx-{name.lower()}",)) for name in BARE],
    ("Proprietary", ("rights",)),
    ("Proprietary", ("rights-notice",)),
)
#: Sequences that name their licence only where no rule before has found one; they are used up all the same.
ONLY_ALONE = (("rights-notice",),)
#: Every known sentence has one of these, so other sentences need no normalising.
CUES = ("licen", "permission", "redistribut", "warrant", "copyright", "rights reserved", "noninfringement", "unencumbered", "advertising")
WRAPPED = "\n[ \t#*/;]*([a-z])"
#: Names that vary are replaced before sentences are looked up: (condition on the lower-case text, pattern, replacement).
SLOTS = (
    ("nor the name", r"(?i)neither[^a-z0-9]+the[^a-z0-9]+names?[^a-z0-9]+of[^a-z0-9][\s\S]{1,200}?[^a-z0-9]nor[^a-z0-9]+the[^a-z0-9]+names?[^a-z0-9]+of[^a-z0-9]+(?:(?:its|their|the|any)[^a-z0-9]+)?contributors", "neither the name of the copyright holder nor the names of its contributors"),
    ("rights reserved", r"(?i)(copyright[^\n]{0,300}(?:\n[^\n]{0,300})?[^a-z0-9])all[^a-z0-9]+rights[^a-z0-9]+reserved", "{1}\n\nall rights reserved beside copyright\n\n"),
    ("is free software", r"(?i)(?:[^\n.;:]|\.[0-9]){1,60}?[^a-z0-9\n]is[^a-z0-9\n]+free[^a-z0-9\n]+software[^a-z0-9]+you[^a-z0-9]+can[^a-z0-9]+redistribute", " this program is free software you can redistribute"),
)
#: Within the line of a tag: older marks of later versions, exceptions and brackets, and what stands between licences.
TAG, TAG_PARTS = "spdx-license-identifier:", ((r"(?i)(gpl-[0-9.]+)\+", "{1}-or-later"), (r"(?i)[ \t]+with[ \t]+[a-z0-9.-]+", ""), (r"[()]", " "), (r"(?i)[ \t]+(?:or|and)[ \t]+", "\n\nspdx-license-identifier: "))
#: A tag ends with its line, whatever the next one begins with.
TAG_LINE = r"((?i)spdx-license-identifier:[^\n]*)\n"
#: In lower case, hard boundaries become E, and anything else but soft ones (line ends, semicolons) a blank.
HARD = r"\n[^a-z0-9\n]*\n|(?:(?<!\bv)|(?!\.[ \t\r\n]+[0-9]))[.!?][ \t\r\n]+"
OTHER = "[^a-z0-9.E\n;]+"


def _known() -> str:
    """Known sentences between boundaries, the longest first."""
    longest = sorted(SENTENCES.values(), key=lambda s: (-len(s), s))
    return "(?:^|[\nE;])[ .]*(" + "|".join(s.replace(".", "\\.").replace(" ", "[ \n;]+") for s in longest) + ")[ .]*(?=$|[\nE;])"


def tags_apart(text: Column) -> Column:
    """A text in which a tag that names several licences is a tag for each."""

    def apart(line: Column) -> Column:
        out = line
        for pattern, put in TAG_PARTS:
            out = F.regexp_replace(out, pattern, put.replace("{1}", "$1"))
        return F.when(F.contains(F.lower(line), F.lit(TAG)), out).otherwise(line)

    return F.when(F.contains(F.lower(text), F.lit(TAG)), F.array_join(F.transform(F.split(text, "\n"), apart), "\n")).otherwise(text)


def named_alike(text: Column) -> Column:
    """A text in which holders and programs have the names that the known sentences have."""
    for sign, pattern, put in SLOTS:
        text = F.when(F.contains(F.lower(text), F.lit(sign)), F.regexp_replace(text, pattern, put.replace("{1}", "$1"))).otherwise(text)
    return text


def _sequence(ids: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def _cue(text: Column) -> Column:
    found = F.contains(text, F.lit(CUES[0]))
    for cue in CUES[1:]:
        found = found | F.contains(text, F.lit(cue))
    return found


def found_sentences(text: Column) -> Column:
    """Known sentences in order, normalised."""
    lines = F.regexp_replace(F.regexp_replace(tags_apart(text), TAG_LINE, "$1\n\n"), WRAPPED, " $1")
    marked = F.regexp_replace(F.lower(named_alike(lines)), HARD, "E")
    found = F.regexp_extract_all(F.regexp_replace(marked, OTHER, " "), F.lit(_known()), F.lit(1))
    return F.transform(found, lambda s: F.regexp_replace(s, "[ \n;]+", " "))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licenses, n_unmatched (known sentences that no rule has used)."""
    known = F.create_map(*[F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)])
    text = F.col(text_col)
    ids = F.transform(found_sentences(text), lambda s: F.try_element_at(known, s))
    found = F.when(_cue(F.lower(text)), ids).otherwise(F.array().cast("array<string>"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_sequence(seq)).alias("seq"), F.lit(seq in ONLY_ALONE).alias("alone")) for name, seq in RULES])
    start = F.struct(F.concat(F.lit(""), F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))))).alias("left"), F.array().cast("array<string>").alias("names"))
    named = lambda acc, rule: F.when(rule["alone"] & (F.size(acc["names"]) > 0), acc["names"]).otherwise(F.concat(acc["names"], F.array(rule["name"])))
    step = lambda acc, rule: F.when(
        F.contains(acc["left"], rule["seq"]), F.struct(F.replace(acc["left"], rule["seq"], F.lit("#")).alias("left"), named(acc, rule).alias("names"))
    ).otherwise(acc)
    matched = docs.select(F.col(id_col).cast("long").alias("doc_id"), found.alias("ids")).withColumn("m", F.when(F.size("ids") > 0, F.aggregate(rules, start, step)))
    return matched.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.concat_ws(" ", "ids").alias("sentence_ids"),
        F.coalesce(F.concat_ws(" ", F.array_distinct("m.names")), F.lit("")).alias("licenses"),
        F.coalesce(F.length(F.regexp_replace("m.left", "[^<]+", "")), F.lit(0)).cast("long").alias("n_unmatched"),
    )


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql() -> str:
    """The same in DuckDB's SQL for sentences on one line or wrapped in lower case: a step for each rule."""
    known = "MAP {" + ", ".join(f"{_quote(s)}: {_quote(n)}" for n, s in SENTENCES.items()) + "}"
    steps = ["s0 AS (SELECT doc_id, ids, coalesce(list_reduce(list_prepend('', list_transform(ids, lambda i: '<' || i || '>')), lambda a, b: a || b), '') AS l, [] :: VARCHAR[] AS names FROM found)"]
    for k, (name, seq) in enumerate(RULES):
        q = _quote(_sequence(seq))
        steps.append(f"s{k + 1} AS (SELECT doc_id, ids, replace(l, {q}, '#') AS l, CASE WHEN contains(l, {q}) AND NOT list_contains(names, {_quote(name)}){" AND len(names) = 0" if seq in ONLY_ALONE else ""} THEN list_append(names, {_quote(name)}) ELSE names END AS names FROM s{k})")
    line = "l"
    for pattern, put in TAG_PARTS:
        line = f"regexp_replace({line}, {_quote(pattern)}, {_quote(put.replace('{1}', chr(92) + '1'))}, 'g')"
    apart = f"array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: CASE WHEN contains(lower(l), {_quote(TAG)}) THEN {line} ELSE l END), chr(10))"
    lines = f"regexp_replace(regexp_replace({apart}, '(?i)(spdx-license-identifier:[^\\n]*)\\n', '\\1' || chr(10) || chr(10), 'g'), '\\n[ \\t#*/;]*([a-z])', ' \\1', 'g')"
    for _, pattern, put in SLOTS:
        lines = f"regexp_replace({lines}, {_quote(pattern)}, {_quote(put.replace('{1}', chr(92) + '1'))}, 'g')"
    return f"""WITH cut AS (SELECT doc_id, regexp_split_to_array({lines}, '[.!?]+[ \\t\\r\\n]+|\\n+') AS parts FROM documents),
found AS (SELECT doc_id, list_filter(list_transform(parts, lambda s: {known}[trim(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), ' .')]), lambda i: i IS NOT NULL) AS ids FROM cut),
{", ".join(steps)}
SELECT doc_id, len(ids) :: BIGINT AS n_sentences, array_to_string(ids, ' ') AS sentence_ids, array_to_string(names, ' ') AS licenses,
length(regexp_replace(l, '[^<]+', '', 'g')) :: BIGINT AS n_unmatched FROM s{len(RULES)}"""
