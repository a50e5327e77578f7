"""Licence scans by sentence rules.

A text's sentences are normalised and looked up among the known licence
sentences; the identifiers found, in order, are then matched against the
licence rules, each an ordered list of identifiers that may have other sentences between.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences and their identifiers. {v} stands for a version, {y} for any words.
SENTENCES = {
    "apache.short": "licensed under the apache license version 2 0",
    "apache.may_not": "you may not use this file except in compliance with the license",
    "apache.as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "mit.short": "released under the mit license",
    "mit.title": "mit license",
    "mit.title2": "the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind",
    "gpl3.short": "this work is licensed under the gnu general public license version 3",
    "gpl2.short": "this work is licensed under the gnu general public license version 2",
    "gpl.redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "ccbync.short": "licensed under cc by nc 4 0",
    "ccby.short": "licensed under cc by 4 0",
    "ccbysa.short": "licensed under cc by sa 4 0",
    "ccby.long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0.short": "this work is dedicated to the public domain under cc0 1 0",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.no_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2.short": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "spdx.mit": "spdx license identifier mit",
    "spdx.apache": "spdx license identifier apache 2 0",
    "spdx.gpl3": "spdx license identifier gpl 3 0 only",
    "rights": "all rights reserved",
}

# Licence rules in order of precedence, as (licence, ordered sentence identifiers).
RULES = (
    ("Apache-2.0", ("apache.short", "apache.may_not", "apache.as_is")),
    ("Apache-2.0", ("apache.short",)),
    ("Apache-2.0", ("spdx.apache",)),
    ("MIT", ("mit.grant", "mit.notice", "as_is")),
    ("MIT", ("mit.title", "mit.grant")),
    ("MIT", ("mit.short",)),
    ("MIT", ("spdx.mit",)),
    ("GPL-3.0", ("gpl3.short",)),
    ("GPL-3.0", ("spdx.gpl3",)),
    ("GPL-2.0", ("gpl2.short",)),
    ("GPL", ("gpl.redistribute",)),
    ("BSD-3-Clause", ("bsd.grant", "bsd.no_endorse")),
    ("BSD-2-Clause", ("bsd.grant",)),
    ("CC-BY-NC-4.0", ("ccbync.short",)),
    ("CC-BY-SA-4.0", ("ccbysa.short",)),
    ("CC-BY-4.0", ("ccby.short",)),
    ("CC-BY-4.0", ("ccby.long",)),
    ("CC0-1.0", ("cc0.short",)),
    ("MPL-2.0", ("mpl2.short",)),
    ("proprietary", ("rights",)),
)

# The same sentences as the licences' own texts have them, in full and with their variants.
FULL_SENTENCES = (
    ("apache.title", "apache license version 2 0 january 2004 http www apache org licenses"),
    ("apache.short", "licensed under the apache license version 2 0 the license"),
    ("apache.as_is", SENTENCES["apache.as_is"] + " without warranties or conditions of any kind either express or implied"),
    ("mit.title2", "the mit license mit"),
    ("mit.title", "mit license mit"),
    ("mit.grant", SENTENCES["mit.grant"] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit.notice", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    ("as_is", SENTENCES["as_is"] + " express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("gpl3.title", "gnu general public license version 3 29 june 2007"),
    ("gpl2.title", "gnu general public license version 2 june 1991"),
    ("gpl3.redistribute", SENTENCES["gpl.redistribute"] + " either version 3 of the license or at your option any later version"),
    ("gpl2.redistribute", SENTENCES["gpl.redistribute"] + " either version 2 of the license or at your option any later version"),
    ("gpl.terms", SENTENCES["gpl.redistribute"].removeprefix("this program is free software ")),
    ("gpl2.either", "either version 2 of the license or at your option any later version"),
    ("gpl3.either", "either version 3 of the license or at your option any later version"),
    ("bsd.grant", SENTENCES["bsd.grant"] + " 1"),
    ("mpl2.short", "this source code form is subject to the terms of the mozilla public license v"),
    ("isc.grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd.grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib.grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib.grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1"),
    ("unlicense.domain", "this is free and unencumbered software released into the public domain"),
    ("bsl.title", "boost software license version 1 0 august 17th 2003"),
    ("lgpl3.title", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl21.title", "gnu lesser general public license version 2 1 february 1999"),
    ("agpl3.title", "gnu affero general public license version 3 19 november 2007"),
    ("gpl3.terms_either", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2.terms_either", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("agpl3.terms_either", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl3.terms_either", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl.terms", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl21.either", "either version 2 1 of the license or at your option any later version"),
    ("epl2.terms", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
)

# Identifiers of the licence list that stand alone after "SPDX-License-Identifier:".
SPDX = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0", "Unlicense", "Zlib")


def _plain(text: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


FULL_SENTENCES += tuple((f"spdx.{_plain(x).replace(' ', '_')}", _plain(f"SPDX-License-Identifier: {x}")) for x in SPDX)
# the Creative Commons licences are named alike in all their combinations
CREATIVE = (("CC-BY", "attribution"), ("CC-BY-SA", "attribution sharealike"), ("CC-BY-NC", "attribution noncommercial"), ("CC-BY-ND", "attribution noderivatives"), ("CC-BY-NC-SA", "attribution noncommercial sharealike"), ("CC-BY-NC-ND", "attribution noncommercial noderivatives"))
FULL_SENTENCES += tuple(
    (f"{_plain(ident).replace(' ', '')}.{kind}", text.format(name))
    for ident, name in CREATIVE
    for kind, text in (("a", "this work is licensed under a creative commons {} 4 0 international license"), ("the", "this work is licensed under the creative commons {} 4 0 international license"), ("title", "creative commons {} 4 0 international public license"))
    if text.format(name) not in SENTENCES.values()
)

#: The holder's name stands in this sentence: (identifier, start, whole).
NAMED = ("bsd.no_endorse", "neither the name of ", "^neither the names? of .+ nor the names of (its|any|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission$")

FULL_RULES = (
    ("Apache-2.0", ("apache.title",)),
    ("GPL-3.0", ("gpl3.title",)),
    ("GPL-3.0", ("gpl3.redistribute",)),
    ("GPL-3.0", ("gpl.terms", "gpl3.either")),
    ("GPL-2.0", ("gpl2.title",)),
    ("GPL-2.0", ("gpl2.redistribute",)),
    ("GPL-2.0", ("gpl.terms", "gpl2.either")),
    ("GPL", ("gpl.terms",)),
    ("ISC", ("isc.grant",)),
    ("0BSD", ("0bsd.grant",)),
    ("Zlib", ("zlib.grant",)),
    ("Unlicense", ("unlicense.domain",)),
    ("BSL-1.0", ("bsl.title",)),
    ("GPL-3.0", ("gpl3.terms_either",)),
    ("GPL-2.0", ("gpl2.terms_either",)),
    ("AGPL-3.0", ("agpl3.title",)),
    ("AGPL-3.0", ("agpl3.terms_either",)),
    ("LGPL-3.0", ("lgpl3.title",)),
    ("LGPL-3.0", ("lgpl3.terms_either",)),
    ("LGPL-2.1", ("lgpl21.title",)),
    ("LGPL-2.1", ("lgpl.terms", "lgpl21.either")),
    ("EPL-2.0", ("epl2.terms",)),
)
#: A licence is named without "only" and "or later", as the rules above name it.
FULL_RULES += tuple((re.sub("-(only|or-later)$", "", x), (f"spdx.{_plain(x).replace(' ', '_')}",)) for x in SPDX)
FULL_RULES += tuple((f"{ident}-4.0", (i,)) for ident, _ in CREATIVE for i, _ in FULL_SENTENCES if i.startswith(_plain(ident).replace(" ", "") + "."))

#: A sentence that is wrapped goes on over a line end: it ends at one of . ! ? ; or at a line without letters and digits.
WRAPPED_END = r"(?:\r\n|\r(?!\n)|\n)[^\p{L}\p{N}\r\n]*[\r\n]|[.!?;]+(?=\s|$)"

#: A sentence ends at a line end, or at one of . ! ? ; before white space or the end.
SENTENCE_END = r"[\r\n]+|[.!?;]+(?=\s|$)"


def normalised(sentence: Column) -> Column:
    """Lower case; every run of other than a-z and 0-9 is one blank; trimmed."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: tuple = RULES + FULL_RULES) -> DataFrame:
    """(id_col, sentence_ids, n_sentences, licenses, n_licenses), one row for each row of ``docs``.

    ``sentence_ids`` are the known sentences found, in order, joined by blanks;
    ``licenses`` the licences whose rule fits, in rule order without repeats, joined by ``|``.
    A known sentence may be wrapped over lines, with comment signs before them,
    and follow lines that end without a stop, such as a title or a holder.
    ``n_sentences`` counts those of the text that are not blank.
    Null and empty texts give empty strings and 0. Whole texts are read in one
    narrow pass: no shuffle, so no key can be hot. Repeated rows each keep their
    row; an empty table gives an empty table; extra columns do not matter.
    """
    known = [*SENTENCES.items(), *FULL_SENTENCES] if sentences is None else list(sentences.items())
    table = F.create_map(*[F.lit(x) for ident, text in known for x in (text, ident)])
    most = max((len(text.split()) for _, text in known), default=1)  # a line has a word at least, so no known sentence has more lines
    parts = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), SENTENCE_END), lambda s: F.trim(s) != "")

    texts = [text for _, text in known]

    def ident(s: Column) -> Column:
        got = F.when(s.isin(texts), F.try_element_at(table, s)) if texts else F.lit(None).cast("string")  # a set first: a map is searched from its start
        return F.coalesce(got, F.when(F.startswith(s, F.lit(NAMED[1])) & F.rlike(s, F.lit(NAMED[2])), F.lit(NAMED[0]))) if sentences is None else got

    def of_lines(lines: Column) -> Column:
        """The longest known end of the lines, after what is known of the lines before it."""
        n = F.size(lines)
        ends = F.transform(F.sequence(F.greatest(n - (most - 1), F.lit(1)), n), lambda at: F.struct(at.alias("at"), ident(F.array_join(F.slice(lines, at, n), " ")).alias("id")))
        ends = F.filter(ends, lambda e: e["id"].isNotNull())
        split = F.transform(F.array(F.coalesce(F.get(ends, F.lit(0)), F.struct((n + 1).alias("at"), F.lit(None).cast("string").alias("id")))), lambda e: F.concat(F.transform(F.slice(lines, 1, e["at"] - 1), ident), F.array(e["id"])))
        return F.when(n == 1, F.array(ident(lines[0]))).otherwise(F.flatten(split))

    wrapped = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), WRAPPED_END), lambda s: F.filter(F.transform(F.split(s, r"[\r\n]+"), normalised), lambda x: x != ""))
    ids = F.filter(F.flatten(F.transform(F.filter(wrapped, lambda x: F.size(x) > 0), of_lines)), lambda x: x.isNotNull())
    rows = docs.select(F.col(id_col), F.size(parts).cast("long").alias("n_sentences"), ids.alias("ids"))
    rows = rows.select(id_col, "n_sentences", F.array_join("ids", " ").alias("sentence_ids"))
    padded = F.concat(F.lit(" "), F.col("sentence_ids"), F.lit(" "))
    fits = [F.when(padded.rlike(".* " + " (?:.* )?".join(map(re.escape, rule)) + " "), F.lit(name)) for name, rule in rules]
    found = F.array_distinct(F.filter(F.array(*fits), lambda x: x.isNotNull())) if fits else F.array().cast("array<string>")
    return rows.select(id_col, "sentence_ids", "n_sentences", F.array_join(found, "|").alias("licenses"), F.size(found).cast("long").alias("n_licenses"))
