"""Licence recognition by sentences and ordered rules, with DataFrame functions alone.

A text is cut into sentences, each is normalised (lower case, runs of other characters than a-z and 0-9 become one space,
an introduction such as "this work is licensed under the terms of the" becomes "under") and looked up among the known
licence sentences.  A text is then a sequence of identifiers; the ordered rules turn sub-sequences into licences, each
identifier counts for the first rule that takes it.  At most two unknown sentences may lie between the parts of a rule.

A text whose normalised form has none of the ``SIGNS`` holds no known sentence (every known sentence has one in this form)
and skips the work.

Defined results: null and empty texts have no sentence and no licence; rows are judged one by one, so repeated rows give
repeated results; all other columns stay out of the result, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values -----------------------------------------------------------------------------------------------------
# Known sentences after normalisation, with their identifiers.
SENTENCES = {
    "under mit license": "MIT-NAME",
    "the mit license": "MIT-TITLE",
    "mit license": "MIT-TITLE",
    "the mit license mit": "MIT-TITLE",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT-GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT-NOTICE",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AS-IS",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "NO-LIABILITY",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-GRANT",
    "under isc license": "ISC-NAME",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD-GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD-SOURCE",
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD-SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD-BINARY",
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD-BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD-NAMES",
    "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD-NAMES",
    "under bsd 3 clause license": "BSD3-NAME",
    "under 3 clause bsd license": "BSD3-NAME",
    "under bsd 2 clause license": "BSD2-NAME",
    "under 2 clause bsd license": "BSD2-NAME",
    "under bsd license": "BSD-NAME",
    "under apache license version 2 0": "APACHE2-NAME",
    "under apache license 2 0": "APACHE2-NAME",
    "under apache license version 2 0 the license": "APACHE2-NAME",
    "apache license version 2 0": "APACHE2-NAME",
    "you may not use this file except in compliance with the license": "APACHE-COMPLY",
    "you may obtain a copy of the license at": "APACHE-COPY",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE-AS-IS",
    "see the license for the specific language governing permissions and limitations under the license": "APACHE-SEE",
    "under gnu general public license version 3": "GPL3-NAME",
    "under gnu general public license v3 0": "GPL3-NAME",
    "under gnu gpl v3": "GPL3-NAME",
    "under gplv3": "GPL3-NAME",
    "under gnu general public license version 2": "GPL2-NAME",
    "under gnu general public license": "GPL-NAME",
    "under gnu lesser general public license version 3": "LGPL3-NAME",
    "under gnu lesser general public license version 2 1": "LGPL21-NAME",
    "under gnu affero general public license version 3": "AGPL3-NAME",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3-GRANT",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3-GRANT",
    "this program is free software": "FREE-SOFTWARE",
    "this program is distributed in the hope that it will be useful but without any warranty": "GPL-HOPE",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GPL-IMPLIED",
    "see the gnu general public license for more details": "GPL-SEE",
    "under mozilla public license version 2 0": "MPL2-NAME",
    "under mozilla public license v 2 0": "MPL2-NAME",
    "under cc by 4 0": "CC-BY4-NAME",
    "under creative commons attribution 4 0 international license": "CC-BY4-NAME",
    "under cc by sa 4 0": "CC-BY-SA4-NAME",
    "under creative commons attribution sharealike 4 0 international license": "CC-BY-SA4-NAME",
    "under cc by nc 4 0": "CC-BY-NC4-NAME",
    "under creative commons attribution noncommercial 4 0 international license": "CC-BY-NC4-NAME",
    "under cc by nd 4 0": "CC-BY-ND4-NAME",
    "under cc by nc sa 4 0": "CC-BY-NC-SA4-NAME",
    "under cc by nc nd 4 0": "CC-BY-NC-ND4-NAME",
    "under cc0 1 0": "CC0-NAME",
    "this is free and unencumbered software released into the public domain": "UNLICENSE-GRANT",
    "this work is in the public domain": "PUBLIC-DOMAIN",
    "all rights reserved": "ALL-RIGHTS",
    "no part of this publication may be reproduced distributed or transmitted in any form without permission": "NO-REPRODUCTION",
}
# Rules in order: licence, category, identifiers that follow each other.
RULES = [
    ("MIT", "permissive", ["MIT-GRANT", "MIT-NOTICE", "AS-IS", "NO-LIABILITY"]),
    ("MIT", "permissive", ["MIT-GRANT", "MIT-NOTICE"]),
    ("ISC", "permissive", ["ISC-GRANT"]),
    ("BSD-3-Clause", "permissive", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES"]),
    ("BSD-2-Clause", "permissive", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY"]),
    ("Apache-2.0", "permissive", ["APACHE2-NAME", "APACHE-COMPLY", "APACHE-COPY"]),
    ("GPL-3.0-or-later", "copyleft", ["FREE-SOFTWARE", "GPL3-GRANT", "GPL-HOPE"]),
    ("GPL-3.0-or-later", "copyleft", ["GPL3-GRANT"]),
    ("Apache-2.0", "permissive", ["APACHE2-NAME"]),
    ("MIT", "permissive", ["MIT-NAME"]),
    ("MIT", "permissive", ["MIT-TITLE"]),
    ("ISC", "permissive", ["ISC-NAME"]),
    ("BSD-3-Clause", "permissive", ["BSD3-NAME"]),
    ("BSD-2-Clause", "permissive", ["BSD2-NAME"]),
    ("BSD", "permissive", ["BSD-NAME"]),
    ("AGPL-3.0", "copyleft", ["AGPL3-NAME"]),
    ("LGPL-3.0", "copyleft", ["LGPL3-NAME"]),
    ("LGPL-2.1", "copyleft", ["LGPL21-NAME"]),
    ("GPL-3.0", "copyleft", ["GPL3-NAME"]),
    ("GPL-2.0", "copyleft", ["GPL2-NAME"]),
    ("GPL", "copyleft", ["GPL-NAME"]),
    ("MPL-2.0", "copyleft", ["MPL2-NAME"]),
    ("CC-BY-4.0", "permissive", ["CC-BY4-NAME"]),
    ("CC-BY-SA-4.0", "copyleft", ["CC-BY-SA4-NAME"]),
    ("CC-BY-NC-4.0", "restricted", ["CC-BY-NC4-NAME"]),
    ("CC-BY-ND-4.0", "restricted", ["CC-BY-ND4-NAME"]),
    ("CC-BY-NC-SA-4.0", "restricted", ["CC-BY-NC-SA4-NAME"]),
    ("CC-BY-NC-ND-4.0", "restricted", ["CC-BY-NC-ND4-NAME"]),
    ("CC0-1.0", "permissive", ["CC0-NAME"]),
    ("Unlicense", "permissive", ["UNLICENSE-GRANT"]),
    ("Public-Domain", "permissive", ["PUBLIC-DOMAIN"]),
    ("Proprietary", "restricted", ["NO-REPRODUCTION"]),
    ("Proprietary", "restricted", ["ALL-RIGHTS"]),
]
SIGNS = "licen[cs]e|copyright|rights reserved|permission|warrant|redistribut|public domain|under .{0,40}(?:cc|gpl)|is free software|no part of this publication"
SENTENCE_END = r"[.!?;:]+[\"')\]]*(?:[\t\n\f\r ]+|$)|\n[\t\f\r ]*\n"
INTRODUCTION = (
    "^(?:this (?:work|file|software|program|code|document|project|text|article|page) (?:is|are) |it is |code is |content is )?"
    "(?:licensed|released|distributed|made available|available|provided|published)(?: by .{1,60})? under (?:the )?(?:terms of )?(?:the )?"
)
COPYRIGHT = "^copyright (?:c )?[0-9]{4}"
# ----------------------------------------------------------------------------------------------------------------------
CUT = "\x01"
GAP = 2


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normalised(sentence: Column) -> Column:
    return F.regexp_replace(plain(sentence), INTRODUCTION, "under ")


def identifier(sentence: Column) -> Column:
    """Identifier of one sentence or null."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    form = normalised(sentence)
    return F.coalesce(F.try_element_at(known, form), F.when(form.rlike(COPYRIGHT), F.lit("COPYRIGHT")))


def identifiers(text: Column) -> Column:
    """Identifiers in order, ``-`` for an unknown sentence; an unknown sentence over several lines counts line by line."""
    sentences = F.split(F.regexp_replace(text, SENTENCE_END, CUT), CUT)
    sentences = F.filter(sentences, lambda s: F.trim(s) != "")
    by_line = F.flatten(F.transform(sentences, lambda s: F.when(s.contains("\n") & identifier(s).isNull(), F.split(s, "\n")).otherwise(F.array(s))))
    return F.transform(by_line, lambda s: F.coalesce(identifier(s), F.lit("-")))


def recognised(ids: Column) -> Column:
    """The identifier string with what a rule took replaced by ``@`` and the rule's number."""
    # each identifier has its own blanks, so neighbours do not share one
    out = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    for k, (_, _, parts) in enumerate(RULES):
        pattern = f" {f'  (?:-  ){{0,{GAP}}}'.join(parts)} "
        out = F.regexp_replace(out, pattern, f" @{k} ")
    return out


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: known sentences, licences by first appearance (comma separated), and the strictest category.

    Categories from strict to free: restricted, copyleft, permissive; ``none`` without a licence, ``unclear`` if there
    are known licence sentences which no rule takes (a copyright line alone is none).
    """
    body = F.col(text)
    signed = plain(body).rlike(SIGNS)
    rows = docs.select(F.col(key).alias("doc_id"), F.when(signed, identifiers(body)).alias("_ids"))
    rows = rows.select("doc_id", F.coalesce("_ids", F.array().cast("array<string>")).alias("_ids"))
    rows = rows.withColumn("_found", F.when(F.exists("_ids", lambda x: x != "-"), recognised(F.col("_ids"))).otherwise(""))
    names = F.create_map(*[F.lit(x) for k, r in enumerate(RULES) for x in (str(k), r[0])])
    kinds = F.create_map(*[F.lit(x) for k, r in enumerate(RULES) for x in (str(k), r[1])])
    rows = rows.withColumn("_rules", F.regexp_extract_all("_found", F.lit("@([0-9]+)"), F.lit(1)))
    rows = rows.withColumn("_kinds", F.transform("_rules", lambda k: kinds[k]))
    left = F.exists("_ids", lambda x: ~x.isin("-", "COPYRIGHT"))
    category = F.when(F.array_contains("_kinds", "restricted"), "restricted").when(F.array_contains("_kinds", "copyleft"), "copyleft")
    category = category.when(F.array_contains("_kinds", "permissive"), "permissive").when(left, "unclear").otherwise("none")
    return rows.select(
        "doc_id",
        F.size(F.filter("_ids", lambda x: x != "-")).cast("long").alias("n_known"),
        F.array_join(F.array_distinct(F.transform("_rules", lambda k: names[k])), ",").alias("licences"),
        category.alias("category"),
    )
