"""Licences by sentence rules. DataFrame functions only, without a shuffle.

A text is cut into sentences, each normalised to lower-case words; those of a table of known
licence sentences become identifiers. The rules name the sequences of identifiers that
make a licence. They are tried in their order, longer and more specific ones
first, and use up the identifiers they match, so a full licence is not
reported again by the notice inside it. Sentences are cut in three ways, at the ends of sentences
alone (for licences wrapped over lines), at line breaks too, and at the ends of sentences, blank lines and
copyright lines (for headings without a full stop); a sequence lies within one of them. A sentence that is
itself cut is known by all its parts in a row.

Defined results: null and empty texts, and those without known sentences, have none. Rows are
independent; other columns pass through, whatever their names, but for ``licence_sentences`` and ``licences``, which the
result takes. An empty table gives an empty one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.llm.common import TEXT

#: Sentences of public licences and usual notices, by identifier.
SENTENCES = {
    "MIT.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT.warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "MIT.released": "Released under the MIT License.",
    "MIT.licensed": "Licensed under the MIT License.",
    "ISC.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD.head": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD.licensed": "Licensed under the BSD License.",
    "Apache.licensed": "Licensed under the Apache License, Version 2.0.",
    "Apache.grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "Apache.copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL3.licensed": "This work is licensed under the GNU General Public License, version 3.",
    "GPL.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL2.free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL.copy": "You should have received a copy of the GNU General Public License along with this program.",
    "LGPL.free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL2.form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY.licensed": "Licensed under CC BY 4.0.",
    "CC-BY-SA.licensed": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC.licensed": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND.licensed": "Licensed under CC BY-ND 4.0.",
    "CC-BY.work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA.work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC.work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "PD.free": "This is free and unencumbered software released into the public domain.",
}
#: Licences and the sentences in a row that make them, in the order they are tried.
RULES = [
    ("MIT", ["MIT.grant", "MIT.notice", "MIT.warranty"]),
    ("BSD-3-Clause", ["BSD.head", "BSD.source", "BSD.binary", "BSD.endorse"]),
    ("BSD-2-Clause", ["BSD.head", "BSD.source", "BSD.binary"]),
    ("ISC", ["ISC.grant"]),
    ("Apache-2.0", ["Apache.grant", "Apache.copy"]),
    ("GPL-3.0-or-later", ["GPL.free", "GPL.copy"]),
    ("GPL-3.0-or-later", ["GPL.free"]),
    ("GPL-2.0-or-later", ["GPL2.free"]),
    ("LGPL-2.1-or-later", ["LGPL.free"]),
    ("MPL-2.0", ["MPL2.form"]),
    ("Unlicense", ["PD.free"]),
    ("GPL-3.0-only", ["GPL3.licensed"]),
    ("Apache-2.0", ["Apache.grant"]),
    ("Apache-2.0", ["Apache.licensed"]),
    ("MIT", ["MIT.grant"]),
    ("MIT", ["MIT.released"]),
    ("MIT", ["MIT.licensed"]),
    ("BSD", ["BSD.licensed"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC.licensed"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC.work"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA.licensed"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA.work"]),
    ("CC-BY-ND-4.0", ["CC-BY-ND.licensed"]),
    ("CC-BY-4.0", ["CC-BY.licensed"]),
    ("CC-BY-4.0", ["CC-BY.work"]),
]
#: A text without any of these holds no known sentence.
HINTS = ("licen", "permi", "redistribut", "warrant", "public domain")
SENTENCE_END = r"[.!?:;][ \t\r\n]+"
LINE_END = r"[.!?:;][ \t\r\n]+|\n+"
BLOCK_END = r"[.!?:;][ \t\r\n]+|\n[ \t\r]*\n\s*|(?:^|\n)[^\na-zA-Z0-9]*(?i:copyright)[ \t]+(?:\([cC]\)|©|[0-9])[^\n]*\n"


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def _known() -> dict[str, str]:
    """Identifiers by normalised sentence. A sentence may itself be cut at a colon or
    semicolon; its first part stands for it where no other sentence begins so."""
    out: dict[str, str] = {}
    for name, sentence in SENTENCES.items():
        for end in (SENTENCE_END, None):
            key = normalised(re.split(end, sentence)[0] if end else sentence)
            if any(h in key for h in HINTS):
                out.setdefault(key, name)
    return out


KNOWN = _known()


def _parted() -> tuple[dict[str, str], dict[str, str]]:
    """KNOWN and identifiers of the parts of sentences that their first part can't stand for; sequences of such parts."""
    known, sequences = dict(KNOWN), {}
    for name, sentence in SENTENCES.items():
        parts = [normalised(x) for x in re.split(SENTENCE_END, sentence)]
        if KNOWN.get(parts[0]) != name:
            sequences["".join(f" {known.setdefault(k, f'~{len(known)}')} " for k in parts)] = name
    return known, sequences


PARTS, SEQUENCES = _parted()


def _identifiers(text: Column, ends: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PARTS.items() for x in pair])
    clean = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    hints = [*HINTS, *(k.replace(" ", "[^a-z0-9]+") for k in PARTS if not any(h in k for h in HINTS))]
    hinted = lambda s: F.lower(s).rlike("|".join(hints))
    parts = F.filter(F.split(text, ends), hinted)
    found = F.filter(F.transform(parts, lambda s: F.element_at(table, clean(s))), lambda x: x.isNotNull())
    row = F.array_join(F.transform(found, lambda x: F.concat(F.lit(" "), x, F.lit(" "))), "")
    for sequence, name in sorted(SEQUENCES.items(), key=lambda x: -len(x[0])):
        row = F.replace(row, F.lit(sequence), F.lit(f" {name} "))
    return F.filter(F.split(row, " +"), lambda x: (x != "") & ~x.startswith("~"))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with licence_sentences (array of identifiers in order) and licences (array, in the order of the rules)."""
    text = F.coalesce(F.col(TEXT), F.lit(""))
    hinted = F.lower(text).rlike("|".join(HINTS))
    none = F.array().cast("array<string>")
    keep = [c for c in docs.columns if c not in ("licence_sentences", "licences")]
    row = F.struct(*(docs[c] for c in keep)).alias("row")  # its names can't clash with those used here
    found = docs.select(
        row,
        F.when(hinted, _identifiers(text, SENTENCE_END)).otherwise(none).alias("__a"),
        F.when(hinted, _identifiers(text, LINE_END)).otherwise(none).alias("__b"),
        F.when(hinted, _identifiers(text, BLOCK_END)).otherwise(none).alias("__c"),
    )
    joined = lambda c: F.concat(F.lit("  "), F.array_join(c, "  "), F.lit("  "))
    rules = F.array(*[F.struct(F.lit(n).alias("licence"), F.lit("".join(f" {x} " for x in s)).alias("ids")) for n, s in RULES])
    state = F.struct(F.concat(joined("__a"), F.lit("#"), joined("__b"), F.lit("#"), joined("__c")).alias("left"), none.alias("licences"))

    def apply(s, rule):
        hit = F.contains(s.left, rule.ids)
        return F.struct(
            F.when(hit, F.replace(s.left, rule.ids, F.lit("  "))).otherwise(s.left).alias("left"),
            F.when(hit, F.array_union(s.licences, F.array(rule.licence))).otherwise(s.licences).alias("licences"),
        )

    any_known = (F.size("__a") > 0) | (F.size("__b") > 0) | (F.size("__c") > 0)
    licences = F.when(any_known, F.aggregate(rules, state, apply).getField("licences")).otherwise(none)
    longer = F.when(F.size("__b") >= F.size("__a"), F.col("__b")).otherwise(F.col("__a"))
    longer = F.when(F.size("__c") > F.greatest(F.size("__a"), F.size("__b")), F.col("__c")).otherwise(longer)
    return found.select(*(F.col("row").getField(c).alias(c) for c in keep), longer.alias("licence_sentences"), licences.alias("licences"))


def sql() -> str:
    """The same in DuckDB's SQL: doc_id, n_sentences, sentences and licences of every row of documents."""
    known = ", ".join(f"('{k}', '{v}')" for k, v in KNOWN.items())
    hints = "|".join(HINTS)
    found = lambda name, ends: f"""
  {name} AS (SELECT doc_id, list(name ORDER BY i) AS ids FROM (
      SELECT doc_id, i, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS key FROM (
        SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '{ends}') AS p FROM hinted))
      WHERE regexp_matches(lower(s), '{hints}')) JOIN known USING (key) GROUP BY doc_id)"""  # noqa: E731
    steps = []
    for i, (licence, names) in enumerate(RULES):
        ids = "".join(f" {x} " for x in names)
        steps.append(f"""
  s{i + 1} AS (SELECT doc_id, a, b, CASE WHEN contains(rest, '{ids}') THEN replace(rest, '{ids}', '  ') ELSE rest END AS rest,
      CASE WHEN contains(rest, '{ids}') AND NOT list_contains(got, '{licence}') THEN list_append(got, '{licence}') ELSE got END AS got FROM s{i})""")
    return f"""
WITH known AS (SELECT * FROM (VALUES {known}) v(key, name)),
  hinted AS (SELECT doc_id, text FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '{hints}')),
  {found('plain', SENTENCE_END)},
  {found('lined', LINE_END)},
  s0 AS (SELECT doc_id, coalesce(x.ids, []) AS a, coalesce(y.ids, []) AS b,
      '  ' || array_to_string(coalesce(x.ids, []), '  ') || '  #  ' || array_to_string(coalesce(y.ids, []), '  ') || '  ' AS rest, []::VARCHAR[] AS got
      FROM documents LEFT JOIN plain x USING (doc_id) LEFT JOIN lined y USING (doc_id)),{",".join(steps)}
SELECT doc_id, greatest(len(a), len(b))::BIGINT AS n_sentences, array_to_string(CASE WHEN len(b) >= len(a) THEN b ELSE a END, ',') AS sentences,
       array_to_string(got, ',') AS licences FROM s{len(RULES)}"""
