"""Licence scans by sentence rules, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A licence that is found when its sentences occur in this order, others between them allowed.

    ``unless`` names rules that say more; where one of them is found this one isn't reported.
    """

    licence: str
    sentences: tuple[str, ...]
    unless: tuple[str, ...] = ()


# Known licence sentences by identifier, in the form normal_form() gives.
SENTENCES = {
    "reserved": ("all rights reserved",),
    "mit_released": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license",
                     "distributed under the mit license", "spdx license identifier mit"),
    "mit_grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
                  "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
                  "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
                  "furnished to do so subject to the following conditions",),
    "mit_notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "as_is": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
              "merchantability fitness for a particular purpose and noninfringement",),
    "apache_short": ("licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license",
                     "released under the apache license version 2.0", "distributed under the apache license version 2.0",
                     "licensed under the apache 2.0 license", "released under the apache 2.0 license", "spdx license identifier apache 2.0"),
    "apache_head": ("apache license",),
    "apache_version": ("version 2.0 january 2004",),
    "apache_comply": ("you may not use this file except in compliance with the license",),
    "apache_copy": ("you may obtain a copy of the license at http www.apache.org licenses license 2.0",),
    "gpl3_short": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3",
                   "released under the gnu general public license version 3"),
    "gpl_grant": ("this program is free software", "this library is free software"),
    "gpl_modify": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
                   "software foundation",),
    "lgpl_modify": ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
                    "software foundation",),
    "either_2": ("either version 2 of the license or at your option any later version",),
    "either_21": ("either version 2.1 of the license or at your option any later version",),
    "either_3": ("either version 3 of the license or at your option any later version",),
    "lgpl3_or_later": ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
                       "software foundation either version 3 of the license or at your option any later version",),
    "gpl3_spdx": ("spdx license identifier gpl 3.0 or later",),
    "gpl2_spdx": ("spdx license identifier gpl 2.0 or later",),
    "bsd3_spdx": ("spdx license identifier bsd 3 clause",),
    "bsd2_spdx": ("spdx license identifier bsd 2 clause",),
    "gpl3_or_later": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
                      "software foundation either version 3 of the license or at your option any later version",),
    "gpl2_or_later": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
                      "software foundation either version 2 of the license or at your option any later version",),
    "cc_by": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "cc_by_sa": ("licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    "cc_by_nc": ("licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    "cc0": ("released under cc0 1.0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    "bsd_grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following "
                  "conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
                   "disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd_endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                    "derived from this software without specific prior written permission",),
    "isc_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
                  "that the above copyright notice and this permission notice appear in all copies",),
    "mpl_short": ("this source code form is subject to the terms of the mozilla public license v. 2.0",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
}

# The licence rules, in order; a rule that says more stands before those it hides.
RULES = (
    Rule("MIT", ("mit_grant", "mit_notice", "as_is")),
    Rule("MIT", ("mit_released",)),
    Rule("Apache-2.0", ("apache_short", "apache_comply", "apache_copy")),
    Rule("Apache-2.0", ("apache_short",)),
    Rule("Apache-2.0", ("apache_head", "apache_version")),
    Rule("GPL-3.0-or-later", ("gpl_grant", "gpl3_or_later")),
    Rule("GPL-3.0-or-later", ("gpl_grant", "gpl_modify", "either_3")),
    Rule("GPL-3.0-or-later", ("gpl3_spdx",)),
    Rule("GPL-2.0-or-later", ("gpl_grant", "gpl2_or_later")),
    Rule("GPL-2.0-or-later", ("gpl_grant", "gpl_modify", "either_2")),
    Rule("GPL-2.0-or-later", ("gpl2_spdx",)),
    Rule("LGPL-3.0-or-later", ("gpl_grant", "lgpl3_or_later")),
    Rule("LGPL-3.0-or-later", ("gpl_grant", "lgpl_modify", "either_3")),
    Rule("LGPL-2.1-or-later", ("gpl_grant", "lgpl_modify", "either_21")),
    Rule("GPL-3.0", ("gpl3_short",)),
    Rule("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    Rule("BSD-3-Clause", ("bsd3_spdx",)),
    Rule("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary"), ("BSD-3-Clause",)),
    Rule("BSD-2-Clause", ("bsd2_spdx",), ("BSD-3-Clause",)),
    Rule("ISC", ("isc_grant",)),
    Rule("MPL-2.0", ("mpl_short",)),
    Rule("CC-BY-4.0", ("cc_by",)),
    Rule("CC-BY-SA-4.0", ("cc_by_sa",)),
    Rule("CC-BY-NC-4.0", ("cc_by_nc",)),
    Rule("CC0-1.0", ("cc0",)),
    Rule("Unlicense", ("unlicense",)),
    Rule("proprietary", ("reserved",), (
        "MIT", "Apache-2.0", "GPL-3.0-or-later", "GPL-2.0-or-later", "LGPL-3.0-or-later", "LGPL-2.1-or-later", "GPL-3.0", "BSD-3-Clause", "BSD-2-Clause",
        "ISC", "MPL-2.0",
        "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense",
    )),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A sentence ends at a full stop, colon and the like before white space, or at a line break; where
# lines are only wrapped, at an empty line.
LINE_ENDS = r"[.;:!?]+(\s|$)|\n"
WRAPPED_ENDS = r"[.;:!?]+(\s|$)|\n\s*\n"
# Slots, filled before sentences are cut: (pattern on lower-cased text, its replacement). A holder's name has up to
# 200 characters, full stops included; an SPDX line is a sentence of its own.
SLOTS = (
    (r"neither the name of [^;:]{1,200}?[ \t\r\n]+nor the names of (its|their)[ \t\r\n]+contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"spdx-license-identifier:[ \t]*", "\n\nspdx license identifier "),
)
NOT_WORD = r"[^a-z0-9.\x{0080}-\x{10FFFF}]+"


def known_sentences() -> list[tuple[str, str]]:
    """(normal form, identifier), sorted."""
    return sorted((text, key) for key, texts in SENTENCES.items() for text in texts)


def normal_form(sentence: Column) -> Column:
    """Lower case, words and dots only, single spaces."""
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), NOT_WORD, " "))


def identifiers(text: Column, ends: str) -> Column:
    """Identifiers of the known sentences of ``text``, in order."""
    known = known_sentences()
    texts, keys = F.array(*(F.lit(t) for t, _ in known)), F.array(*(F.lit(k) for _, k in known))
    filled = F.translate(text, UPPER, LOWER)
    for pattern, instead in SLOTS:
        filled = F.regexp_replace(filled, pattern, instead)
    sentences = F.transform(F.split(filled, ends), normal_form)
    found = F.filter(sentences, lambda s: s.isin([t for t, _ in known]))
    return F.transform(found, lambda s: F.element_at(keys, F.array_position(texts, s).cast("int")))


def in_order(sequence: Column, sentences: tuple[str, ...]) -> Column:
    """The identifiers occur in ``sequence`` (each between spaces) one after the other."""
    return sequence.like("%" + "".join(f" {s} %" for s in sentences).replace("_", "\\_"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, sentence_ids, licences)``, one row per input row.

    Names of holders are brought into one form and SPDX lines made sentences of their own (``SLOTS``), then
    whole texts are cut into sentences, each is brought into its normal form and mapped to the
    identifier of the known sentence it equals; the identifier sequence is matched against the
    ordered rules. Texts are cut twice, once with line breaks as ends and once taking lines as
    wrapped, so a licence text is known in both layouts. ``licences`` lists the names found, in
    rule order, each once. It is one map over the rows: nothing is shuffled or joined.

    Defined cases: null and empty texts, and texts without a known sentence, have empty arrays;
    rows come back as often as they went in; an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), identifiers(text, LINE_ENDS).alias("by_line"), identifiers(text, WRAPPED_ENDS).alias("wrapped")
    )

    def licences(by_line: Column, wrapped: Column) -> Column:
        # an identifier is matched with a space on either side of it
        sequences = [F.concat(F.lit("  "), F.array_join(ids, "  "), F.lit("  ")) for ids in (by_line, wrapped)]
        flags, names = [], list(dict.fromkeys(r.licence for r in rules))
        for name in names:
            hits = [in_order(s, r.sentences) for r in rules if r.licence == name for s in sequences]
            flags.append(F.when(any_of(hits), F.lit(name)))
        plain = F.filter(F.array(*flags), lambda x: x.isNotNull())
        hidden = {name: {u for r in rules if r.licence == name for u in r.unless} for name in names}
        return F.filter(plain, lambda x: ~any_of([
            (x == name) & F.arrays_overlap(plain, F.array(*map(F.lit, sorted(more)))) for name, more in hidden.items() if more
        ] or [F.lit(False)]))

    empty = F.array().cast("array<string>")
    known = F.size("by_line") + F.size("wrapped") > 0
    return rows.select(
        "doc_id",
        F.when(F.size("by_line") >= F.size("wrapped"), F.col("by_line")).otherwise(F.col("wrapped")).alias("sentence_ids"),
        F.when(known, licences(F.col("by_line"), F.col("wrapped"))).otherwise(empty).alias("licences"),
    )


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(source: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """The scan of ``source`` as DuckDB text, made from the same fixed values."""
    known = known_sentences()
    texts = "[" + ", ".join(quoted(t) for t, _ in known) + "]"
    keys = "[" + ", ".join(quoted(k) for _, k in known) + "]"

    def ids(ends: str) -> str:
        low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
        for pattern, instead in SLOTS:
            low = f"regexp_replace({low}, {quoted(pattern)}, {quoted(instead)}, 'g')"
        cut = f"string_split_regex({low}, {quoted(ends)})"
        normal = f"list_transform({cut}, lambda s: trim(regexp_replace(s, {quoted(NOT_WORD)}, ' ', 'g')))"
        return f"list_transform(list_filter({normal}, lambda s: list_contains({texts}, s)), lambda s: {keys}[list_position({texts}, s)])"

    def hit(name: str) -> str:
        likes = []
        for r in rules:
            if r.licence == name:
                want = "%" + "".join(f" {s} %" for s in r.sentences).replace("_", "\\_")
                likes += [f"'  ' || array_to_string({c}, '  ') || '  ' LIKE {quoted(want)} ESCAPE '\\'" for c in ("by_line", "wrapped")]
        return f"CASE WHEN {' OR '.join(likes)} THEN {quoted(name)} END"

    names = list(dict.fromkeys(r.licence for r in rules))
    hidden = [
        f"(x = {quoted(n)} AND list_has_any(plain, [{', '.join(quoted(u) for u in sorted(more))}]))"
        for n in names if (more := {u for r in rules if r.licence == n for u in r.unless})
    ]
    return f"""
    WITH mapped AS (SELECT doc_id, {ids(LINE_ENDS)} AS by_line, {ids(WRAPPED_ENDS)} AS wrapped FROM {source}),
    found AS (SELECT *, list_filter([{', '.join(map(hit, names))}], lambda x: x IS NOT NULL) AS plain FROM mapped)
    SELECT doc_id, CASE WHEN len(by_line) >= len(wrapped) THEN by_line ELSE wrapped END AS sentence_ids,
           list_filter(plain, lambda x: NOT ({' OR '.join(hidden) or 'false'})) AS licences
    FROM found
    """
