"""Licence recognition by sentences and ordered rules.

Texts are cut into sentences; a sentence, normalised to lower-case words, is looked up among known
licence sentences; the identifiers that a text shows, in order, are matched against the rules, longest
first, each match using up its identifiers. All of it stays in the row: no shuffle.

A sentence ends at its punctuation or at a line without letters and digits. Any other line feed may
end it or be a wrap within it: runs of lines are looked up, the longest first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm._shared import ascii_lower, stage

#: Identifier and sentence. Sentences are given in full and normalised like those of the texts.
SENTENCES = {
    "mit-short": "Released under the MIT License",
    "mit-short-2": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND",
    "apache-2-short": "Licensed under the Apache License, Version 2.0",
    "apache-2-use": "you may not use this file except in compliance with the License",
    "apache-2-copy": "You may obtain a copy of the License at",
    "gpl-3-short": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software",
    "gpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-3-or-later": "either version 3 of the License, or (at your option) any later version",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc0": "No rights reserved under the CC0 license",
    "all-rights": "All rights reserved under copyright",
}

#: Rules in order of trial: name, and the identifiers that follow one another.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("Apache-2.0", ["apache-2-short", "apache-2-use", "apache-2-copy"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-redistribute", "gpl-3-or-later"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-endorse"]),
    ("MIT", ["mit-grant"]),
    ("BSD-2-Clause", ["bsd-redistribution"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-short-2"]),
    ("Apache-2.0", ["apache-2-short"]),
    ("GPL-3.0-only", ["gpl-3-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC0-1.0", ["cc0"]),
    ("all-rights-reserved", ["all-rights"]),
]

#: Parts of words that most known sentences have.
TRIGGERS = ("licens", "permission", "permitted", "warranty", "free software", "copyright")

#: What is known by default: the sentences above, and the whole ones of the licences' own texts.
KNOWN = SENTENCES | {
    "all-rights-plain": "All rights reserved",
    "mit-grant-whole": SENTENCES["mit-grant"] + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "as-is-whole": SENTENCES["as-is"] + ", EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache-2-whole": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-2-copy-whole": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-2-or-later-whole": SENTENCES["gpl-redistribute"] + ", either version 2 of the License, or (at your option) any later version",
    "gpl-2-or-later": "either version 2 of the License, or (at your option) any later version",
    "gpl-3-or-later-whole": SENTENCES["gpl-redistribute"] + ", " + SENTENCES["gpl-3-or-later"],
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
}

_LATER = ", or (at your option) any later version"
_FSF = "as published by the Free Software Foundation"
_TERMS = "you can redistribute it and/or modify it under the terms of the GNU "
_CC = "This work is licensed under a Creative Commons "
#: More licences, each by the sentences that name it: (identifier, sentence, licence). A licence of None
#: is named by a rule of several sentences.
MORE = [
    ("lgpl-free", "This library is free software", None),
    ("lgpl-redistribute", f"{_TERMS}Lesser General Public License {_FSF}", None),
    ("lgpl-21-or-later", f"either version 2.1 of the License{_LATER}", None),
    ("lgpl-21-whole", f"{_TERMS}Lesser General Public License {_FSF}, either version 2.1 of the License{_LATER}", "LGPL-2.1-or-later"),
    ("lgpl-3-whole", f"{_TERMS}Lesser General Public License {_FSF}, either version 3 of the License{_LATER}", "LGPL-3.0-or-later"),
    ("agpl-3-whole", f"{_TERMS}Affero General Public License {_FSF}, either version 3 of the License{_LATER}", "AGPL-3.0-or-later"),
    ("gpl-2-only", f"{_TERMS}General Public License version 2 {_FSF}", "GPL-2.0-only"),
    ("gpl-3-short-2", "Licensed under the GNU General Public License v3.0", "GPL-3.0-only"),
    ("gfdl-13", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation", "GFDL-1.3-or-later"),
    ("mpl-2-form", "This Source Code Form is subject to the terms of the Mozilla Public License, v", None),
    ("mpl-2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "MPL-2.0"),
    ("mpl-2-copy-plain", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "MPL-2.0"),
    ("mpl-2-short", "Licensed under the Mozilla Public License 2.0", "MPL-2.0"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "ISC"),
    ("isc-grant-and", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "ISC"),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "0BSD"),
    ("unlicense-free", "This is free and unencumbered software released into the public domain", "Unlicense"),
    ("boost-short", "Distributed under the Boost Software License, Version 1.0", "BSL-1.0"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "Zlib"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
    ("bsd-advertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement", None),
    ("bsd-short", "Licensed under the BSD License", "BSD"),
    ("bsd-3-short", "Licensed under the BSD 3-Clause License", "BSD-3-Clause"),
    ("bsd-2-short", "Licensed under the BSD 2-Clause License", "BSD-2-Clause"),
    ("cc-by-4-work", f"{_CC}Attribution 4.0 International License", "CC-BY-4.0"),
    ("cc-by-sa-4-work", f"{_CC}Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    ("cc-by-nd-4-work", f"{_CC}Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"),
    ("cc-by-nc-4-work", f"{_CC}Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    ("cc-by-nc-sa-4-work", f"{_CC}Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-4.0"),
    ("apache-2-short-2", "Released under the Apache License 2.0", "Apache-2.0"),
]
KNOWN |= {name: text for name, text, _ in MORE}

_BSD = ["bsd-redistribution", "bsd-source", "bsd-binary"]
_MIT = [[grant, "mit-notice", as_is] for grant in ("mit-grant-whole", "mit-grant") for as_is in ("as-is-whole", "as-is")]
#: Rules over KNOWN, in order of trial. A BSD text's own "All rights reserved" is part of it.
KNOWN_RULES = [
    ("BSD-4-Clause", ["all-rights-plain", *_BSD, "bsd-advertising"]),
    ("BSD-4-Clause", [*_BSD, "bsd-advertising"]),
    ("BSD-3-Clause", ["all-rights-plain", *_BSD, "bsd-endorse"]),
    ("BSD-3-Clause", [*_BSD, "bsd-endorse"]),
    ("BSD-2-Clause", ["all-rights-plain", *_BSD]),
    ("BSD-2-Clause", _BSD),
    *[("MIT", ids) for ids in _MIT],
    *[("Apache-2.0", [short, "apache-2-use", copy]) for short in ("apache-2-whole", "apache-2-short") for copy in ("apache-2-copy-whole", "apache-2-copy")],
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl-redistribute", "lgpl-21-or-later"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl-21-whole"]),
    ("LGPL-3.0-or-later", ["gpl-free", "lgpl-3-whole"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl-3-whole"]),
    ("GPL-2.0-only", ["gpl-free", "gpl-2-only"]),
    *[("MPL-2.0", ["mpl-2-form", copy]) for copy in ("mpl-2-copy", "mpl-2-copy-plain")],
    ("GPL-3.0-or-later", ["gpl-free", "gpl-3-or-later-whole"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-2-or-later-whole"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-redistribute", "gpl-2-or-later"]),
    *[rule for rule in RULES if len(rule[1]) > 1 and rule[0] not in ("MIT", "Apache-2.0")],
    ("GPL-3.0-or-later", ["gpl-3-or-later-whole"]),
    ("GPL-2.0-or-later", ["gpl-2-or-later-whole"]),
    ("MIT", ["mit-grant-whole"]),
    ("Apache-2.0", ["apache-2-whole"]),
    *[rule for rule in RULES if len(rule[1]) == 1],
    *[(licence, [name]) for name, _, licence in MORE if licence],
    ("all-rights-reserved", ["all-rights-plain"]),
]

END = r"([.;:!?])[ \t\r]+"
#: Where no sentence goes on: white space after its punctuation, or lines without letters and digits.
_HARD = r"(?<=[.;:!?])[ \t\r\n]+|\n[^a-z0-9]*\n"


def normalise(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), sentence)).strip()


def _check(sentences: dict[str, str], rules: list[tuple[str, list[str]]]) -> None:
    for name, text in sentences.items():
        if not normalise(text) or re.search(END, text) or "," in name:
            raise ValueError(f"sentence {name} has no word, or is more than a sentence")
    if unknown := {x for _, ids in rules for x in ids} - set(sentences):
        raise ValueError(f"rules name unknown sentences: {sorted(unknown)}")


def triggers(sentences: dict[str, str]) -> list[str]:
    """Parts of words such that every sentence has one of them, so a text without them is passed over."""
    held = [t for t in TRIGGERS if " " not in t]  # a wrapped line can end within the others
    for s in map(normalise, sentences.values()):
        if not any(t in s for t in held):
            held.append(max(s.split(), key=len))
    return held


def recognise(text: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    plain = {normalise(s): name for name, s in sentences.items()}
    known = F.create_map(*[F.lit(x) for pair in plain.items() for x in pair])
    most = max(len(s.split()) for s in plain)  # every line has a word, so no run is of more lines
    held = triggers(sentences)
    low = ascii_lower(text)
    none = F.array().cast("array<string>")

    def runs(lines: Column) -> Column:
        def at(i: Column) -> Column:
            line = F.get(lines, i)
            begins = F.exists(F.array(*map(F.lit, plain)), lambda s: (s == line) | s.startswith(F.concat(line, F.lit(" "))))
            ends = F.sequence(F.least(F.lit(most), F.size(lines) - i), F.lit(1), F.lit(-1))
            tried = F.transform(ends, lambda n: F.struct(known[F.array_join(F.slice(lines, i + 1, n), " ")].alias("id"), (i + n).alias("to")))
            return F.when(begins, F.get(F.filter(tried, lambda x: x["id"].isNotNull()), F.lit(0)))

        starts = F.filter(F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.struct(i.alias("at"), at(i).alias("run"))), lambda x: x["run"].isNotNull())
        begin = F.struct(F.lit(0).alias("to"), none.alias("ids"))
        # a line within a longer run is not looked at again
        return F.aggregate(starts, begin, lambda a, x: F.when(x["at"] >= a["to"], F.struct(x["run"]["to"].alias("to"), F.array_append(a["ids"], x["run"]["id"]).alias("ids"))).otherwise(a), lambda a: a["ids"])

    may = F.filter(F.split(low, _HARD, -1), lambda s: _any(s, held))
    lines = F.transform(may, lambda s: F.filter(F.transform(F.split(s, "\n", -1), lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))), lambda x: x != ""))
    ids = F.flatten(F.transform(F.filter(lines, lambda x: F.size(x) > 0), runs))
    return F.when(_any(low, held), ids).otherwise(none)


def _any(s: Column, held: list[str]) -> Column:
    found = s.contains(held[0])
    for t in held[1:]:
        found = found | s.contains(t)
    return found


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: dict[str, str] | None = None,
    rules: list[tuple[str, list[str]]] | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_sentences (known licence sentences), sentence_ids and licenses
    (arrays: in order of the text; distinct, in order of the rules).

    A null, empty or unlicensed text has 0 and empty arrays; null ids stay null; repeated rows are
    each returned; other columns aren't read; an empty table gives no rows. A text of any length is
    scanned whole.
    """
    sentences, rules = sentences or KNOWN, rules or (RULES if sentences else KNOWN_RULES)
    _check(sentences, rules)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = stage(docs.select(F.col(id_col).alias("doc_id"), text.alias("__text")), sentence_ids=recognise(F.col("__text"), sentences))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{x}>" for x in ids)).alias("ids")) for name, ids in rules])
    chain = F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    start = F.struct(chain.alias("left"), F.array().cast("array<string>").alias("found"))
    matched = F.aggregate(
        table,
        start,
        lambda a, r: F.when(
            F.contains(a["left"], r["ids"]),
            # what a rule has used can't join its neighbours to another match
            F.struct(F.replace(a["left"], r["ids"], F.lit("|")).alias("left"), F.array_append(a["found"], r["name"]).alias("found")),
        ).otherwise(a),
        lambda a: F.array_distinct(a["found"]),
    )
    found = F.when(F.size("sentence_ids") > 0, matched).otherwise(F.array().cast("array<string>"))
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), "sentence_ids", found.alias("licenses"))
