"""Licence scan by recognising sentences, then sequences of sentences.

A text is cut into sentences, each is normalised and looked up among known licence
sentences; what is left is a short sequence of identifiers, which ordered rules turn into licence names.
All of it is column expressions over one row: nothing is shuffled and no Python runs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import column

# Wording of public licences and of common licence notices.
SENTENCES = {
    "mit-ref": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as-is-software": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "apache-ref": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "This work is licensed under the Apache License, Version 2.0", "Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "apache-grant": ["Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache-comply": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-ref": ["Released under the BSD License", "Licensed under the BSD License", "SPDX-License-Identifier: BSD-3-Clause"],
    "bsd2-ref": ["SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License", "BSD 2-Clause License"],
    "gpl3-ref": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl-grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl3-later-ref": ["SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GNU General Public License, version 3 or later"],
    "gpl2-ref": ["SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0", "Licensed under the GNU General Public License, version 2", "Released under the GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 2"],
    "gpl2-later-ref": ["SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under the GNU General Public License, version 2 or later"],
    "gpl2-grant": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "free-program": ["This program is free software"],
    "gpl2-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "gpl2-version": ["either version 2 of the License, or (at your option) any later version"],
    "lgpl3-ref": ["SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later", "Licensed under the GNU Lesser General Public License, version 3", "Released under the GNU Lesser General Public License, version 3"],
    "lgpl2-ref": ["SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later", "Licensed under the GNU Lesser General Public License, version 2.1", "Released under the GNU Lesser General Public License, version 2.1"],
    "free-library": ["This library is free software"],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "lgpl2-version": ["either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3-version": ["either version 3 of the License, or (at your option) any later version"],
    "agpl-ref": ["SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later", "Licensed under the GNU Affero General Public License, version 3", "Released under the GNU Affero General Public License, version 3"],
    "agpl-grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "mpl-ref": ["SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0", "Licensed under the Mozilla Public License, version 2.0", "Mozilla Public License Version 2.0"],
    "mpl-subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "epl-ref": ["SPDX-License-Identifier: EPL-2.0", "Licensed under the Eclipse Public License 2.0", "Eclipse Public License - v 2.0"],
    "epl-grant": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution"],
    "cc0-ref": ["SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal", "Licensed under CC0 1.0", "This work is licensed under CC0 1.0"],
    "cc0-grant": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
    "unlicense-ref": ["SPDX-License-Identifier: Unlicense", "Released under the Unlicense"],
    "unlicense-grant": ["This is free and unencumbered software released into the public domain"],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "zlib-ref": ["SPDX-License-Identifier: Zlib", "Licensed under the zlib License"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "boost-ref": ["SPDX-License-Identifier: BSL-1.0", "Distributed under the Boost Software License, Version 1.0", "Boost Software License - Version 1.0"],
    "isc-ref": ["SPDX-License-Identifier: ISC", "ISC License", "Licensed under the ISC License"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "cc-by-ref": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-ref": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0"],
    "cc-by-nc-ref": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
}

# The first rule that fits at a position names the licence, so longer rules stand first.
RULES = [
    ("mit", ["mit-grant", "mit-notice", "as-is-software"]),
    ("mit", ["mit-grant", "mit-notice"]),
    ("mit-incomplete", ["mit-grant"]),
    ("apache-2.0", ["apache-grant", "apache-comply", "apache-copy", "apache-as-is"]),
    ("apache-2.0", ["apache-grant", "apache-comply"]),
    ("apache-2.0", ["apache-grant"]),
    ("bsd-3-clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("bsd-2-clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("gpl-3.0-or-later", ["gpl-grant", "gpl-warranty"]),
    ("gpl-3.0-or-later", ["gpl-grant"]),
    ("agpl-3.0-or-later", ["agpl-grant"]),
    ("gpl-2.0-or-later", ["free-program", "gpl2-terms", "gpl2-version"]),
    ("gpl-2.0-or-later", ["gpl2-grant"]),
    ("lgpl-2.1-or-later", ["free-library", "lgpl-terms", "lgpl2-version"]),
    ("lgpl-3.0-or-later", ["free-library", "lgpl-terms", "lgpl3-version"]),
    ("mpl-2.0", ["mpl-subject", "mpl-copy"]),
    ("mpl-2.0", ["mpl-subject"]),
    ("epl-2.0", ["epl-grant"]),
    ("cc0-1.0", ["cc0-grant"]),
    ("unlicense", ["unlicense-grant", "unlicense-anyone"]),
    ("unlicense", ["unlicense-grant"]),
    ("zlib", ["zlib-as-is", "zlib-grant"]),
    ("isc", ["isc-grant"]),
    ("mit", ["mit-ref"]),
    ("apache-2.0", ["apache-ref"]),
    ("bsd", ["bsd-ref"]),
    ("bsd-2-clause", ["bsd2-ref"]),
    ("isc", ["isc-ref"]),
    ("gpl-3.0", ["gpl3-ref"]),
    ("gpl-3.0-or-later", ["gpl3-later-ref"]),
    ("gpl-2.0", ["gpl2-ref"]),
    ("gpl-2.0-or-later", ["gpl2-later-ref"]),
    ("lgpl-3.0", ["lgpl3-ref"]),
    ("lgpl-2.1", ["lgpl2-ref"]),
    ("agpl-3.0", ["agpl-ref"]),
    ("mpl-2.0", ["mpl-ref"]),
    ("epl-2.0", ["epl-ref"]),
    ("cc0-1.0", ["cc0-ref"]),
    ("unlicense", ["unlicense-ref"]),
    ("zlib", ["zlib-ref"]),
    ("bsl-1.0", ["boost-ref"]),
    ("cc-by-4.0", ["cc-by-ref"]),
    ("cc-by-sa-4.0", ["cc-by-sa-ref"]),
    ("cc-by-nc-4.0", ["cc-by-nc-ref"]),
]

# Sentences end at a closing mark before white space, at a colon that ends a line, or at an empty line.
SENTENCE_END = r"(?:[.!?;][\x20\x09-\x0D]+)|(?::[\x20\x09\x0D]*\n)|(?:\n[\x20\x09\x0B-\x0D]*\n)"
NOT_PLAIN = "[^a-z0-9]+"


def _plain(text: str) -> str:
    return re.sub(NOT_PLAIN, " ", text.lower()).strip()


def known_sentences() -> dict[str, str]:
    """Normalised wording -> identifier."""
    return {_plain(s): k for k, wordings in SENTENCES.items() for s in wordings}


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), NOT_PLAIN, " "))


def _lookup(known: Column, sentence: Column) -> Column:
    return F.element_at(known, _normal(sentence))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order.

    A sentence may run over lines; where the whole is unknown its lines are tried one by one, so
    that a notice on a line of its own counts even if the line before has no full stop.
    """
    known = F.create_map(*[F.lit(x) for pair in known_sentences().items() for x in pair])

    def of(sentence: Column) -> Column:
        whole = _lookup(known, sentence)
        lines = F.transform(F.split(sentence, "\n"), lambda line: _lookup(known, line))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.filter(lines, lambda x: x.isNotNull()))

    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), of))


def matched_rules(ids: Column) -> Column:
    """Licence name for every position at which a rule begins, in order."""
    name = F.lit(None).cast("string")

    def at(_: Column, k: Column) -> Column:
        out = name
        for licence, sequence in reversed(RULES):
            here = F.slice(ids, k + 1, len(sequence)) == F.array(*[F.lit(s) for s in sequence])
            out = F.when(here, F.lit(licence)).otherwise(out)
        return out

    return F.filter(F.transform(ids, at), lambda x: x.isNotNull())


def scan_licenses(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, number of known sentences, rule matches, and the licences found.

    ``licenses`` lists distinct names in alphabetical order, joined by a comma; it is empty where none was
    found, as for null and empty texts.  A licence stated twice counts as two matches.
    Null ids pass through, repeated rows are scanned each, other columns are left out.
    """
    found = df.select(column(id).alias("doc_id"), sentence_ids(column(text)).alias("ids"))
    named = found.withColumn("names", matched_rules(F.col("ids")))
    return named.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.size("names").cast("long").alias("n_matches"),
        F.concat_ws(",", F.array_sort(F.array_distinct("names"))).alias("licenses"),
    )


def oracle(table: str = "documents") -> str:
    """The same scan in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = known_sentences()
    lookup = f"map([{', '.join(map(quote, known))}], [{', '.join(map(quote, known.values()))}])"
    plain = f"trim(regexp_replace(lower({{}}), '{NOT_PLAIN}', ' ', 'g'))"
    whole, line = plain.format("s"), plain.format("l")
    rules = " ".join(
        f"WHEN list_slice(ids, k, k + {len(seq) - 1}) = [{', '.join(map(quote, seq))}] THEN {quote(name)}" for name, seq in RULES
    )
    end = SENTENCE_END.replace("'", "''")
    return f"""
    WITH sentences AS (SELECT doc_id, rowid_, unnest(string_split_regex(coalesce(text, ''), '{end}')) AS s,
            generate_subscripts(string_split_regex(coalesce(text, ''), '{end}'), 1) AS p
        FROM (SELECT doc_id, text, row_number() OVER () AS rowid_ FROM {table}) d),
    lookup AS (SELECT {lookup} AS m),
    named AS (SELECT doc_id, rowid_, p, CASE WHEN m[{whole}] IS NOT NULL THEN [m[{whole}]]
        ELSE [x for x in [m[{line}] for l in string_split(s, chr(10))] if x IS NOT NULL] END AS a FROM sentences, lookup),
    seqs AS (SELECT doc_id, rowid_, flatten(list(a ORDER BY p)) AS ids FROM named GROUP BY doc_id, rowid_),
    hits AS (SELECT doc_id, ids, [x for x in [CASE {rules} END for k in range(1, len(ids) + 1)] if x IS NOT NULL] AS names FROM seqs)
    SELECT doc_id, len(ids) AS n_sentences, len(names) AS n_matches,
        array_to_string(list_sort(list_distinct(names)), ',') AS licenses FROM hits"""
