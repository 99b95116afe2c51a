"""Licences in texts: Dice coefficient of word bigrams against templates.

Built-in functions only, within the row: no shuffle and no join. Templates are
statements, file headers and whole licence texts. A template of ``n`` words is compared
with every window of ``n`` words of a text that begins with one of its bigrams, across
lines and sentences; so a wrapped header and a statement within a sentence are found as
they are. A Dice coefficient of ``t`` between bigram sets of sizes ``a`` and ``b`` needs
``b * t / (2 - t) <= a <= b * (2 - t) / t``: a template is dropped for a text that holds
fewer of its bigrams than that, which leaves few to slide. SPDX tags name their licence.
"""

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

THRESHOLD = 0.8
_NO_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE"
    " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR"
    " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,"
    " ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
    " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"
    " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
    " Software is furnished to do so, subject to the following conditions:"
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
    " conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the"
    " following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions"
    " and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License"
    " as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
_GNU_2 = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} General Public License"
    " as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
)
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."
#: Statements, headers and texts (fixed values: the published wording) by the SPDX name of their licence.
TEMPLATES = {
    "0bsd": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
        " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"
    ],
    "agpl-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _GNU.format("Affero", 3)],
    "all-rights-reserved": ["All rights reserved."],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable"
        " law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT"
        " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
        " permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND"
        " DISTRIBUTION",
    ],
    "bsd-2-clause": ["Released under the BSD 2-Clause License.", _BSD_GRANT],
    "bsd-3-clause": ["Released under the BSD 3-Clause License.", f"{_BSD_GRANT} {_BSD_NAMES}"],
    "bsl-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and"
        " accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and"
        " transmit the Software, and to prepare derivative works of the Software",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", _CC.format("Attribution")],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", _CC.format("Attribution-NonCommercial")],
    "cc-by-nc-nd-4.0": ["Licensed under CC BY-NC-ND 4.0.", _CC.format("Attribution-NonCommercial-NoDerivatives")],
    "cc-by-nc-sa-4.0": ["Licensed under CC BY-NC-SA 4.0.", _CC.format("Attribution-NonCommercial-ShareAlike")],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", _CC.format("Attribution-ShareAlike")],
    "cc0-1.0": [
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is"
        " available at https://www.eclipse.org/legal/epl-2.0/"
    ],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", _GNU_2.format("", 2)],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        _GNU.format("", 3),
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Everyone is permitted to copy and distribute verbatim copies of this"
        " license document, but changing it is not allowed.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "lgpl-2.1": [_GNU_2.format("Lesser", "2.1")],
    "lgpl-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", _GNU.format("Lesser", 3)],
    "mit": [
        "Released under the MIT License.",
        _MIT_GRANT,
        f"{_MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        f" of the Software. {_NO_WARRANTY}",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,"
        " compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,"
        " commercial or non-commercial, and by any means."
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for"
        " any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,"
        " including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ],
}
#: Fixed value: the tag by which a file names its licence, alone or in an expression.
SPDX = r"(?i)SPDX-License-Identifier:[ \t(]*([A-Za-z0-9.+-]+(?:[ \t()]+(?:AND|OR|WITH)[ \t()]+[A-Za-z0-9.+-]+)*)"
SPDX_JOINT = r"[ \t()]+(and|or|with)[ \t()]+"


def _words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def _bigrams(text: str) -> list[str]:
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes of a set that can reach the threshold with a set of ``n``."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def _listed(templates: Mapping[str, Sequence[str]], threshold: float) -> list[tuple[str, int, int, list[str]]]:
    """Name, least bigrams, bigrams of a window, and bigrams of each template."""
    out = []
    for name, texts in sorted(templates.items()):
        for text in texts:
            grams = _bigrams(text)
            if not grams:
                raise ValueError(f"a template of {name} has fewer than two words")
            out.append((name, size_bounds(len(grams), threshold)[0], len(_words(text)) - 1, grams))
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(texts: Sequence[str]) -> str:
    return f"array({', '.join(map(_quoted, texts))})"


def _steps(templates: Mapping[str, Sequence[str]], threshold: float) -> list[tuple[str, str]]:
    """Successive columns (name, SQL) that end in ``matches`` and ``tags``."""
    listed = _listed(templates, threshold)
    known = ", ".join(
        f"named_struct('name', {_quoted(name)}, 'least', {least}, 'length', {length}, 'grams', {_array(grams)})"
        for name, least, length, grams in listed
    )
    everything = sorted({gram for _, _, _, grams in listed for gram in grams})
    window = "slice(grams, p + 1, t.length)"
    dice = f"2.0D * size(array_intersect({window}, t.grams)) / (size(array_distinct({window})) + size(t.grams))"
    best = f"""array_min(transform(
        filter(sequence(0, size(grams) - 1), p -> array_contains(t.grams, grams[p])),
        p -> named_struct('less', -({dice}), 'name', t.name, 'start', p, 'stop', p + t.length)))"""
    return [
        ("words", "split(trim(regexp_replace(lower(text), '[^\\\\p{L}\\\\p{N}]+', ' ')), ' ')"),
        ("grams", "if(size(words) < 2, array(), transform(sequence(0, size(words) - 2), i -> concat(words[i], ' ', words[i + 1])))"),
        ("seen", f"array_intersect(grams, {_array(everything)})"),
        ("near", f"filter(array({known}), t -> size(seen) >= t.least AND size(array_intersect(seen, t.grams)) >= t.least)"),
        ("found", f"filter(transform(near, t -> {best}), m -> -m.less >= {threshold!r}D)"),
        # Of licences that overlap in a text, the better one counts.
        (
            "matches",
            """filter(found, x -> NOT exists(found, y ->
                y.name <> x.name AND y.start < x.stop AND x.start < y.stop AND y.less < x.less))""",
        ),
        (
            "tags",
            f"""array_distinct(flatten(transform(regexp_extract_all(text, {_quoted(SPDX)}, 1),
                e -> split(regexp_replace(lower(e), '[.]+$', ''), {_quoted(SPDX_JOINT)}))))""",
        ),
    ]


def scan_licenses(docs: DataFrame, templates: Mapping[str, Sequence[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: ``doc_id``, ``license``, ``dice``, ``n_matches``, ``licenses``.

    Texts are lower-cased and cut into runs of letters and digits. A template matches by
    its best window (ties: the first), unless a window of another licence that overlaps it
    has a greater coefficient. SPDX tags count as matches of coefficient 1, by the names
    they state, known or not. ``license`` is the name of the best coefficient (ties: the
    least name), null without a match; ``n_matches`` counts templates and tags,
    ``licenses`` are their names in order. Null and empty texts match nothing.
    """
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for name, sql in _steps(templates or TEMPLATES, threshold):
        out = out.withColumn(name, F.expr(sql))
    named = "transform(matches, m -> named_struct('less', m.less, 'name', m.name))"
    tagged = "transform(tags, t -> named_struct('less', -1.0D, 'name', t))"
    best = F.expr(f"array_min(concat({named}, {tagged}))")
    return out.select("doc_id", "matches", "tags", best.alias("best")).select(
        "doc_id",
        F.col("best.name").alias("license"),
        (-F.col("best.less")).alias("dice"),
        (F.size("matches") + F.size("tags")).cast("long").alias("n_matches"),
        F.array_sort(F.array_distinct(F.concat(F.col("matches.name"), F.col("tags")))).alias("licenses"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("licenses", F.concat_ws(",", "licenses"))


def op8_sql() -> str:
    values = ", ".join(
        f"({number}, '{name}', {least}, {length}, [{', '.join(chr(39) + g + chr(39) for g in grams)}])"
        for number, (name, least, length, grams) in enumerate(_listed(TEMPLATES, THRESHOLD))
    )
    return rf"""
WITH templates(number, name, least, length, known) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT rid, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM docs
), grams AS (
  SELECT rid, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] AS g FROM words WHERE len(w) > 1
), near AS (
  SELECT * FROM grams, templates WHERE len(list_intersect(g, known)) >= least
), windows AS (
  SELECT *, list_distinct(g[p : p + length - 1]) AS part
  FROM (SELECT *, unnest(range(1, len(g) + 1)) AS p FROM near) WHERE list_contains(known, g[p])
), scored AS (
  SELECT rid, number, name, p, p + length AS stop, 2.0::DOUBLE * len(list_intersect(part, known)) / (len(part) + len(known)) AS dice
  FROM windows
), found AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY rid, number ORDER BY dice DESC, p) = 1 AND dice >= {THRESHOLD}
), matched AS (
  SELECT rid, name, dice FROM found x WHERE NOT EXISTS (
    SELECT 1 FROM found y WHERE y.rid = x.rid AND y.name <> x.name AND y.p < x.stop AND x.p < y.stop AND y.dice > x.dice)
  UNION ALL
  SELECT rid, unnest(list_distinct(flatten([string_split_regex(regexp_replace(lower(e), '[.]+$', ''), '{SPDX_JOINT.replace('(and|or|with)', '(?:and|or|with)')}')
    for e in regexp_extract_all(text, '{SPDX}', 1)]))), 1.0::DOUBLE FROM docs
), best AS (
  SELECT rid, arg_min(name, (-dice, name)) AS license, max(dice) AS dice, count(*) AS n_matches,
    array_to_string(list_sort(list(DISTINCT name)), ',') AS licenses
  FROM matched GROUP BY rid
)
SELECT doc_id, license, dice, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses
FROM docs LEFT JOIN best USING (rid)
"""
