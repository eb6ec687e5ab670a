"""Operator 9 over ``documents``.

The SQL has tables of its own: the sentences as the notices write them, which it brings to normal form itself, and the
sequences of the notices. So it finds an entry of the operator's table that no notice can reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.licences import find_licences
from affinis.llm.registry import query, table

# fixed values: what the notices say, one sentence after the other
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation"
_LATER = "either version {} of the License, or (at your option) any later version"
_ISC = "Permission to use, copy, modify, and{} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
NOTICES = [
    ("spdx", "SPDX-License-Identifier:"),
    *((f"id-{short}", name) for short, name in (
        ("mit", "MIT"), ("apache", "Apache-2.0"), ("gpl2", "GPL-2.0-only"), ("gpl2-later", "GPL-2.0-or-later"), ("gpl3", "GPL-3.0-only"),
        ("gpl3-later", "GPL-3.0-or-later"), ("lgpl21-later", "LGPL-2.1-or-later"), ("lgpl3-later", "LGPL-3.0-or-later"),
        ("agpl3-later", "AGPL-3.0-or-later"), ("mpl", "MPL-2.0"), ("isc", "ISC"), ("unlicense", "Unlicense"),
        ("bsd2", "BSD-2-Clause"), ("bsd3", "BSD-3-Clause"))),
    ("mit-ref", "Released under the MIT License."), ("mit-ref", "Licensed under the MIT License."),
    ("mit-ref", "This project is licensed under the MIT License."),
    ("mit-title", "MIT License"), ("mit-title", "The MIT License"), ("mit-title", "The MIT License (MIT)"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-warranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("isc-grant", _ISC.format("/or")), ("isc-grant", _ISC.format("")),
    ("isc-warranty", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("apache-ref", "Licensed under the Apache License, Version 2.0."),
    ("apache-head", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("apache-use", "you may not use this file except in compliance with the License."),
    ("apache-url", "http://www.apache.org/licenses/LICENSE-2.0"), ("apache-url", "https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-law", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("gpl3-ref", "This work is licensed under the GNU General Public License version 3."),
    ("gnu-program", "This program is free software:"), ("gnu-library", "This library is free software;"),
    ("gpl-terms", _GNU.format("General Public License") + ";"), ("gpl2-only", _GNU.format("General Public License version 2") + "."),
    ("lgpl-terms", _GNU.format("Lesser General Public License") + ";"),
    ("gnu-v2-later", _LATER.format("2") + "."), ("gnu-v21-later", _LATER.format("2.1") + "."),
    ("gpl3-grant", _GNU.format("General Public License") + ", " + _LATER.format("3") + "."),
    ("lgpl3-grant", _GNU.format("Lesser General Public License") + ", " + _LATER.format("3") + "."),
    ("agpl3-grant", _GNU.format("Affero General Public License") + ", " + _LATER.format("3") + "."),
    ("gnu-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("gnu-hope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("gnu-warranty", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("mpl-terms", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense-domain", "This is free and unencumbered software released into the public domain."),
    ("unlicense-free", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-nc-ref", "Licensed under CC BY-NC 4.0."), ("cc-by-ref", "Licensed under CC BY 4.0."), ("cc-by-sa-ref", "Licensed under CC BY-SA 4.0."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-name", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-warranty", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
]
SEQUENCES = """
apache-head apache-use apache-url apache-law apache-see = Apache-2.0
bsd-grant bsd-source bsd-binary bsd-name bsd-warranty = BSD-3-Clause
gnu-program gpl-terms gnu-v2-later gnu-hope gnu-warranty = GPL-2.0-or-later
gnu-library lgpl-terms gnu-v21-later gnu-hope gnu-warranty = LGPL-2.1-or-later
mit-title mit-grant mit-notice mit-warranty = MIT
bsd-grant bsd-source bsd-binary bsd-warranty = BSD-2-Clause
gnu-program gpl3-grant gnu-hope gnu-warranty = GPL-3.0-or-later
gnu-program gpl2-only gnu-hope gnu-warranty = GPL-2.0-only
gnu-program lgpl3-grant gnu-hope gnu-warranty = LGPL-3.0-or-later
gnu-program agpl3-grant gnu-hope gnu-warranty = AGPL-3.0-or-later
mit-grant mit-notice mit-warranty = MIT
isc-grant isc-warranty = ISC
apache-head apache-use = Apache-2.0
gpl-terms gnu-v2-later = GPL-2.0-or-later
lgpl-terms gnu-v21-later = LGPL-2.1-or-later
mpl-terms mpl-copy = MPL-2.0
unlicense-domain unlicense-free = Unlicense
spdx id-mit = MIT
spdx id-isc = ISC
spdx id-apache = Apache-2.0
spdx id-bsd2 = BSD-2-Clause
spdx id-bsd3 = BSD-3-Clause
spdx id-gpl2 = GPL-2.0-only
spdx id-gpl2-later = GPL-2.0-or-later
spdx id-gpl3 = GPL-3.0-only
spdx id-gpl3-later = GPL-3.0-or-later
spdx id-lgpl21-later = LGPL-2.1-or-later
spdx id-lgpl3-later = LGPL-3.0-or-later
spdx id-agpl3-later = AGPL-3.0-or-later
spdx id-mpl = MPL-2.0
spdx id-unlicense = Unlicense
gpl3-grant = GPL-3.0-or-later
gpl3-ref = GPL-3.0-only
gpl2-only = GPL-2.0-only
lgpl3-grant = LGPL-3.0-or-later
agpl3-grant = AGPL-3.0-or-later
apache-ref = Apache-2.0
mit-ref = MIT
cc-by-nc-ref = CC-BY-NC-4.0
cc-by-sa-ref = CC-BY-SA-4.0
cc-by-ref = CC-BY-4.0
"""
# end of fixed values


def _plain(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


_SAID = ", ".join("('{}', '{}')".format(name, said.replace("'", "''")) for name, said in NOTICES)
_RULES = ", ".join("({}, '{}', '{}')".format(i, *line.split(" = ")) for i, line in enumerate(SEQUENCES.strip().splitlines()))
SQL = rf"""
  WITH known AS (
    SELECT map_from_entries(list(struct_pack(k := {_plain('said')}, v := '<' || id || '>'))) AS m FROM (VALUES {_SAID}) n(id, said)),
  rules AS (
    SELECT '(' || string_agg('<' || replace(ids, ' ', '>[.]{{0,10}}<') || '>', '|' ORDER BY place) || ')' AS pattern,
           map_from_entries(list(struct_pack(k := '<' || replace(ids, ' ', '><') || '>', v := licence))) AS names
    FROM (VALUES {_RULES}) r(place, ids, licence)),
  cut AS (
    SELECT doc_id, regexp_split_to_array(
      CASE WHEN regexp_matches(text, '(?i)licen[sc]e|warrant|permission|redistribut|free software|mozilla|public domain') THEN text ELSE '' END,
      '[.!?:;]+[ \t\r\n]+|\n[ \t\r]*(#+|//+|/?\*+/?|--+|%+)?[ \t\r]*\n') AS parts
    FROM documents),
  sequences AS (
    SELECT doc_id, array_to_string(list_transform(parts, lambda p: coalesce(m[{_plain('p')}],
             CASE WHEN contains(p, chr(10)) THEN nullif(array_to_string(list_filter(list_transform(
               string_split(p, chr(10)), lambda x: m[{_plain('x')}]), lambda x: x IS NOT NULL), ''), '') END, '.')), '') AS s
    FROM cut, known)
  SELECT doc_id, CAST(len(regexp_extract_all(s, '<([^>]+)>', 1)) AS BIGINT) AS n_sentences,
    array_to_string(regexp_extract_all(s, '<([^>]+)>', 1), ',') AS sentence_ids,
    array_to_string(list_transform(regexp_extract_all(s, pattern, 1), lambda x: names[replace(x, '.', '')]), ',') AS licences
  FROM sequences, rules"""


@query("op9_licences", SQL)
def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, also of those that have none."""
    found = find_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
    )
