"""Licence recognition: known sentences in order.

A text is cut into sentences; each is normalised (lower case, runs of other characters than a-z and
0-9 as one space) and looked up among the known licence sentences. The text so becomes a sequence of
identifiers, with a dot for every sentence that is not known. Ordered rules, longest first, are then
matched against that sequence; at most ``GAP`` unknown sentences may stand between two of a rule.

A sentence ends at ``.``, ``!``, ``?``, ``:`` or ``;`` before white space, or at a line that is empty but for the signs
with which comments begin. If one that is not known holds line breaks, its single lines are looked up in its place.

Defined cases: null and empty texts have no licences; repeated rows give repeated rows; other columns
pass through, but one that has the name of a result is replaced by it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.batches import making_room

GAP = 10

# fixed values: licence sentences as normalised text, cut where sentences end
SENTENCES = {
    "spdx license identifier": "spdx",
    "mit": "id-mit",
    "apache 2 0": "id-apache",
    "gpl 2 0 only": "id-gpl2",
    "gpl 2 0 or later": "id-gpl2-later",
    "gpl 3 0 only": "id-gpl3",
    "gpl 3 0 or later": "id-gpl3-later",
    "lgpl 2 1 or later": "id-lgpl21-later",
    "lgpl 3 0 or later": "id-lgpl3-later",
    "agpl 3 0 or later": "id-agpl3-later",
    "mpl 2 0": "id-mpl",
    "isc": "id-isc",
    "unlicense": "id-unlicense",
    "bsd 2 clause": "id-bsd2",
    "bsd 3 clause": "id-bsd3",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "the mit license mit": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all "
    "implied warranties of merchantability and fitness": "isc-warranty",
    "licensed under the apache license version 2 0": "apache-ref",
    "licensed under the apache license version 2 0 the license": "apache-head",
    "you may not use this file except in compliance with the license": "apache-use",
    "http www apache org licenses license 2 0": "apache-url",
    "https www apache org licenses license 2 0": "apache-url",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
    "on an as is basis without warranties or conditions of any kind either express or implied": "apache-law",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "this program is free software": "gnu-program",
    "this library is free software": "gnu-library",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
    "software foundation": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by "
    "the free software foundation": "gpl2-only",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the "
    "free software foundation": "lgpl-terms",
    "either version 2 of the license or at your option any later version": "gnu-v2-later",
    "either version 2 1 of the license or at your option any later version": "gnu-v21-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
    "software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the "
    "free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the "
    "free software foundation either version 3 of the license or at your option any later version": "agpl3-grant",
    "this program is distributed in the hope that it will be useful but without any warranty": "gnu-hope",
    "this library is distributed in the hope that it will be useful but without any warranty": "gnu-hope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-warranty",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-copy",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a "
    "compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "licensed under cc by nc 4 0": "cc-by-nc-ref",
    "licensed under cc by 4 0": "cc-by-ref",
    "licensed under cc by sa 4 0": "cc-by-sa-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission": "bsd-name",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties "
    "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
    "disclaimed": "bsd-warranty",
}

# fixed values: rules as sequences of identifiers
RULES = {
    ("mit-title", "mit-grant", "mit-notice", "mit-warranty"): "MIT",
    ("mit-grant", "mit-notice", "mit-warranty"): "MIT",
    ("mit-ref",): "MIT",
    ("spdx", "id-mit"): "MIT",
    ("isc-grant", "isc-warranty"): "ISC",
    ("spdx", "id-isc"): "ISC",
    ("apache-head", "apache-use", "apache-url", "apache-law", "apache-see"): "Apache-2.0",
    ("apache-head", "apache-use"): "Apache-2.0",
    ("apache-ref",): "Apache-2.0",
    ("spdx", "id-apache"): "Apache-2.0",
    ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty"): "BSD-3-Clause",
    ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"): "BSD-2-Clause",
    ("spdx", "id-bsd2"): "BSD-2-Clause",
    ("spdx", "id-bsd3"): "BSD-3-Clause",
    ("gnu-program", "gpl3-grant", "gnu-hope", "gnu-warranty"): "GPL-3.0-or-later",
    ("gpl3-grant",): "GPL-3.0-or-later",
    ("gpl3-ref",): "GPL-3.0-only",
    ("spdx", "id-gpl3"): "GPL-3.0-only",
    ("spdx", "id-gpl3-later"): "GPL-3.0-or-later",
    ("gnu-program", "gpl-terms", "gnu-v2-later", "gnu-hope", "gnu-warranty"): "GPL-2.0-or-later",
    ("gpl-terms", "gnu-v2-later"): "GPL-2.0-or-later",
    ("gnu-program", "gpl2-only", "gnu-hope", "gnu-warranty"): "GPL-2.0-only",
    ("gpl2-only",): "GPL-2.0-only",
    ("spdx", "id-gpl2"): "GPL-2.0-only",
    ("spdx", "id-gpl2-later"): "GPL-2.0-or-later",
    ("gnu-library", "lgpl-terms", "gnu-v21-later", "gnu-hope", "gnu-warranty"): "LGPL-2.1-or-later",
    ("lgpl-terms", "gnu-v21-later"): "LGPL-2.1-or-later",
    ("gnu-program", "lgpl3-grant", "gnu-hope", "gnu-warranty"): "LGPL-3.0-or-later",
    ("lgpl3-grant",): "LGPL-3.0-or-later",
    ("spdx", "id-lgpl21-later"): "LGPL-2.1-or-later",
    ("spdx", "id-lgpl3-later"): "LGPL-3.0-or-later",
    ("gnu-program", "agpl3-grant", "gnu-hope", "gnu-warranty"): "AGPL-3.0-or-later",
    ("agpl3-grant",): "AGPL-3.0-or-later",
    ("spdx", "id-agpl3-later"): "AGPL-3.0-or-later",
    ("mpl-terms", "mpl-copy"): "MPL-2.0",
    ("spdx", "id-mpl"): "MPL-2.0",
    ("unlicense-domain", "unlicense-free"): "Unlicense",
    ("spdx", "id-unlicense"): "Unlicense",
    ("cc-by-nc-ref",): "CC-BY-NC-4.0",
    ("cc-by-sa-ref",): "CC-BY-SA-4.0",
    ("cc-by-ref",): "CC-BY-4.0",
}
# end of fixed values

# Texts without any of these hold no known licence; names after an SPDX mark count only beside it.
MARKS = r"(?i)licen[sc]e|warrant|permission|redistribut|free software|mozilla|public domain"

SENTENCE_END = r"[.!?:;]+[ \t\r\n]+|\n[ \t\r]*(?:#+|//+|/?\*+/?|--+|%+)?[ \t\r]*\n"
RULE = "|".join(
    rf"\.{{0,{GAP}}}".join(f"<{x}>" for x in rule) for rule in sorted(RULES, key=len, reverse=True)
)
NAMES = {"".join(f"<{x}>" for x in rule): name for rule, name in RULES.items()}


def _lookup(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def identifiers(text: Column) -> Column:
    """The sequence of the text: ``<id>`` per known sentence and ``.`` per other one."""
    known = _lookup({sentence: f"<{name}>" for sentence, name in SENTENCES.items()})
    plain = lambda p: F.trim(F.regexp_replace(F.lower(p), "[^a-z0-9]+", " "))
    found = lambda p: F.try_element_at(known, plain(p))
    lines = lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n"), found), lambda x: x.isNotNull()), "")
    return F.array_join(
        F.transform(
            F.split(text, SENTENCE_END),
            lambda p: F.coalesce(
                found(p), F.when(F.contains(p, F.lit("\n")), F.nullif(lines(p), F.lit(""))), F.lit(".")
            ),
        ),
        "",
    )


def find_licences(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``sentence_ids`` and ``licences`` (arrays of string, in the order of the text)."""
    df = making_room(df, ["sentence_ids", "licences", "_sequence"], [text])
    sequence = F.when(F.rlike(F.col(text), F.lit(MARKS)), identifiers(F.col(text))).otherwise("")
    names = _lookup(NAMES)
    return (
        df.withColumn("_sequence", F.coalesce(sequence, F.lit("")))
        .withColumns(
            {
                "sentence_ids": F.regexp_extract_all("_sequence", F.lit("<([^>]+)>"), F.lit(1)),
                "licences": F.transform(
                    F.regexp_extract_all("_sequence", F.lit(f"({RULE})"), F.lit(1)),
                    lambda m: F.element_at(names, F.replace(m, F.lit("."))),
                ),
            }
        )
        .drop("_sequence")
    )
