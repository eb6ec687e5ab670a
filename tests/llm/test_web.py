import pytest
from pyspark.sql import functions as F

from affinis.llm import licences as L
from affinis.llm import revisits as R

MIT = """Some code.

MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
GRANT = "Permission is hereby granted" + MIT.split("Permission is hereby granted")[1].split("\n\nThe above")[0]


def licences(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, Licences int")
    out = L.find_licences(df)
    assert out.columns == ["doc_id", "text", "sentence_ids", "licences"]
    return [(r["sentence_ids"], r["licences"]) for r in out.orderBy("doc_id").collect()]


def test_licences(spark):
    lines = "words without end\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."
    gap = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    got = licences(spark, [MIT, lines, None, "", "no licence here", GRANT, "released### under$$$ the&&& MIT*** license", gap])
    assert got[0] == (["mit-title", "mit-grant", "mit-notice", "mit-warranty"], ["MIT"])
    assert got[1] == (["mit-ref", "cc-by-nc-ref"], ["MIT", "CC-BY-NC-4.0"])
    assert got[2] == got[3] == got[4] == ([], [])
    assert got[5] == (["mit-grant"], [])  # a rule needs all its sentences
    assert got[6] == (["mit-ref"], ["MIT"])
    assert got[7] == (["bsd-grant"], [])


def test_order_and_gap(spark):
    parts = MIT.split("\n\n")
    turned = "\n\n".join([parts[4], parts[3], parts[2]])
    near = "\n\n".join([parts[2], *["Some words."] * L.GAP, parts[3], parts[4]])
    far = "\n\n".join([parts[2], *["Some words."] * (L.GAP + 1), parts[3], parts[4]])
    assert [x[1] for x in licences(spark, [turned, near, far])] == [[], ["MIT"], []]


def test_longest_rule_first(spark):
    text = (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at\n\n"
    )
    assert licences(spark, [text])[0] == (["apache-head", "apache-use"], ["Apache-2.0"])


GNU = """This {what} is free software{sign} you can redistribute it and/or modify
it under the terms of the GNU {name}
{terms}

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name} for more details.
"""
OLD = "as published by\nthe Free Software Foundation; either version {}\nof the License, or (at your option) any later version."
NEW = "as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
LESSER, AFFERO, GENERAL = "Lesser General Public License", "Affero General Public License", "General Public License"
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
NOTICES = {
    "MIT": MIT.split("Some code.\n\n")[1],
    "ISC": """Copyright (c) 2020, Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
""",
    "Apache-2.0": """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
    "BSD-2-Clause": BSD.format(""),
    "BSD-3-Clause": BSD.format("""
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""),
    "GPL-3.0-or-later": GNU.format(what="program", sign=":", name=GENERAL, terms=NEW),
    "LGPL-3.0-or-later": GNU.format(what="program", sign=":", name=LESSER, terms=NEW),
    "AGPL-3.0-or-later": GNU.format(what="program", sign=":", name=AFFERO, terms=NEW),
    "GPL-2.0-or-later": GNU.format(what="program", sign=";", name=GENERAL, terms=OLD.format("2")),
    "LGPL-2.1-or-later": GNU.format(what="library", sign=";", name=LESSER, terms=OLD.format("2.1")),
    "GPL-2.0-only": GNU.format(
        what="program", sign=";", name=GENERAL, terms="version 2 as published by\nthe Free Software Foundation."
    ),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
""",
}


@pytest.mark.parametrize("leader", ["", "#", "//", " *", "--"])
def test_standard_notices(spark, leader):
    """Each in its standard form, plain and as a comment; and as an SPDX line."""
    wrap = lambda text: "\n".join(f"{leader} {x}".rstrip() if leader else x for x in text.splitlines())
    before, after = ("/*\n", "\n */\nint x;") if leader == " *" else ("", "\ncode()\n")
    texts = [before + wrap(x) + after for x in NOTICES.values()]
    texts += [before + wrap(f"SPDX-License-Identifier: {x}") + after for x in NOTICES]
    got = licences(spark, texts)
    assert [x[1] for x in got] == [[x] for x in NOTICES] * 2
    if not leader:  # nothing of the tables is out of reach
        seen = {x for ids, _ in got for x in ids}
        single = {"mit-ref", "apache-ref", "gpl3-ref", "cc-by-nc-ref", "cc-by-ref", "cc-by-sa-ref", "id-gpl3"}
        assert set(L.SENTENCES.values()) == seen | single


def test_canonical_urls(spark):
    same = ["http://www.Host.org/a/", "https://m.host.org:443/a.html#x", "host.org/a?utm_source=f&ref=y", " https://host.org/a "]
    other = ["https://host.org/A", "https://host.org/a?page=2&ref=x", "https://host.org", None]
    df = spark.createDataFrame([(x,) for x in same + other], "u string")
    got = [r[0] for r in df.select(R.canonical_url(F.col("u"))).collect()]
    assert got == ["host.org/a"] * 4 + ["host.org/A", "host.org/a?page=2", "host.org", None]


def head(**fields):
    return "HTTP/1.1 200 OK\r\n" + "\r\n".join(f"{k.replace('_', '-')}: {v}" for k, v in fields.items())


SCHEMA = "url string, date long, record_id long, type string, http_headers string, date_of string, fields string, body long"


def resolved(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", r[2] * 10) for r in rows], SCHEMA)
    return {r["record_id"]: r for r in R.resolve(df, carry=["body"]).collect()}


def test_revisits(spark):
    rows = [
        ("http://a.org/x", 10, 1, "response", head(ETag='"1"', Content_Type="text/html", Cache_Control="old", X="kept")),
        ("https://www.a.org/x/", 20, 2, "revisit", head(etag='W/"1"', Content_Type="no", Cache_Control="a", cache_control="new")),
        ("http://a.org/x", 30, 3, "response", head(ETag='"2"', Last_Modified="monday")),
        ("http://a.org/x", 40, 4, "revisit", head(ETag='"1"', Last_Modified="monday")),
        ("http://a.org/x", 50, 5, "revisit", head(Last_Modified="monday")),
        ("http://a.org/x", 60, 6, "revisit", None),
        ("http://a.org/x", 10, 7, "revisit", head(ETag='"1"')),  # not later than the response
        ("http://b.org/x", 99, 8, "revisit", head(ETag='"1"')),
        ("http://a.org/x", 70, 9, "request", head()),
        (None, 1, 10, "response", head(ETag="n")),
        (None, 2, 11, "revisit", head(ETag="n")),
        ("http://a.org/x", None, 12, "revisit", head(ETag='"1"')),
        ("http://a.org/x", 20, 2, "revisit", head(etag='"1"')),  # a repeated id
    ]
    got = resolved(spark, rows)
    want = {2: ("resolved", 1), 4: ("mismatch", 3), 5: ("resolved", 3), 6: ("unchecked", 3), 7: ("no-response", None)}
    want |= {8: ("no-response", None), 11: ("resolved", 10), 12: ("no-response", None)}
    assert {k: (r["outcome"], r["refers_to"]) for k, r in got.items()} == want
    assert got[4]["merged"] is None and got[4]["body"] == 30
    merged = resolved(spark, rows[:2])[2]["merged"]
    assert merged == {"etag": 'W/"1"', "content-type": "text/html", "cache-control": "new", "x": "kept"}


@pytest.mark.parametrize("every", [1, 50])
def test_one_common_url(spark, every):
    rows = [
        ("http://hot.org/", i, i, "response" if i % every == 0 else "revisit", head(ETag=f'"{i // every * every}"')) for i in range(2000)
    ]
    rows += [("http://hot.org/", 10_000, 10_000, "revisit", head(ETag=f'"{1999 // every * every}"'))]
    got = resolved(spark, rows)
    assert all(r["outcome"] == "resolved" and r["refers_to"] == min(k, 1999) // every * every for k, r in got.items())
    assert len(got) == sum(r[3] == "revisit" for r in rows)


def test_empty(spark):
    assert resolved(spark, []) == {}
    assert licences(spark, []) == []
