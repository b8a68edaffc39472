"""Licence scan: Dice coefficient of word bigrams against licence templates.

Texts and templates are normalised alike (lower case, runs of anything but letters and digits part words; line breaks
are no more than that). A template of so many words is compared with windows of as many words of the text, one
beginning at every bigram that the template has, wherever the lines break and whatever stands around. Sizes are numbers
of distinct bigrams on either side. What a window shares with a template is at most what the whole text shares with it,
and Dice is at most 2 * s / (s + b) for s shared and a template of b; so only templates of which a text has enough
bigrams are looked at in windows. Templates are a bounded list of literals: nothing is joined or shuffled.

Defined cases: a null or empty text, and one of a single word, has no licence and score 0; a window ends with the text;
of equally near windows that of the larger template wins, then the first by name, then the first place; repeated rows
are judged alike; an empty table gives an empty result; extra columns are carried along unless they have a name of the
result's. Bigrams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.common import let, text_of

#: Notices by which public licences are declared, and whole texts of short ones, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


@dataclass(frozen=True)
class Template:
    name: str
    words: int
    grams: tuple[int, ...]

    @classmethod
    def of(cls, name: str, text: str) -> Template:
        ws = _words(text)
        return cls(name, len(ws), tuple(sorted({_gram(a, b) for a, b in zip(ws, ws[1:], strict=False)})))


def _gram(a: str, b: str) -> int:
    """What Spark's xxhash64 makes of two words."""
    h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
    return h - (1 << 64) if h >> 63 else h


def _words(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def best_window(hits: Column, grams: Column, t: Template, least: float) -> Column:
    """struct(score, at) of the text's nearest window to a template; null if none can reach least. hits: (at, h) of grams."""
    b, span = len(t.grams), t.words - 1
    nothing = F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("at"))

    def windows(own: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            inside = F.filter(F.slice(own, k + 1, F.lit(span)), lambda y: y["at"] - x["at"] < span)
            shared = F.size(F.array_distinct(F.transform(inside, lambda y: y["h"])))
            size = F.size(F.array_distinct(F.slice(grams, x["at"] + 1, F.lit(span))))
            return F.struct(let(shared, lambda s: F.when(2.0 * s / (s + b) >= least, 2.0 * s / (size + b)).otherwise(0.0)).alias("score"), x["at"].alias("at"))

        best = F.aggregate(F.transform(own, one), nothing, lambda m, x: F.when(x["score"] > m["score"], x).otherwise(m))
        enough = F.size(F.array_distinct(F.transform(own, lambda y: y["h"]))) * (2 - least) >= least * b - 1e-9
        return F.when(enough, let(best, lambda m: F.when(m["score"] >= least, m)))

    return let(F.filter(hits, lambda x: x["h"].isin(list(t.grams))), windows)


def scan(docs: DataFrame, templates=TEMPLATES, least: float = 0.8, text_col: str = "text") -> DataFrame:
    """Every document with license, license_score, license_word (0-based place of the window) and all licenses found."""
    known = sorted((Template.of(*t) for t in templates), key=lambda t: (-len(t.grams), t.name))
    every = sorted({g for t in known for g in t.grams})
    none = F.array().cast("array<struct<score:double,at:int,license:string>>")

    def judged(grams: Column) -> Column:
        hits = F.filter(F.transform(grams, lambda h, k: F.struct(k.alias("at"), h.alias("h"))), lambda x: x["h"].isin(every))

        def all_of(hs: Column) -> Column:
            one = lambda t: let(best_window(hs, grams, t, least), lambda m: F.when(m.isNotNull(), F.struct(m["score"].alias("score"), m["at"].alias("at"), F.lit(t.name).alias("license"))))
            return F.when(F.size(hs) > 0, F.array_compact(F.array(*map(one, known)))).otherwise(none)

        return let(hits, all_of)

    grams = let(normal_words(text_of(text_col)), lambda ws: F.when(F.size(ws) > 1, F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1)))))
    best = F.aggregate("_hits", F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("at"), F.lit(None).cast("string").alias("license")), lambda m, x: F.when(x["score"] > m["score"], x).otherwise(m))
    own = ("license", "license_score", "license_word", "licenses", "_hits", "_best")
    found = docs.drop(*own).withColumn("_hits", F.coalesce(let(grams, judged), none)).withColumn("_best", best)
    return found.withColumns({"license": F.col("_best.license"), "license_score": F.round("_best.score", 6), "license_word": F.col("_best.at"), "licenses": F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["license"])))}).drop("_hits", "_best")


def op6(spark, sf_dir: str) -> DataFrame:
    from colloquy.llm.common import read

    return scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license", "license_score", "license_word", F.array_join("licenses", ",").alias("licenses"))


def oracle_sql(templates=TEMPLATES, least: float = 0.8) -> str:
    """The same scan of documents in DuckDB SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    ws = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    rows = ", ".join(f"({k}, {quoted(n)}, {quoted(t)})" for k, (n, t) in enumerate(templates))
    return f"""WITH tpl AS (SELECT t, name, {ws.format('body')} AS ws FROM (VALUES {rows}) v(t, name, body)),
 tg AS (SELECT DISTINCT t, name, len(ws) - 1 AS span, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM tpl),
 size AS (SELECT t, any_value(name) AS name, any_value(span) AS span, count(*) AS b FROM tg GROUP BY t),
 texts AS (SELECT row_number() OVER () AS r, doc_id, {ws.format("coalesce(text, '')")} AS ws FROM documents),
 grams AS (SELECT r, unnest(range(0, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM texts WHERE len(ws) > 1),
 hits AS (SELECT r, t, i, g FROM grams JOIN tg USING (g)),
 able AS (SELECT r, t FROM hits JOIN size USING (t) GROUP BY r, t, b HAVING count(DISTINCT g) * (2 - {least}) >= {least} * b - 1e-9),
 own AS (SELECT h.*, span, b, name FROM hits h JOIN able USING (r, t) JOIN size USING (t)),
 shared AS (SELECT x.r, x.t, x.i, x.name, x.span, x.b, count(DISTINCT y.g) AS s FROM own x JOIN own y ON x.r = y.r AND x.t = y.t AND y.i >= x.i AND y.i < x.i + x.span GROUP BY ALL),
 scored AS (SELECT x.r, x.t, x.i, x.name, x.b, 2.0 * s / (count(DISTINCT g.g) + b) AS score FROM shared x JOIN grams g ON g.r = x.r AND g.i >= x.i AND g.i < x.i + x.span GROUP BY x.r, x.t, x.i, x.name, x.b, s),
 best AS (SELECT * FROM scored WHERE score >= {least}),
 one AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, b DESC, name, i) = 1),
 listed AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM best GROUP BY r)
 SELECT d.doc_id, o.name AS license, coalesce(round(CAST(o.score AS DOUBLE), 6), 0.0) AS license_score, CAST(coalesce(o.i, -1) AS INTEGER) AS license_word, coalesce(licenses, '') AS licenses
 FROM texts d LEFT JOIN one o ON o.r = d.r LEFT JOIN listed l ON l.r = d.r"""
