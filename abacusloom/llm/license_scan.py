"""License scan: MinHash bands over overlapping windows find templates, exact shingle containment decides.

Each template belongs to a size class: the power of two, S, that holds its shingles. Windows of the class are 2 S
shingles long and begin every S, so that any run of S shingles lies within one of them. A template of which
0.8 is there then has a similarity of 0.2 or more with that window; with ``HASHES`` bands of one row the pair is
missed with probability below 0.8 ** 32 < 0.001. Where a band agrees, the share of the template's shingles that the window
holds is computed exactly.

A template's band stands on the one of its shingles that the band's function makes smallest. A window that holds none of these
shingles cannot agree in a band; so the bands' shingles are looked up first, and only the windows around them are hashed and compared
band by band. Words are runs of letters and digits in lower case; a shingle is five of them, and a template must have
one at least. The templates are a parameter of bounded size, whose shingles every task holds. Only DataFrame functions
are used. Null and empty texts, and texts of fewer than five words, hold no license; texts of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, table

SHINGLE = 5
CONTAINED = 0.8
HASHES = 32
MOST_TEMPLATE_WORDS = 100_000

#: Licenses and notices as they are worded, whole ones and the lines and headers that refer to them.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "SPDX-free-line": "This is free and unencumbered software released into the public domain.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "LGPL-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-header": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}


def words(text: str | Column) -> Column:
    plain = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingle(at: Column, of: Column) -> Column:
    return F.xxhash64(*(F.element_at(of, (at + i).cast("int")) for i in range(SHINGLE)))


def _shingles(of: Column) -> Column:
    """Distinct shingle hashes of an array of at least five words."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(of) - SHINGLE + 1), lambda i: _shingle(i, of)))


def template_rows(spark: SparkSession, templates: Mapping[str, str]) -> DataFrame:
    """``license``, ``wanted`` (its shingles), ``size_class``."""
    if sum(len(t.split()) for t in templates.values()) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MOST_TEMPLATE_WORDS} words; scan with several smaller sets")
    rows = spark.createDataFrame(list(templates.items()), "license string, template string").withColumn("w", words("template"))
    if short := [r[0] for r in rows.filter(F.size("w") < SHINGLE).select("license").collect()]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    wanted = rows.select("license", _shingles(F.col("w")).alias("wanted"))
    return wanted.withColumn("size_class", F.pow(F.lit(2), F.ceil(F.log2(F.size("wanted")))).cast("int"))


def _signature(shingles: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(HASHES)), lambda k: F.struct(k.alias("band"), F.array_min(F.transform(F.col(shingles), lambda x: F.xxhash64(x, k))).alias("value")))


def _smallest(shingles: str) -> Column:
    """The shingles on which the bands of a signature stand."""
    least = lambda k: F.array_min(F.transform(F.col(shingles), lambda x: F.struct(F.xxhash64(x, k).alias("h"), x.alias("x"))))["x"]
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(HASHES)), least))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, contained: float = CONTAINED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per document and license found: ``key``, ``license``, ``containment`` (best window), ``first_word`` (where the first
    such window begins, from 0), ``windows``. Rows of one key are scanned as one document; of templates that are contained alike each has its row.
    An empty table, or a column of the result's names in ``docs``, changes nothing: only ``key`` and ``text`` are read."""
    spark = docs.sparkSession
    known = template_rows(spark, templates)
    held = known.select("size_class", _smallest("wanted").alias("smallest")).collect()
    every = sorted({x for r in held for x in r["smallest"]})
    vocabulary = sorted({w for (ws,) in spark.createDataFrame([(t,) for t in templates.values()], "t string").select(words("t")).collect() for w in ws})
    classes = sorted({r["size_class"] for r in held})

    w = F.col("w")
    near = lambda i: F.element_at(w, i.cast("int")).isin(vocabulary) & F.element_at(w, (i + SHINGLE - 1).cast("int")).isin(vocabulary)
    sized = hold(docs.select(F.col(key), text), "w", words(text)).drop(text).filter(F.size("w") >= SHINGLE)
    likely = hold(sized, "at", F.filter(F.sequence(F.lit(1), F.size("w") - SHINGLE + 1), near)).filter(F.size("at") > 0)
    hits = hold(likely.withColumnRenamed("at", "near"), "at", F.filter("near", lambda i: _shingle(i, w).isin(every))).filter(F.size("at") > 0)
    window = lambda i, s: F.array(F.struct(F.lit(s).alias("s"), F.floor((i - 1) / s).alias("n")), F.struct(F.lit(s).alias("s"), F.greatest(F.lit(0).cast("long"), F.floor((i - 1) / s) - 1).alias("n")))
    spans = F.array_distinct(F.flatten(F.transform("at", lambda i: F.concat(*(window(i, s) for s in classes)))))
    cut = lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n"), F.slice("w", (x["n"] * x["s"] + 1).cast("int"), x["s"] * 2 + SHINGLE - 1).alias("v"))
    inside = hits.select(F.col(key), F.explode(F.transform(spans, cut)).alias("span")).select(F.col(key), "span.s", "span.n", "span.v")
    windows = hold(inside.filter(F.size("v") >= SHINGLE), "there", _shingles(F.col("v"))).drop("v")
    bands = windows.select(F.col(key), "s", "n", "there", F.explode(_signature("there")).alias("m")).select(F.col(key), "s", "n", "there", "m.band", "m.value")
    keys = known.select("license", "wanted", F.col("size_class").alias("s"), F.explode(_signature("wanted")).alias("m")).select("license", "wanted", "s", "m.band", "m.value")
    share = F.size(F.array_intersect("there", "wanted")) / F.size("wanted")
    met = bands.join(F.broadcast(keys), ["s", "band", "value"]).select(F.col(key), "license", "s", "n", share.alias("share"))
    return (
        met.filter(F.col("share") >= contained)
        .groupBy(key, "license")
        .agg(F.max("share").alias("containment"), F.min(F.col("n") * F.col("s")).alias("first_word"), F.count_distinct("n").alias("windows"))
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a license or notice, with which."""
    return scan(table(spark, sf_dir, "documents"))
