"""Licence scan: TF-IDF cosine of text units to licence templates, then inheritance by directory.

Units are lines and sentences of the whole text that hold a licence cue, and with wrapped lines
joined its sentences and paragraphs, each line with the next one, and the text itself. The term
weights come from the templates (a fixed, small table; other terms weigh as much as the rarest).
SPDX tags name their licence and are read as they are. A file without a licence of its own takes
that of the nearest directory above it that has a licence file. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: SPDX ids and wording of common licence notices.
TEMPLATES = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0, dedicated to the public domain."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. The Unlicense."),
]
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
#: Family, SPDX name, version and date of the GNU licences.
_GNU = [("", "GPL", "2", "June 1991"), ("", "GPL", "3", "29 June 2007"), ("Lesser", "LGPL", "2.1", "February 1999"), ("Lesser", "LGPL", "3", "29 June 2007"), ("Affero", "AGPL", "3", "19 November 2007")]
#: Titles, headers and short licences as a whole. They weigh terms as TEMPLATES do.
NOTICES = [
    ("MIT", _GRANT), ("MIT", "MIT License Copyright (c) " + _GRANT + " " + _MIT_REST), ("MIT", "The MIT License (MIT)"),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "ISC License Copyright (c) " + _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_REST),
    ("0BSD", "BSD Zero Clause License Copyright (c) " + _ISC + ". " + _ISC_REST),
    ("BSD-2-Clause", "BSD 2-Clause License Copyright (c) All rights reserved. " + _BSD + " " + _BSD_REST),
    ("BSD-3-Clause", "BSD 3-Clause License Copyright (c) All rights reserved. " + _BSD + " 3. " + _BSD_NAME + " " + _BSD_REST), ("BSD-3-Clause", _BSD_NAME), ("BSD-3-Clause", "3. " + _BSD_NAME),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    *[(f"CC-BY-{k}4.0", f"Creative Commons Attribution-{n}4.0 International Public License") for k, n in [("", ""), ("NC-", "NonCommercial "), ("SA-", "ShareAlike ")]],
    *[(f"{k}-{v if '.' in v else v + '.0'}", " ".join(f"GNU {n} General Public License Version {v}, {day}".split())) for n, k, v, day in _GNU],
    *[(f"{k}-{v if '.' in v else v + '.0'}", " ".join(f"This {w} is free software: you can redistribute it and/or modify it under the terms of the GNU {n} General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.".split())) for n, k, v, _ in _GNU for w in ("program", "library")],
]
#: From the title of a long licence to the words that close its terms.
LONG_TEXT = r"(?is)(GNU (Affero |Lesser )?General Public License\s+Version [23]|Apache License\s+Version 2\.0).*END OF TERMS AND CONDITIONS"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)"
CUE = r"(?i)(licen[sc]e|copyright|spdx|public domain|permission is hereby|permission to use|redistribution)"
LICENSE_FILE = r"(?i)(^|/)(un)?licen[sc]e(s)?([.-][^/]*)?$|(?i)(^|/)copying([.-][^/]*)?$"


def units(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"([.;!?])[ \t]+", "$1\n"), "\n")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def joined_units(text: Column) -> list[tuple[str, Column]]:
    """(kind, units) over line ends: sentences, paragraphs, each cued line with the next, the text."""
    text = F.regexp_replace(text, "\r", "")
    apart = F.split(F.regexp_replace(text, r"(?m)^[^\p{L}\p{N}\n]+$", ""), "\n\n+")
    paragraphs = F.transform(apart, lambda p: F.trim(F.regexp_replace(p, r"\n[^\p{L}\p{N}\n]*", " ")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    pairs = F.zip_with(lines, F.slice(lines, 2, F.size(lines)), lambda a, b: F.when(a.rlike(CUE), F.concat_ws(" ", a, b)))
    return [("sentence", F.flatten(F.transform(paragraphs, units))), ("paragraph", paragraphs), ("pair", pairs), ("text", F.array(text))]


def spdx_ids(text: Column) -> Column:
    """Ids that the SPDX tags of a text name, in the spelling and without the -only of TEMPLATES."""
    tags = F.regexp_extract_all(text, F.lit(SPDX), F.lit(1))
    # what follows WITH is an exception and no licence
    words = F.flatten(F.transform(tags, lambda x: F.regexp_extract_all(F.regexp_replace(x, r"(?i)\bwith\s+\S+", " "), F.lit("([A-Za-z0-9.+-]+)"), F.lit(1))))
    named = F.filter(words, lambda x: ~F.lower(x).isin("and", "or", "none", "noassertion", "with"))
    bare = F.transform(named, lambda x: F.regexp_replace(x, r"(?i)(-only|-or-later|[+])$", ""))
    known = sorted({k for k, _ in TEMPLATES + NOTICES})
    spelled = F.create_map(*[F.lit(x) for k in known for x in (k.lower(), k)])
    return F.array_distinct(F.transform(bare, lambda x: F.coalesce(spelled[F.lower(x)], x)))


def template_weights(spark) -> tuple[DataFrame, DataFrame, float]:
    """(term, license, template, unit weight), (term, idf), idf of any other term."""
    values = ", ".join(f"({i}, '{k}', '{t}')" for i, (k, t) in enumerate(TEMPLATES + NOTICES))
    t = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, license, text)")
    tf = t.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    idf = tf.filter(F.col("template") < len(TEMPLATES)).groupBy("term").agg((F.log((1 + len(TEMPLATES)) / (1 + F.count("*"))) + 1).alias("idf"))
    other = F.log(F.lit(1.0 + len(TEMPLATES))) + 1
    w = tf.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", other))
    norm = w.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    w = w.join(F.broadcast(norm), "template").select("term", "template", "license", (F.col("w") / F.col("norm")).alias("w"))
    return w, idf, other


def scan_licenses(df: DataFrame, text: str = "text", path: str = "path", least: float = 0.6, file_share: float = 0.5, least_whole: float = 0.9, carry: list[str] | None = None) -> DataFrame:
    """(row, path, own_license, own_score, license_dir, license) for each row of df; row has the
    columns to carry, all by default, whatever their names.

    own_license is the template nearest to any unit of the text, with a cosine of `least` or more
    (ties: the smaller id), or that of an SPDX tag. A text as a whole has to reach `least_whole`.
    A row is a licence file if its name says so or licence units hold `file_share` of its
    characters: lines and tags, or paragraphs of `least_whole`, or a long licence. license is the own one, else that of the nearest directory
    above. Null or empty texts and paths have none of their own; a null path inherits nothing;
    equal rows get equal results; an empty table gives an empty one. A text is scanned whole.
    Every row has a key of its own path and text, cued or not, so joins meet no null keys.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    told = F.coalesce(F.concat(F.lit("p"), F.col(f"`{path}`")), F.lit("n"))
    rk = F.unhex(F.md5(F.concat(told, F.lit("\0"), body)))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carry or df.columns]).alias("row"), F.col(f"`{path}`").alias("path"), rk.alias("rk"))
    cued = df.filter(body.rlike(CUE)).select(rk.alias("rk"), F.length(body).alias("chars"), F.col(f"`{path}`").alias("path"), body.alias("body")).dropDuplicates(["rk"])
    # read for each kind of unit, for tags and for files; dealt by key, so that sums and joins by key need no shuffle of terms
    cued = cut(cued, "cued").repartition("rk")
    with_cue = lambda x: F.filter(x, lambda u: u.rlike(CUE + "|(?i)neither the name"))
    kinds = {"line": F.filter(units(F.col("body")), lambda u: u.rlike(CUE)), **{k: with_cue(x) for k, x in joined_units(F.col("body"))}}
    lists = cued.select("rk", *[x.alias(k) for k, x in kinds.items()])
    # what is a line or a paragraph already is that only
    own_kind = {"line": F.col("line"), "paragraph": F.col("paragraph"), "sentence": F.array_except("sentence", "line"), "pair": F.array_except("pair", "paragraph"), "text": F.array_except("text", "paragraph")}
    named = lambda k, x: F.transform(F.array_distinct(x), lambda u: F.struct(F.lit(k).alias("kind"), u.alias("unit")))
    unit = lists.select("rk", F.explode(F.concat(*[named(k, x) for k, x in own_kind.items()])).alias("u"))
    # units may be whole texts, so rows of terms carry their hash
    unit = unit.select("rk", "u.kind", F.xxhash64("u.unit").alias("unit"), F.length("u.unit").alias("n"), terms(F.col("u.unit")).alias("terms"))
    unit = unit.select("rk", "kind", "unit", "n", F.explode("terms").alias("term"))
    w, idf, other = template_weights(spark)
    tf = unit.groupBy("rk", "kind", "unit", "n", "term").agg(F.count("*").alias("tf"))
    # the templates are a constant of this module, so their tables may be broadcast
    weighed = tf.join(F.broadcast(idf), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", other))
    norm = weighed.groupBy("rk", "kind", "unit", "n").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = weighed.join(F.broadcast(w), "term").groupBy("rk", "kind", "unit", "license", "template").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    score = dot.join(norm, ["rk", "kind", "unit"]).groupBy("rk", "kind", "unit", "n", "license").agg(F.round(F.max(F.col("dot") / F.col("norm")), 6).alias("score"))
    score = score.filter(F.col("score") >= F.when(F.col("kind") == "text", least_whole).otherwise(least))
    tags = cued.filter(F.col("body").rlike(SPDX)).select("rk", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(SPDX), F.lit(0)))).alias("tag"))
    tags = tags.select("rk", F.lit("line").alias("kind"), F.xxhash64("tag").alias("unit"), F.length("tag").alias("n"), F.explode(spdx_ids(F.col("tag"))).alias("license"), F.lit(1.0).alias("score"))
    # few rows, read several times below
    score = cut(score.unionByName(tags), "scores")
    best = score.groupBy("rk").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("b"))
    held = score.groupBy("rk", "kind", "unit", "n").agg(F.max("score").alias("score"))
    part = lambda kind, low: F.sum(F.when((F.col("kind") == kind) & (F.col("score") >= low), F.col("n")).otherwise(0))
    covers = held.groupBy("rk").agg(F.greatest(part("line", least), part("paragraph", least_whole), part("text", least_whole)).alias("covered"))
    long = cued.select("rk", F.length(F.regexp_extract("body", LONG_TEXT, 0)).alias("long"))
    covers = covers.join(long, "rk").select("rk", F.greatest("covered", "long").alias("covered"))
    own = best.join(covers, "rk").select("rk", F.col("b.license").alias("own_license"), (-F.col("b.less")).alias("own_score"), "covered")
    # directories with a licence file: of several the best scored
    above = lambda p: F.regexp_replace(p, r"/?[^/]*$", "")
    files = own.join(cued.select("rk", "chars", "path"), "rk").filter(F.col("path").isNotNull() & (F.col("path").rlike(LICENSE_FILE) | (F.col("covered") >= F.col("chars") * file_share)))
    grants = files.groupBy(above(F.col("path")).alias("license_dir")).agg(F.min(F.struct((-F.col("own_score")).alias("less"), "own_license")).alias("g"))
    grants = grants.select("license_dir", F.col("g.own_license").alias("granted"))
    # each directory once, however many files it has; its ancestors are as many as its depth
    dirs = rows.filter("path is not null").select(above(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    chain = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    near = dirs.select("dir", F.posexplode(chain).alias("depth", "license_dir")).join(grants, "license_dir").groupBy("dir").agg(F.max(F.struct("depth", "license_dir", "granted")).alias("n"))
    near = near.select("dir", F.col("n.license_dir").alias("license_dir"), F.col("n.granted").alias("granted"))
    # no directory has such a name, and rows without a path don't meet in one task
    out = rows.withColumn("dir", F.coalesce(above(F.col("path")), F.concat(F.lit("\0"), F.hex("rk"))))
    out = out.join(own, "rk", "left").join(near, "dir", "left")
    return out.select("row", "path", "own_license", "own_score", F.when(F.col("own_license").isNull(), F.col("license_dir")).alias("license_dir"), F.coalesce("own_license", "granted").alias("license"))
