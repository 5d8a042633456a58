"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

A header is a line with a word that speaks of licensing; a licence file, told by its name or by being little else than such lines, is
compared as a whole too. Notices may be wrapped, so runs of lines around a header are compared as well; they don't count in the frequencies. Equal headers are compared once, with the number of their occurrences as weight in the document frequencies, which cover
all headers of the corpus and the templates. The cosine is a sparse product: headers and templates meet on shared words only. As a few words
tell licenses apart that share all others, a template counts only if its version numbers and, for SPDX lines, its identifier stand in the header, and
if both speak of the same variant (non-commercial, no derivatives, share-alike, lesser, affero); and a header whose two most similar licenses lie within a
margin has none. A file's own license is that of its most similar header, from a fixed similarity on, whole licence texts before notices. Licence files speak for their directory; a file without
a license of its own takes that of the nearest directory above it that has one, found by joins on path prefixes of the distinct directories.

Defined results: null text is the empty text; a null path lies in no directory and inherits nothing; of equal similarities the alphabetically first
license counts, of several licence files in a directory the most similar one, then the first path; repeated rows stay repeated; an empty
table gives an empty result; columns other than the named ones are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: License names and the notices and titles that stand for them.
NOTICES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal, public domain."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted. ISC License."),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: SPDX identifiers besides the names above, and what they are called here.
SPDX = {"AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0"}
#: Whole texts of short licenses.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
WHOLE = (
    ("BSD-2-Clause", f"BSD 2-Clause License. Copyright. All rights reserved. {_BSD} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"BSD 3-Clause License. Copyright. All rights reserved. {_BSD} {_BSD_NAMES} {_BSD_AS_IS}"),
    ("ISC", 'ISC License. Copyright. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", f'MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}'),
)


def _templates() -> tuple:
    """(license, text, whether a whole licence text, words that must stand in a unit beside the numbers)."""
    ids = {lic: lic for lic, _ in NOTICES if lic != "Proprietary"} | SPDX
    lines = [(name, f"SPDX-License-Identifier: {spdx}", False, sorted(set(re.findall(TOKEN, spdx.lower())))) for spdx, name in ids.items()]
    return (*[(lic, text, False, []) for lic, text in NOTICES], *[(lic, text, True, []) for lic, text in WHOLE], *lines)


#: What makes a line a header, and a file a licence file: its name, or the share of its words that stand in headers.
CUE = r"(?i)(licen[cs]|copyright|spdx|rights reserved|public domain|permission|redistribut)"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"
MOSTLY = 0.5
#: Lines in a run around a header, none of them blank, and its characters; longer runs hold too much besides any template to be similar to it.
RUN_LINES, RUN_CHARS = 5, 600
#: Tasks over which the files of a directory are spread.
SALT = 64
#: Similarity from which a header counts, and by which its license must be ahead of the next.
LEAST, MARGIN = 0.75, 0.02
TOKEN = "[a-z0-9.]*[a-z0-9]"
#: Version numbers (a trailing .0 does not count), years, and the variants that tell licenses apart, as patterns on words joined by blanks.
NUMBER, YEAR = "^[0-9]+([.][0-9]+)*$", "^(19|20)[0-9][0-9]$"
VARIANTS = (("affero", "(^| )(affero|agpl)( |$)"), ("lesser", "(^| )(lesser|library general|lgpl)( |$)"), ("nc", "(^| )(nc|noncommercial|non commercial)( |$)"), ("nd", "(^| )(nd|noderivatives|noderivs|no derivatives)( |$)"), ("sa", "(^| )(sa|sharealike|share alike)( |$)"), ("several", "(^| )identifier .*( and | with | or ([^l]|l[^a]|la[^t]))"))
TEMPLATES = _templates()


def _numbers(tokens: F.Column) -> F.Column:
    plain = F.transform(tokens, lambda t: F.regexp_replace(F.regexp_replace(t, "^v", ""), "([.]0)+$", ""))
    return F.array_distinct(F.filter(plain, lambda t: t.rlike(NUMBER) & ~t.rlike(YEAR)))


def _variants(tokens: F.Column) -> F.Column:
    words = F.array_join(tokens, " ")
    return F.concat_ws(" ", *[F.when(words.rlike(pattern), name) for name, pattern in VARIANTS])


def _tokens(text: F.Column) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _runs(text: F.Column) -> F.Column:
    """Runs of 2 to RUN_LINES lines that hold a header, each as one string."""
    lines = F.split(text, "\n")
    reach = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(a).alias("a")) for b in range(RUN_LINES) for a in range(RUN_LINES - b) if b or a])
    around = lambda i: F.transform(F.filter(reach, lambda r: (i >= r["b"]) & (i + r["a"] < F.size(lines))), lambda r: F.slice(lines, i + 1 - r["b"], r["b"] + r["a"] + 1))
    runs = F.flatten(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(CUE), around(i))), lambda r: r.isNotNull()))
    whole = F.transform(F.filter(runs, lambda r: F.forall(r, lambda x: F.trim(x) != "")), lambda r: F.array_join(r, "\n"))
    return F.filter(whole, lambda r: F.length(r) <= RUN_CHARS)


def compare(units: DataFrame, templates: tuple = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(unit, license, similarity, full) of each distinct unit that is similar to a template, full: to a whole licence text; units: (unit, text, n), unit a short key of the text, n its occurrences, 0 if it does not count."""
    spark = units.sparkSession
    given = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "template int, license string, text string, full boolean, words array<string>")
    counted = lambda df, keys: df.withColumn("token", F.explode(_tokens(F.col("text")))).groupBy(*keys, "token").agg(F.count("*").alias("tf"))
    of_units = counted(units.select("unit", "n", "text"), ["unit", "n"])
    of_templates = counted(given, ["template"])
    df = of_units.select("token", "n").union(of_templates.select("token", F.lit(1).cast("long").alias("n"))).groupBy("token").agg(F.sum("n").alias("df"))
    total = (units.agg(F.sum("n")).first()[0] or 0) + len(templates)
    weight = (F.col("tf") * (F.log((F.lit(1.0) + total) / (1 + F.col("df"))) + 1)).alias("w")
    unit_w = of_units.join(df, "token").select("unit", "token", weight)
    template_w = of_templates.join(df, "token").select("template", "token", weight)
    unit_norm = unit_w.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    template_norm = template_w.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    dots = unit_w.join(template_w.withColumnRenamed("w", "t_w"), "token").groupBy("unit", "template").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    similar = dots.join(unit_norm, "unit").join(F.broadcast(template_norm), "template").withColumn("similarity", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6)).where(F.col("similarity") >= least)
    told = lambda df, *keep: df.withColumn("tokens", _tokens(F.col("text"))).select(*keep, "tokens", _numbers(F.col("tokens")).alias("numbers"), _variants(F.col("tokens")).alias("variant"))
    need = told(given, "template", "license", "full", "words").select("template", "license", "full", F.concat("words", F.transform("numbers", lambda x: F.concat(F.lit("number "), x))).alias("needs"), F.col("variant").alias("t_variant"))
    has = told(units, "unit").select("unit", F.concat("tokens", F.transform("numbers", lambda x: F.concat(F.lit("number "), x))).alias("has"), "variant")
    fits = similar.join(F.broadcast(need), "template").join(has, "unit").where((F.size(F.array_except("needs", "has")) == 0) & (F.col("variant") == F.col("t_variant")))
    of_license = fits.groupBy("unit", "license").agg(F.min(F.struct((~F.col("full")).alias("notice"), (-F.col("similarity")).alias("s"))).alias("b"))
    ranked = of_license.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("b.notice", "b.s", "license"))).alias("r"))  # at most as many as licenses
    best, second = F.col("r")[0], F.get("r", F.lit(1))
    clear = second.isNull() | (second["notice"] != best["notice"]) | (second["s"] - best["s"] >= MARGIN)
    return ranked.where(clear).select("unit", best["license"].alias("license"), (-best["s"]).alias("similarity"), (~best["notice"]).alias("full"))


def directories(files: DataFrame) -> DataFrame:
    """(dir, above, depth): every directory that holds a file of (path), with itself and each directory above it; the root is ''."""
    dirs = files.where("path is not null").select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir")).distinct()
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    return dirs.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).select("dir", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("above"), "depth")


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, path, own_license, similarity, license, origin, from_dir) for every row of files.

    origin: own where the file states its license, inherited where a directory does (from_dir), null where none is known.
    """
    rows = files.select(files[id_col].alias("doc_id"), files[path_col].cast("string").alias("path"), F.coalesce(files[text_col], F.lit("")).alias("text"))
    said = F.when(F.col("text").rlike(CUE), F.filter(F.split("text", "\n"), lambda x: x.rlike(CUE))).otherwise(F.array().cast("array<string>"))
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    with_headers = rows.withColumn("headers", said)
    words_said = F.aggregate("headers", F.lit(0), lambda s, x: s + F.regexp_count(x, F.lit(common.WORD)))
    is_file = F.when(F.size("headers") > 0, named | (words_said >= MOSTLY * common.n_words(F.col("text")))).otherwise(named)
    units = F.array_distinct(F.when(F.col("licence_file"), F.concat("headers", F.array("text"))).otherwise(F.col("headers")))
    marked = with_headers.withColumn("licence_file", is_file).select("doc_id", "path", "licence_file", units.alias("units"), F.when(F.size("headers") > 0, F.array_except(F.array_distinct(_runs(F.col("text"))), units)).otherwise(F.array().cast("array<string>")).alias("runs")).withColumn("row", F.monotonically_increasing_id())
    marked = common.cut(marked, "license-units")
    said_by = lambda column, n: marked.where(F.size(column) > 0).select("row", F.explode(column).alias("text"), F.lit(n).cast("long").alias("n"))
    every = said_by("units", 1).union(said_by("runs", 0)).withColumn("unit", F.unhex(F.md5("text")))
    found = common.cut(compare(every.groupBy("unit", "text").agg(F.sum("n").alias("n")), **how), "license-matches")
    own = every.select("row", "unit").join(found, "unit").groupBy("row").agg(F.min(F.struct((~F.col("full")).alias("notice"), (-F.col("similarity")).alias("s"), "license")).alias("b")).select("row", F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("similarity"))
    known = common.cut(marked.drop("units", "runs").join(own, "row", "left"), "license-own")

    in_dir = F.regexp_replace("path", "/?[^/]*$", "")
    speaks = known.where("licence_file and own_license is not null and path is not null").groupBy(in_dir.alias("above")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "own_license")).alias("b")).select("above", F.col("b.own_license").alias("dir_license"))
    nearest = directories(known).join(speaks, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license")).alias("b")).select("dir", F.col("b.above").alias("from_dir"), F.col("b.dir_license").alias("dir_license"))
    # one directory may hold a third of all files, so its files meet it in SALT tasks
    spread = nearest.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    joined = known.withColumns({"dir": in_dir, "salt": F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")}).join(spread, ["dir", "salt"], "left")
    has = F.col("own_license").isNotNull()
    origin = F.when(has, "own").when(F.col("dir_license").isNotNull(), "inherited")
    return joined.select("doc_id", "path", "own_license", "similarity", F.coalesce("own_license", "dir_license").alias("license"), origin.alias("origin"), F.when(~has, F.col("from_dir")).alias("from_dir"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: source and language are directories, the id is the name."""
    docs = common.table(spark, sf_dir, "documents")
    return scan(docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", "doc_id").alias("path")))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(map(quoted, xs)) + "]::varchar[]"
    values = ", ".join(f"({k}, {quoted(lic)}, {quoted(text)}, {full}, {listed(words)})" for k, (lic, text, full, words) in enumerate(TEMPLATES))
    numbers = f"list_distinct(list_filter(list_transform(toks, lambda x: regexp_replace(regexp_replace(x, '^v', ''), '([.]0)+$', '')), lambda x: regexp_matches(x, '{NUMBER}') and not regexp_matches(x, '{YEAR}')))"
    told = f"list_transform({numbers}, lambda x: 'number ' || x)"
    variant = "concat_ws(' ', " + ", ".join(f"case when regexp_matches(array_to_string(toks, ' '), '{pattern}') then '{name}' end" for name, pattern in VARIANTS) + ")"
    return rf"""
with t(template, license, text, is_full, words) as (values {values}),
d as (
  select doc_id, concat_ws('/', source, lang, doc_id::varchar) as path, coalesce(text, '') as text from documents
), h as (
  select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{CUE}')) as headers from d
), m as (
  select doc_id, path, case when len(headers) > 0 and list_sum(list_transform(headers, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))) >= {MOSTLY} * len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) then true
    else regexp_matches(path, '{FILE_NAME}') end as licence_file, headers, text from h
), e as (
  select distinct doc_id, path, unnest(case when licence_file then list_append(headers, text) else headers end) as unit from m
), u as (
  select unit, count(*) as n, regexp_extract_all(lower(unit), '{TOKEN}') as toks from e group by unit
), ut as (
  select unit, n, unnest(toks) as token from u
), uc as (
  select unit, n, token, count(*) as tf from ut group by all
), tk as (
  select *, regexp_extract_all(lower(text), '{TOKEN}') as toks from t
), tc as (
  select template, token, count(*) as tf from (select template, unnest(toks) as token from tk) group by all
), df as (
  select token, sum(n) as df from (select token, n from uc union all select token, 1 from tc) group by token
), total as (
  select coalesce((select sum(n) from u), 0) + {len(TEMPLATES)} as total
), uw as (
  select unit, token, tf * (ln((1.0::double + total) / (1 + df)) + 1) as w from uc join df using (token), total
), tw as (
  select template, token, tf * (ln((1.0::double + total) / (1 + df)) + 1) as w from tc join df using (token), total
), un as (
  select unit, sqrt(sum(w * w)) as norm from uw group by unit
), tn as (
  select template, sqrt(sum(w * w)) as norm from tw group by template
), dots as (
  select unit, template, sum(uw.w * tw.w) as dot from uw join tw using (token) group by all
), need as (
  select template, license, is_full, list_concat(words, {told}) as needs, {variant} as variant from tk
), has as (
  select unit, list_concat(toks, {told}) as has, {variant} as variant from u
), fits as (
  select unit, license, is_full, round(dot / (un.norm * tn.norm), 6) as similarity
  from dots join un using (unit) join tn using (template) join need using (template) join has using (unit)
  where round(dot / (un.norm * tn.norm), 6) >= {LEAST} and list_has_all(has.has, needs) and has.variant = need.variant
), of_license as (
  select unit, license, is_full, similarity from fits qualify row_number() over (partition by unit, license order by is_full desc, similarity desc) = 1
), ranked as (
  select *, row_number() over w as k, lead(is_full) over w as next_full, lead(similarity) over w as next_similarity from of_license
  window w as (partition by unit order by is_full desc, similarity desc, license)
), sim as (
  select unit, license, is_full, similarity from ranked where k = 1 and (next_full is null or next_full <> is_full or similarity - next_similarity >= {MARGIN})
), own as (
  select doc_id, license as own_license, similarity from e join sim using (unit)
  qualify row_number() over (partition by doc_id order by is_full desc, similarity desc, license) = 1
), k as (
  select m.doc_id, m.path, m.licence_file, regexp_replace(m.path, '/?[^/]*$', '') as dir, own_license, similarity from m left join own using (doc_id)
), speaks as (
  select dir as above, own_license as dir_license from k where licence_file and own_license is not null
  qualify row_number() over (partition by dir order by similarity desc, path) = 1
), near as (
  select d.dir, s.above as from_dir, s.dir_license from (select distinct dir from k) d join speaks s on s.above = '' or d.dir = s.above or starts_with(d.dir, s.above || '/')
  qualify row_number() over (partition by d.dir order by length(s.above) desc) = 1
)
select doc_id, path, own_license, similarity, coalesce(own_license, dir_license) as license,
  case when own_license is not null then 'own' when dir_license is not null then 'inherited' end as origin,
  case when own_license is null then from_dir end as from_dir
from k left join near using (dir)
"""


SQL = _sql()
