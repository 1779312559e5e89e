"""License scans: sparse TF-IDF cosine of lines, blocks and licence files to templates, then inheritance from the nearest
ancestor directory.

Terms are lower-cased runs of a-z and 0-9 but for STOP words; a term weighs (1 + ln tf) * idf, with idf over the templates and the largest
idf for terms of none. A line of a file is licensed as the template nearest to it, from a cosine of ``threshold`` and two
shared terms on. A
block is a run of consecutive lines that hold terms, less its copyright statements; it is compared with BLOCKS (whole
notices, whole short licences, SPDX forms) and speaks for all its lines if it comes nearer than each of them. The whole
text of a file named as a licence is compared so too, against all its blocks. A file has the licence of its best part. A file is a licence file if its name says so, or if at least half of its lines
that hold terms are licensed; the best licence file of a directory (by score, then licence, then path) speaks for the
directory, and a file without a licence takes that of the nearest directory at or above it that has one.

DataFrame operations only. A line or block can reach the threshold only if it holds a term of a template's prefix (its weightiest
terms, until the rest has a norm below the threshold; numbers go last), and if its known terms may outweigh its unknown
ones: texts without a prefix term, and then parts that cannot reach it, are dropped, which loses none. Texts that stay move once, by path, and all their parts are judged there. The templates' terms
are broadcast; their number is fixed by TEMPLATES and BLOCKS. Directories and ancestors that hold many rows are dealt over
parts in the joins (see hot_keys).

Defined cases: null and empty texts have no lines with terms; null paths are files at the root with an empty name; rows
that repeat a path are one file with the lines of all; ties go to the first licence by name; an empty table gives an
empty table; other columns do not pass through.
"""

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, materialise, spread_join

THRESHOLD = 0.6
#: Notices and opening passages by which licences are known.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_ASIS = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} General Public License as published by the Free Software Foundation, {3}either version {4} of the License, or (at your option) any later version."
_NO_WARRANTY = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} General Public License for more details. You should have received a copy of the GNU {1} General Public License along with this {0}. If not, see https://www.gnu.org/licenses/."
_GNU_KINDS = (("GPL-3.0", "program", "", "3"), ("GPL-2.0", "program", "", "2"), ("LGPL-3.0", "library", "Lesser", "3"), ("LGPL-2.1", "library", "Lesser", "2.1"), ("AGPL-3.0", "program", "Affero", "3"))
_SPDX = {"Apache-2.0": (), "MIT": (), "GPL-3.0": ("-only", "-or-later"), "GPL-2.0": ("-only", "-or-later"), "LGPL-3.0": ("-only", "-or-later"), "LGPL-2.1": ("-only", "-or-later"), "AGPL-3.0": ("-only", "-or-later"), "BSD-3-Clause": (), "BSD-2-Clause": (), "MPL-2.0": (), "CC-BY-4.0": (), "CC-BY-SA-4.0": (), "CC-BY-NC-4.0": (), "CC0-1.0": (), "Unlicense": (), "ISC": ()}
#: What blocks and whole files are compared with, besides TEMPLATES.
BLOCKS = (
    *((n, t) for n, parts in (("MIT", _MIT), ("ISC", _ISC)) for t in (parts[0], " ".join(parts))),
    ("BSD-2-Clause", f"{_BSD[0]} {_BSD[2]}"), ("BSD-3-Clause", " ".join(_BSD)), ("Unlicense", _UNLICENSE), ("Apache-2.0", _APACHE), ("Apache-2.0", f"{_APACHE} {_ASIS}"),
    *((n, text) for n, what, kind, v in _GNU_KINDS for notice in [_GNU.format(what, ":", kind, "", v)] for text in (notice, f"{notice} {_NO_WARRANTY.format(what, kind)}", f"GNU {kind} General Public License version {v}")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *((n, f"SPDX-License-Identifier: {n}{end}") for n, ends in _SPDX.items() for end in ("", *ends)),
)
#: Copyright statements in lower case: they name holders, not licences.
COPYRIGHT = r"(?:copyright[\t-\r ]*(?:\(c\)|\u00a9)?|\(c\)|\u00a9)[\t-\r ]*[0-9]{4}[^.\n]*\.?|all rights reserved\.?"
#: Once a line that holds a term: from its first term to its end.
WITH_TERMS = r"[a-z0-9][^\n]*"
#: Words that say nothing about a text; they are no terms. Numbers are, but are too common to look a text up by.
STOP = (
    "a all also an and any are as at be been but by can could did do does each either even for from had has have he her here his how i if in into is it its itself may me might more most must my no nor not now of off on"
    " once one only or other our out over own same shall she should so some such than that the their them then there these they this those through to too under until up upon us very was we were what when where which while"
    " who whom whose why will with within without would you your"
).split()
LICENCE_NAME = r"(?i)^(un)?licen[sc]es?([.-].*)?$|^copying([.-].*)?$|^notice([.-].*)?$"


def terms_of(text: str) -> list[str]:
    return [t for t in re.findall("[a-z0-9]+", text.lower()) if t not in STOP]


def vectors(templates=TEMPLATES):
    """Rows (template number, licence, term, unit weight), idf by term, and the idf of unknown terms."""
    bags = [Counter(terms_of(t)) for _, t in templates]
    df = Counter(t for b in bags for t in b)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for i, ((name, _), bag) in enumerate(zip(templates, bags)):
        weight = {t: (1 + math.log(n)) * idf[t] for t, n in bag.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        rows += [(i, name, t, w / norm) for t, w in sorted(weight.items())]
    return rows, idf, math.log(1 + len(bags)) + 1


def prefix_terms(rows, threshold: float) -> list[str]:
    """Terms one of which a vector must hold to reach the threshold with some template."""
    out = set()
    for i in {r[0] for r in rows}:
        mine = sorted(((t.isdigit(), -w, t) for k, _, t, w in rows if k == i), reverse=True)
        rest = 0.0
        for _, w, t in mine:  # from the last: drop what cannot reach the threshold by itself
            if rest + w * w < threshold * threshold * (1 - 1e-9):
                rest += w * w
            else:
                out.add(t)
    return sorted(out)


def may_reach(idf: dict[str, float], unknown: float, threshold: float):
    """Whether a part's known terms may outweigh its unknown ones enough for the threshold: a bound within the row.

    The cosine squared is at most K / (K + U), with K and U the squared weights of known and unknown terms. Of a term held
    t times, (1 + ln t)^2 <= 1.5 t bounds its part of K, and 1 its part of U from below."""
    known = F.size(F.filter("terms", lambda t: t.isin(sorted(idf)))) * F.lit(1.5 * max(idf.values()) ** 2 * (1 + 1e-9))
    strange = F.size(F.array_except("terms", F.array(*[F.lit(t) for t in ("", *STOP, *sorted(idf))]))) * F.lit(unknown * unknown)
    return known >= threshold * threshold * (known + strange)


def _literals(spark, rows, columns: str) -> DataFrame:
    return spark.sql("select * from values " + ", ".join(rows) + f" as t({columns})")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, blocks=BLOCKS) -> DataFrame:
    """A row per path: path, lines (with terms), licensed (lines), license, score, origin (own, inherited, none), license_path."""
    spark = files.sparkSession
    # rows of one path are told apart by their texts; alike rows are one
    held = files.select(F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")).alias("path"), F.xxhash64(F.col(f"`{text_col}`")).alias("copy"), F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text"))
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_NAME)
    cut = lambda text: F.split(text, "[^a-z0-9]+")
    sets = [vectors(templates), vectors((*templates, *blocks))]
    prefixes = [F.array(*[F.lit(t) for t in prefix_terms(rows, threshold)]) for rows, _, _ in sets]

    # only texts that hold a prefix term of any template are looked into; they move once, to where all their parts are judged
    looked = held.where(F.arrays_overlap(cut(F.col("text")), F.array_distinct(F.concat(*prefixes)))).dropDuplicates(["path", "copy"])
    holders = lambda text: text.contains("copyright") | text.contains("(c)") | text.contains("\u00a9") | text.contains("all rights reserved")
    spoken_of = lambda text: cut(F.when(holders(text), F.regexp_replace(text, COPYRIGHT, " ")).otherwise(text))
    size = lambda text: F.regexp_count(text, F.lit(WITH_TERMS))
    part = lambda kind, block, pos, n, terms: F.struct(F.lit(kind).alias("kind"), block.alias("block"), pos.alias("pos"), n.cast("int").alias("size"), terms.alias("terms"))
    none = F.lit(-1)
    # lines without terms part the blocks
    of_block = lambda run, k: F.concat(F.array(part("block", k, none, size(run), spoken_of(run))), F.transform(F.split(run, "\n", -1), lambda line, i: part("line", k, i, F.lit(1), cut(line))))
    parts = F.flatten(F.transform(F.split("text", "\n[^a-z0-9]*\n", -1), of_block))
    whole = F.when(named, F.array(part("file", none, none, size(F.col("text")), spoken_of(F.col("text")))))
    each = looked.select("path", "copy", F.explode(F.concat(parts, F.coalesce(whole, F.slice(parts, 1, 0)))).alias("p")).select("path", "copy", "p.*")
    wide = (F.col("kind") != "line").cast("int")
    reach = [F.arrays_overlap("terms", p) & may_reach(idf, unknown, threshold) for p, (_, idf, unknown) in zip(prefixes, sets)]
    each = each.withColumn("wide", wide).where(F.when(F.col("wide") == 0, reach[0]).otherwise(reach[1])).withColumn("terms", F.filter("terms", lambda t: ~t.isin("", *STOP)))

    # from here on rows stay with their path and copy: every grouping's keys begin with these two
    keys = ["path", "copy", "kind", "block", "pos", "size", "wide"]
    bags = each.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    known = _literals(spark, [f"({i}, '{t}', {w!r}D)" for i, (_, idf, _) in enumerate(sets) for t, w in sorted(idf.items())], "wide, term, idf")
    units = _literals(spark, [f"({i}, {k}, '{n}', '{t}', {w!r}D)" for i, (rows, _, _) in enumerate(sets) for k, n, t, w in rows], "wide, template, license, term, unit")
    strange = F.when(F.col("wide") == 0, F.lit(sets[0][2])).otherwise(F.lit(sets[1][2]))
    weighed = bags.join(F.broadcast(known), ["wide", "term"], "left").withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", strange))
    # of a part: its length, and its weights of known terms, of which there are no more than the templates have
    vector = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "w"))).alias("known"))
    dots = vector.select(*keys, "norm", F.explode("known").alias("k")).select(*keys, "norm", "k.*").join(F.broadcast(units), ["wide", "term"]).groupBy(*keys, "license", "template").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("shared"))
    scored = dots.where("shared > 1").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    best = scored.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("b"))

    # a block speaks for all its lines where it comes nearer than each of them, and a file for all its blocks
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("b")))
    inner = best.groupBy("path", "copy", "block").agg(F.count(F.when(F.col("kind") == "line", 1)).alias("n"), of("line").alias("b"), F.min(F.when(F.col("kind") != "line", F.col("b"))).alias("wb"), F.max(F.when(F.col("kind") != "line", F.col("size"))).alias("size"))
    wins = lambda b, wb: wb.isNotNull() & (b.isNull() | (wb["less"] < b["less"]))
    won = wins(F.col("b"), F.col("wb"))
    judged = inner.select("path", "copy", "block", F.when(won, F.col("size")).otherwise(F.col("n")).alias("n"), F.when(won, F.col("wb")).otherwise(F.col("b")).alias("b"))
    lone = F.col("block") < 0
    outer = judged.groupBy("path", "copy").agg(F.sum(F.when(~lone, F.col("n"))).alias("n"), F.min(F.when(~lone, F.col("b"))).alias("b"), F.min(F.when(lone, F.col("b"))).alias("wb"), F.max(F.when(lone, F.col("n"))).alias("size"))
    by_file = outer.select("path", "copy", F.when(won, F.col("size")).otherwise(F.col("n")).alias("n"), F.when(won, F.col("wb")).otherwise(F.col("b")).alias("b"))
    own = by_file.groupBy("path").agg(F.sum("n").alias("licensed"), F.min("b").alias("b")).select("path", "licensed", F.col("b.license").alias("own"), (-F.col("b.less")).alias("own_score"))
    total = held.select("path", "copy", size(F.col("text")).alias("lines")).groupBy("path", "copy").agg(F.max("lines").alias("lines")).groupBy("path").agg(F.sum("lines").alias("lines"))
    found = materialise(total.join(own, "path", "left").withColumn("directory", F.regexp_replace("path", "/?[^/]*$", "")), "licenses")

    # directories that a licence file speaks for, and the nearest of them at or above each directory
    speaks = found.where(F.col("own").isNotNull() & (named | (2 * F.col("licensed") >= F.col("lines"))))
    spoken = speaks.groupBy("directory").agg(F.min(F.struct((-F.col("own_score")).alias("less"), F.col("own").alias("license"), F.col("path").alias("from"))).alias("v"))
    directories = found.groupBy("directory").agg(F.count(F.lit(1)).alias("n"))
    levels = F.split("directory", "/")
    above = directories.select("directory", F.posexplode(F.transform(F.sequence(F.size(levels), F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(levels, 1, k), "/"))).alias("up", "ancestor"))
    crowded = hot_keys(above.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n")), "ancestor", spark)
    nearest = spread_join(above, spoken.withColumnRenamed("directory", "ancestor"), "ancestor", crowded, ["directory"]).groupBy("directory").agg(F.min(F.struct("up", "v")).alias("n"))
    heir = nearest.select("directory", F.col("n.v.license").alias("inherited"), (-F.col("n.v.less")).alias("inherited_score"), F.col("n.v.from").alias("from"))
    # a directory may hold a third of all files
    out = spread_join(found, heir, "directory", hot_keys(directories, "directory", spark), ["path"], "left")
    return out.select(
        "path",
        F.col("lines").cast("bigint").alias("lines"),
        F.coalesce("licensed", F.lit(0)).cast("bigint").alias("licensed"),
        F.coalesce("own", "inherited").alias("license"),
        F.coalesce("own_score", "inherited_score").alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("from")).alias("license_path"),
    )


def oracle_sql(files: str, first: str, threshold: float = THRESHOLD, templates=TEMPLATES, blocks=BLOCKS) -> str:
    """The scan of distinct paths as DuckDB SQL; files selects path and text, first is one more output column."""
    sets = [vectors(templates), vectors((*templates, *blocks))]
    known = ", ".join(f"({i}, '{t}', cast({w!r} as double))" for i, (_, idf, _) in enumerate(sets) for t, w in sorted(idf.items()))
    units = ", ".join(f"({i}, {k}, '{n}', '{t}', cast({w!r} as double))" for i, (rows, _, _) in enumerate(sets) for k, n, t, w in rows)
    copyright = COPYRIGHT.replace(r"\u00a9", r"\x{a9}")
    name = "regexp_matches(split_part(path, '/', -1), '" + LICENCE_NAME + "')"
    outspoken = "case when wb is not null and (b is null or wb.less < b.less) then {0} else {1} end"
    return f"""
with files as ({files}),
known(wide, term, idf) as (values {known}),
units(wide, template, license, term, unit) as (values {units}),
low as materialized (select path, lower(coalesce(text, '')) as text from files),
runs as (select path, unnest(r) as run, generate_subscripts(r, 1) as block from (select path, string_split_regex(text, '\n[^a-z0-9]*\n') as r from low)),
parts as materialized (
  select path, 'line' as kind, block, generate_subscripts(string_split(run, chr(10)), 1) as pos, 1 as size, 0 as wide, unnest(string_split(run, chr(10))) as part from runs
  union all
  select path, 'block', block, -1, len(list_filter(string_split(run, chr(10)), lambda x: regexp_matches(x, '[a-z0-9]'))), 1, regexp_replace(run, '{copyright}', ' ', 'g') from runs
  union all
  select path, 'file', -1, -1, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[a-z0-9]'))), 1, regexp_replace(text, '{copyright}', ' ', 'g') from low where {name}),
terms as (select * from (select * exclude (part), unnest(regexp_extract_all(part, '[a-z0-9]+')) as term from parts) where term not in ({", ".join(f"'{t}'" for t in STOP)})),
bags as materialized (select *, count(*) as tf from terms group by all),
weighed as (select b.*, (1 + ln(tf)) * coalesce(idf, case when b.wide = 0 then {sets[0][2]!r} else {sets[1][2]!r} end) as w from bags b left join known k on b.wide = k.wide and b.term = k.term),
norms as (select path, kind, block, pos, size, sqrt(sum(w * w)) as norm from weighed group by all),
dots as (select path, kind, block, pos, size, license, template, sum(w * unit) as dot from weighed w join units u on w.wide = u.wide and w.term = u.term group by all having count(*) > 1),
scored as (select d.* exclude (dot), round(dot / norm, 6) as score from dots d join norms using (path, kind, block, pos, size) where round(dot / norm, 6) >= {threshold}),
best as (select path, kind, block, pos, size, min({{'less': -score, 'license': license}}) as b from scored group by all),
inner_ as (
  select path, block, count(*) filter (kind = 'line') as n, min(b) filter (kind = 'line') as b, min(b) filter (kind <> 'line') as wb, max(size) filter (kind <> 'line') as size from best group by path, block),
judged as (select path, block, {outspoken.format('size', 'n')} as n, {outspoken.format('wb', 'b')} as b from inner_),
outer_ as (select path, sum(n) filter (block >= 0) as n, min(b) filter (block >= 0) as b, min(b) filter (block < 0) as wb, max(n) filter (block < 0) as size from judged group by path),
own as (select path, {outspoken.format('size', 'n')} as licensed, ({outspoken.format('wb', 'b')}).license as license, -({outspoken.format('wb', 'b')}).less as score from outer_),
total as (select path, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[a-z0-9]'))) as lines from low),
found as (
  select t.path, t.lines, coalesce(o.licensed, 0) as licensed, o.license, o.score, regexp_replace(t.path, '/?[^/]*$', '') as directory
  from total t left join own o using (path)),
speaks as (select * from found where license is not null and (2 * licensed >= lines or {name})),
spoken as (select * from (select *, row_number() over (partition by directory order by score desc, license, path) as k from speaks) where k = 1),
heirs as (
  select f.path, s.license, s.score, s.path as license_path, row_number() over (partition by f.path order by length(s.directory) desc) as k
  from found f join spoken s on f.directory = s.directory or s.directory = '' or starts_with(f.directory, s.directory || '/'))
select {first}, f.path, cast(f.lines as bigint) as lines, cast(f.licensed as bigint) as licensed, coalesce(f.license, h.license) as license, coalesce(f.score, h.score) as score,
  case when f.license is not null then 'own' when h.license is not null then 'inherited' else 'none' end as origin,
  case when f.license is not null then f.path else h.license_path end as license_path
from found f left join heirs h on f.path = h.path and h.k = 1"""
