"""License scans by canonical digest lookup.

A text is brought to a canonical form: lower case, equivalent spellings of licence terms, no
copyright lines, punctuation as white space, single spaces. Its SHA-256 is hash-joined to the
digests of the known licence texts, brought to the same form. Entire texts are looked up: the whole
text of a row, and each of its lines as a text of its own (notices stand on lines of their own).

Known texts are a table ``license_id, text`` (``default_known``, or the caller's). The default has the
notices of ``KNOWN`` and the full texts and header notices of the files in ``licenses``, with and without
their title lines. Whole texts meet
all of them. Which lines are digested follows from the catalogue: those with one of ``TRIGGERS``, and
those with a word of each known text that holds none (``line_pattern``); where such a text has no
usable word, or there are more than ``MAX_WORDS`` words, all lines are. The table of known digests is
the caller's catalogue; it is broadcast while it has at most ``BROADCAST_ROWS`` rows (checked), beyond
that the join shuffles.

Only DataFrame functions are used.

Edge cases: null text counts as empty and has no licence; repeated rows are looked up each; a text
of copyright lines and punctuation alone has the empty canonical form, which no licence has (a known
text of that form equals nothing); an empty table gives an empty result; columns beyond id and text are not read.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .registry import register

BROADCAST_ROWS = 10_000

# Public licence notices and short licences.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Released under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under the CC0 1.0 Universal license."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
            "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
            "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
            "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
            "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:\n"
            "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software.\n"
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
            "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
            "NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
            "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
            "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)
# Files in ``licenses`` and their ids.
FULL = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2",
        "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0",
        "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
# The header notice inside a full text.
HEADERS = {"Apache-2.0": r"Licensed under the Apache License, Version 2\.0 \(the.*?limitations under the License\.",
           "GPL-1": r"This program is free software;.*?USA\.?", "GPL-2": r"This program is free software;.*?USA\.",
           "GPL-3": r"This program is free software:.*?<https://www\.gnu\.org/licenses/>\.",
           "LGPL-2": r"This library is free software;.*?USA\.?", "LGPL-2.1": r"This library is free software;.*?USA\.?",
           "MPL-2.0": r"This Source Code Form is subject.*?https?://mozilla\.org/MPL/2\.0/\."}
# Title lines of the short licences.
TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"),
          "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"),
          "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License")}
# Most known texts hold one of these, in any case; the rest add a word of their own. An address
# counts, as its scheme goes from the canonical form and may join what stands on both sides.
TRIGGERS = r"(?i)licen[cs]|permission|https?://"
MAX_WORDS = 1_000
# Words that a line holds as they stand in its canonical form: ASCII (without k, the lower case of a sign beyond
# ASCII too), and none that SPELLINGS makes.
PLAIN_WORD = r"[a-jl-z]{4,}"
MADE_WORD = r"version|favor|noninfringement|copyright|holder"
# Spellings that count as equal, in the order of their replacement.
SPELLINGS = (
    (r"licen[cs]e(?=[sd]?\b)", "license"),
    (r"licen[cs]ing", "licensing"),
    (r"licence holder", "copyright holder"),
    (r"\b(version|ver\.?|v\.?) ?(?=[0-9])", "version "),
    (r"\band/or\b", "and or"),
    (r"favour", "favor"),
    (r"non-?infringement", "noninfringement"),
    (r"sub-license", "sublicense"),
    (r"https?://", ""),
)
# Fixed value: a line that states a copyright, and nothing else, is left out.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright\b|\(c\) |©)[^\n]*([12][0-9]{3}|all rights reserved|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    for pattern, instead in SPELLINGS:
        t = F.regexp_replace(t, pattern, instead)
    # letters beyond ASCII are kept; the full stop between digits (2.0) is kept
    t = F.regexp_replace(t, r"(?<![0-9])\.|\.(?![0-9])|[\x00-\x2D\x2F\x3A-\x60\x7B-\x7F“”‘’«»–—…]", " ")
    return F.trim(F.regexp_replace(t, " +", " "))


def known_digests(known: DataFrame) -> DataFrame:
    """``license_id, digest`` of the known texts; one row per digest (the smallest id wins a tie)."""
    return (known.select("license_id", canonical(F.col("text")).alias("text")).filter("text != ''")
            .groupBy(F.sha2("text", 256).alias("digest"))
            .agg(F.min("license_id").alias("license_id")))


def line_pattern(known: DataFrame) -> str:
    """A pattern that every line equal to a known text (in canonical form) holds: ``TRIGGERS``, and the
    longest plain word of each known text without a trigger."""
    t = known.select(canonical(F.col("text")).alias("text")).filter("text != ''").filter(~F.col("text").rlike(TRIGGERS))
    plain = F.filter(F.split("text", " "), lambda w: w.rlike(f"^{PLAIN_WORD}$") & ~w.rlike(MADE_WORD))
    longest = F.array_max(F.transform(plain, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    words = [r["w"] for r in t.select(longest.alias("w")).distinct().limit(MAX_WORDS + 1).collect()]
    if None in words or len(words) > MAX_WORDS:
        return ""
    return "|".join([TRIGGERS, *sorted(words)])


def catalogue() -> list[tuple[str, str]]:
    """Id and text of the known texts: ``KNOWN``, and from the files in ``licenses`` the full texts with and
    without title lines, without an appendix or with its copyright line filled in, and the header notices."""
    read = lambda name: files(__package__).joinpath("licenses", f"{name}.txt").read_text("utf-8")
    out = list(KNOWN)
    for name, license_id in FULL.items():
        text = read(name).strip()
        texts = [text]
        # a title is the lines before the first blank one; CC0 has a second
        for _ in range(2 if name == "CC0-1.0" else 1):
            texts.append(re.split(r"\n[ \t]*\n", texts[-1], maxsplit=1)[1])
        # of the terms alone, and with the line of the appendix where owners put their names
        texts += [t[:t.index(end) + len(end)] for t in texts for end in ["END OF TERMS AND CONDITIONS"] if end in t]
        texts += [t.replace("Copyright [yyyy] [name of copyright owner]", "") for t in texts if "[yyyy]" in t]
        if name in HEADERS:
            texts.append(re.search(HEADERS[name], text, re.S)[0])
        out += [(license_id, t) for t in texts]
    short = [(i, t) for i, t in KNOWN if i in ("MIT", "ISC") and len(t) > 500]
    regents = read("BSD").split("All rights reserved.", 1)[1].strip()
    third = re.search(r"3\. Neither.*?\n(?=THIS|\s*\n)", regents, re.S)[0]
    holder = (regents.replace("the University", "the copyright holder").replace("REGENTS AND", "COPYRIGHT HOLDERS AND")
              .replace("REGENTS OR", "COPYRIGHT HOLDER OR"))
    holder_third = third.replace("the University", "the copyright holder")
    for body, clause in ((regents, third), (holder, holder_third), (holder.replace("HOLDER OR", "HOLDERS OR"), holder_third)):
        short += [("BSD-3-Clause", body), ("BSD-2-Clause", body.replace(clause, ""))]
    # with numbers or without (lists of stars), with the line on rights or without
    short += [(i, re.sub(r"(?m)^[123]\. ", "", t)) for i, t in short if i.startswith("BSD")]
    short += [(i, "All rights reserved.\n" + t) for i, t in short]
    out += short + [(i, f"{title}\n{t}") for i, t in short for title in TITLES[i]]
    return out


def default_known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalogue(), "license_id string, text string")


def scan_licenses(df: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``text_license`` (the whole text is this licence, or null),
    ``line_licenses`` (sorted distinct ids of its lines that are licence texts, comma-joined),
    ``n_license_lines``, ``license_lines`` (line number:id, comma-joined)."""
    digests = known_digests(known)
    if digests.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        digests = F.broadcast(digests)
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = df.select(F.col(id_col).alias("_id"), text.alias("_text"))
    pattern = line_pattern(known)
    has = F.col("_text").rlike(pattern)
    whole = digests.withColumnsRenamed({"digest": "_whole", "license_id": "text_license"})

    def with_whole(x: DataFrame) -> DataFrame:
        return x.withColumn("_whole", F.sha2(canonical(F.col("_text")), 256)).join(whole, "_whole", "left")

    # texts without the pattern have no licence line and need no regrouping of lines
    plain = with_whole(d.filter(~has)).select(
        "_id", "text_license", F.lit("").alias("line_licenses"), F.lit(0).cast("long").alias("n_license_lines"),
        F.lit("").alias("license_lines"))
    lines = F.filter(F.transform(F.split("_text", r"\r\n|\n|\r", -1),
                                 lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))),
                     lambda x: x["text"].rlike(pattern))
    units = (with_whole(d.filter(has).withColumn("_row", F.monotonically_increasing_id()))
             .select("_id", "_row", "text_license", F.explode(lines).alias("u"))
             .select("_id", "_row", "text_license", F.col("u.line").alias("line"),
                     F.sha2(canonical(F.col("u.text")), 256).alias("digest"))
             .join(digests, "digest", "left"))
    found = F.array_sort(F.collect_list(F.when(F.col("license_id").isNotNull(), F.struct("line", "license_id"))))
    lined = units.groupBy("_id", "_row", "text_license").agg(found.alias("f")).select(
        "_id", "text_license",
        F.array_join(F.array_sort(F.array_distinct(F.transform("f", lambda x: x["license_id"]))), ",")
        .alias("line_licenses"),
        F.size("f").cast("long").alias("n_license_lines"),
        F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["line"], x["license_id"])), ",")
        .alias("license_lines"))
    return plain.unionByName(lined).withColumnRenamed("_id", id_col)


@register("op9_license_scan")
def op9_license_scan(spark, sf_dir):
    return scan_licenses(documents(spark, sf_dir), default_known(spark))
