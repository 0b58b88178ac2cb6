"""License scans: canonical digests of whole texts, hash-joined to those of known licenses.

A canonical text has no case, no copyright lines, no punctuation, and one spelling of what license matching treats
alike. As an extra, whole lines that speak of a license are looked up the same way among one-line notices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, save

#: Spellings that license matching treats alike.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("licence", "license"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("https", "http"),
)

#: Lines that state who holds the copyright.
COPYRIGHT = r"copyright (\(c\)|©|[0-9]{4})|^\W*(\(c\)|©) ?[0-9]{4}|^\W*copyright\W*$|all rights reserved"
#: Lines that can be a license notice on their own.
NOTICE = r"licen[cs]e|released under|distributed under"
#: Rows of a lookup table that are sent to all executors.
MAX_LOOKUP = 100_000

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_REDISTRIBUTE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"

_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n' + _WARRANTY

#: Texts of short public licenses.
KNOWN_TEXTS = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC),
    ("BSD-2-Clause", _REDISTRIBUTE + _BSD),
    ("BSD-3-Clause", _REDISTRIBUTE + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD),
)

#: Where a system keeps the full texts of common licenses; KNOWN_DIGESTS are those of the files named there.
COMMON_LICENSES = "/usr/share/common-licenses"
#: Canonical digests of long public licenses, by file; of Apache-2.0 also without its appendix.
KNOWN_DIGESTS = (
    ("Apache-2.0", "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25"),
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "8a4692e318e41e8d96d4610f021d16f03ff4485322f3d81c00d2621fdda7b2b1"),
    ("GPL-2.0", "0248b317bc123a7424b6ff9799b9786ffde75241881994270612a604d03836cc"),
    ("GPL-3.0", "335e2e9a39badb7f3faa5b6e393ff8b393f868383be9ddbf866c5821b34f4810"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "010ef3e2d3efceb19d44336a9aba2f54fa650cd537869380f53f4d6acad82b50"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
)

#: Names of licenses in notices.
NOTICE_NAMES = (
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License", "Apache 2.0 License")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "New BSD License", "Modified BSD License")),
    ("CC-BY-4.0", ("CC BY 4.0", "CC BY 4.0 License", "Creative Commons Attribution 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "CC BY-NC 4.0 License", "Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "CC BY-SA 4.0 License", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPL version 2")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL version 3")),
    ("ISC", ("ISC License",)),
    ("LGPL-2.1", ("GNU Lesser General Public License, version 2.1", "LGPL version 2.1")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "LGPL version 3")),
    ("MIT", ("MIT License", "MIT license")),
    ("MPL-2.0", ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0")),
)
_SAID = [f"{what} {how} under{the} " for what in ("", "This work is", "This software is", "This project is", "This document is") for how in ("licensed", "released", "distributed") for the in ("", " the", " the terms of the")]
#: One-line notices: each name in each of the usual phrases.
NOTICES = tuple((license_, phrase.strip() + " " + name) for license_, names in NOTICE_NAMES for name in names for phrase in _SAID)


_MARK = r"\(c\)|©|copyright|all rights reserved"


def _without_copyright(low: Column) -> Column:
    kept = F.array_join(F.filter(F.split(low, "\n", -1), lambda line: ~line.rlike(COPYRIGHT)), "\n")
    return F.when(low.rlike(_MARK), kept).otherwise(low)


def _plain(low: Column) -> Column:
    return F.btrim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))


def _spelt(plain: Column) -> Column:
    alike = reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), SPELLINGS, plain)
    return F.when(plain.rlike("|".join(a for a, _ in SPELLINGS)), alike).otherwise(plain)


def _sha(canonical: Column) -> Column:
    return F.when(canonical != "", F.sha2(canonical.cast("binary"), 256))


def digest_of(text: Column) -> Column:
    """SHA-256 of the canonical text, for short texts: lower case, without copyright lines, runs of other characters
    than letters and digits as one space, equivalent spellings alike. Null where nothing is left to compare."""
    return _sha(_spelt(_plain(_without_copyright(F.lower(F.coalesce(text, F.lit("")))))))


def with_digest(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with digest_of(text) as column `name`; one step after the other, so that no step is computed twice."""
    own = fresh(df, "canonical")
    out = df.withColumn(own, F.lower(F.coalesce(text, F.lit(""))))
    for step in (_without_copyright, _plain, _spelt):
        out = out.withColumn(own, step(F.col(own)))
    return out.withColumn(name, _sha(F.col(own))).drop(own)


def digests(texts: DataFrame) -> DataFrame:
    """(license, digest) of a table (license, text), one row for each digest."""
    rows = with_digest(texts.select("license", "text"), F.col("text"), "digest").where("digest is not null")
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def known_digests(spark: SparkSession) -> DataFrame:
    """(license, digest) of the licenses known here; a caller may pass a table of its own, made by digests()."""
    texts = digests(spark.createDataFrame(list(KNOWN_TEXTS), "license string, text string"))
    return texts.select("license", "digest").unionByName(spark.createDataFrame(list(KNOWN_DIGESTS), "license string, digest string")).dropDuplicates(["digest"])


def known_notices(spark: SparkSession) -> DataFrame:
    """(license, digest) of one-line notices."""
    return digests(spark.createDataFrame(list(NOTICES), "license string, text string"))


def scan(docs: DataFrame, known: DataFrame | None = None, notices: DataFrame | None = None, *, text_col: str = "text", max_lookup: int = MAX_LOOKUP) -> DataFrame:
    """docs with three more columns: digest, license (of the whole text, or null), notices (licenses of whole lines, sorted, distinct).

    Null, empty and wordless texts have neither. Each row is looked up for itself, so repeated rows and ids all
    stay. `known` and `notices` (license, digest) must have distinct digests. known is joined by digest, sent to all
    executors if it has at most max_lookup rows, which is counted. So many notices are one map, as the lines of a text
    are then looked up where the text is; more are joined by the lines' digests.
    """
    spark = docs.sparkSession
    known = known_digests(spark) if known is None else known
    notices = known_notices(spark) if notices is None else notices
    digest, license_, found, table = (fresh(docs, x) for x in ("digest", "license", "notices", "table"))
    side = known.select(F.col("digest").alias("_known"), F.col("license").alias(license_))
    side = F.broadcast(side) if known.count() <= max_lookup else side
    out = with_digest(docs, F.col(text_col), digest)
    out = out.join(side, out[digest] == F.col("_known"), "left").drop("_known")
    said = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: F.lower(x).rlike(NOTICE))
    marked = F.filter(F.transform(said, digest_of), lambda d: d.isNotNull())
    if notices.count() <= max_lookup:
        out = out.withColumn(table, notices.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license")))).scalar())
        licenses = F.filter(F.transform(marked, lambda d: F.try_element_at(F.col(table), d)), lambda x: x.isNotNull())
        out = out.withColumn(found, F.array_sort(F.array_distinct(licenses)))
    else:  # rows are numbered once, in the saved table, as ids may repeat or be null
        row = fresh(docs, "row")
        out = save(out.withColumn(row, F.monotonically_increasing_id()), "scanned")
        lines = out.select(F.col(row).alias("_row"), F.explode(F.array_distinct(marked)).alias("_line"))
        told = lines.join(notices.select(F.col("digest").alias("_line"), F.col("license").alias("_license")), "_line")
        told = told.groupBy("_row").agg(F.array_sort(F.collect_set("_license")).alias("_told"))  # of one text each
        out = out.join(told, out[row] == F.col("_row"), "left").withColumn(found, F.coalesce("_told", F.array().cast("array<string>")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], digest, license_, found)


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


def _sql_canonical(text: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    low = f"lower(coalesce({text}, ''))"
    kept = f"array_to_string([x FOR x IN string_split({low}, chr(10)) IF NOT regexp_matches(x, {q(COPYRIGHT)})], chr(10))"
    plain = f"trim(regexp_replace({kept}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
    return reduce(lambda t, s: f"replace({t}, {q(s[0])}, {q(s[1])})", SPELLINGS, plain)


def oracle() -> str:
    rows = lambda pairs: ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in pairs)
    return f"""
WITH texts(license, text) AS (VALUES {rows(KNOWN_TEXTS)}),
fixed(license, digest) AS (VALUES {rows(KNOWN_DIGESTS)}),
phrases(license, text) AS (VALUES {rows(NOTICES)}),
known AS (SELECT digest, min(license) AS license FROM (SELECT sha256({_sql_canonical("text")}) AS digest, license FROM texts UNION ALL SELECT digest, license FROM fixed) GROUP BY digest),
short AS (SELECT sha256({_sql_canonical("text")}) AS digest, min(license) AS license FROM phrases GROUP BY 1),
plain AS (SELECT doc_id, text, {_sql_canonical("text")} AS c FROM documents),
whole AS (SELECT doc_id, text, CASE WHEN c <> '' THEN sha256(c) END AS digest FROM plain),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
marked AS (SELECT doc_id, sha256({_sql_canonical("line")}) AS digest FROM lines WHERE regexp_matches(lower(line), '{NOTICE}')),
notices AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM
            (SELECT DISTINCT m.doc_id, k.license FROM marked m JOIN short k ON m.digest = k.digest) GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN notices n ON w.doc_id = n.doc_id
"""
