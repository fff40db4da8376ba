"""License scan by canonical digest lookup, on DataFrame functions only.

A text's canonical form is lower case, without copyright lines, with one spelling of each equivalent pair, and with
every run of other characters than letters and digits as one space. Its SHA-256 joins the digests of known licence
texts and notices. Texts are looked up whole; their lines are looked up by themselves as well, by the same join: the
lines' digests, a row each and known by the digest of the text they stand in, meet the known ones, and what was found
goes back to the texts. Only texts that could hold a notice are shuffled for that, and only once each.

The known list is broadcast up to BROADCAST_DIGESTS digests; a larger one is joined by a shuffle, with equal results.

Defined cases: a null text is empty; an empty canonical form has no licence; repeated lines count each time; equal
known digests give the smallest licence name; rows, ids and further columns are kept as they are, but for columns named
license_digest, license and notices, which the result's replace. Row-local but for the joins on digests.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from helixmill.llm.common import fresh

#: Known digests up to this number (some hundred bytes each) are broadcast.
BROADCAST_DIGESTS = 100_000
#: Full texts of licences, one to a file under its name (fixed values; public texts).
TEXTS = Path(__file__).parent / "licenses"

#: Known notices and short licence texts (fixed values; public texts).
KNOWN = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    ],
}

#: Notices that name a licence by its identifier.
NOTICES = ("SPDX-License-Identifier: {}", "Licensed under {}.", "Released under {}.", "License: {}")

#: Equivalent spellings, first form kept out (fixed values).
SPELLINGS = (("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("authorise", "authorize"), ("favour", "favor"), ("fulfil", "fulfill"), ("merchantibility", "merchantability"), ("whilst", "while"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"))

#: Likewise within words (licences, sublicencing).
STEMS = (("licenc", "licens"),)

COPYRIGHT_LINE = r"(?im)^[^\S\n]*(?:(?:copyright\b|©|\(c\))[^\n]*(?:[0-9]{4}|©|\(c\))[^\n]*|all rights reserved\.?[^\S\n]*)$"
MAYBE_NOTICE = r"(?i)licen[cs]e|released under|permission|redistribut|warrant|copyright|all rights"


def canonical(text: Column) -> Column:
    """The canonical form; only texts that could hold a copyright line or a spelling pay for looking closer."""
    bare = F.when(text.rlike(r"(?i)copyright|©|\(c\)|all rights"), F.regexp_replace(text, COPYRIGHT_LINE, " ")).otherwise(text)
    plain = F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "))
    for other, kept in STEMS:
        plain = F.replace(plain, F.lit(other), F.lit(kept))
    out = plain
    for other, kept in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{other}\b", kept)
    # one expression tells whether any spelling occurs at all
    return F.when(plain.rlike(r"\b(?:" + "|".join(a for a, _ in SPELLINGS) + r")\b"), out).otherwise(plain)


def digest(text: Column) -> Column:
    c = canonical(F.coalesce(text, F.lit("")))
    return F.when(c != "", F.sha2(c, 256))


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of the built-in list: notices, and the full texts beside this module."""
    full = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    names = sorted({*KNOWN, *(name for name, _ in full)})
    notices = [(name, notice.format(name)) for name in names for notice in NOTICES]
    return [*((name, text) for name, texts in KNOWN.items() for text in texts), *full, *notices]


def known_digests(spark, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(digest, license) of the built-in list, or of another."""
    rows = known_texts() if known is None else [(name, text) for name, texts in known.items() for text in texts]
    return spark.createDataFrame(rows, "license string, text string").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license")).where("digest is not null")


NOTICES_TYPE = "array<struct<line:int,license:string>>"


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, text: str = "text", maybe: str | None = None) -> DataFrame:
    """docs with `license_digest`, `license` (of the whole text or null) and `notices`: array of (line from 0, license).

    known holds digest and license (known_digests makes it); the built-in list is used without. maybe: a pattern that
    each line found in known has, if there is one; lines without it aren't looked up.
    """
    if known is None:
        known, maybe = known_digests(docs.sparkSession), MAYBE_NOTICE
    small = known.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    held = F.broadcast(known) if small else known
    docs = docs.drop("license_digest", "license", "notices")
    key, at = fresh([*docs.columns, "license_digest", "license", "notices"], "__text", "__key")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.withColumn("license_digest", digest(F.col(f"`{text}`")))
    columns = [*[F.col(f"`{c}`") for c in docs.columns], "license_digest", "license"]
    names = held.select(F.col("digest").alias("license_digest"), "license")
    if small:
        found = found.join(names, "license_digest", "left").select(*columns)
    else:  # rows without a digest stay out of the shuffle
        named = found.where("license_digest is not null").join(names, "license_digest", "left")
        found = named.select(*columns).unionByName(found.where("license_digest is null").withColumn("license", F.lit(None).cast("string")).select(*columns))
    possible = whole.rlike(maybe) if maybe else whole != ""
    own = docs.where(possible).select(F.sha2(whole, 256).alias(key), whole.alias("text"))
    lines = own.dropDuplicates([key]).select(key, F.posexplode(F.split("text", "\n")).alias("line", "of_line"))
    if maybe:
        lines = lines.where(F.col("of_line").rlike(maybe))
    met = lines.select(key, "line", digest(F.col("of_line")).alias("digest")).where("digest is not null").join(held, "digest")
    notices = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "license"))).alias("notices")).withColumnRenamed(key, at)
    without = found.where(~possible).withColumn("notices", F.array().cast(NOTICES_TYPE))
    asked = found.where(possible).withColumn(key, F.sha2(whole, 256))
    looked = asked.join(notices, asked[key] == notices[at], "left").withColumn("notices", F.coalesce("notices", F.array()).cast(NOTICES_TYPE))
    return without.unionByName(looked.drop(key, at))


def license_report(docs: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    out = scan_licenses(docs.select("doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["license"]))), ",")
    return out.select("doc_id", "license_digest", "license", F.size("notices").cast("long").alias("n_notices"), names.alias("notice_licenses"))
