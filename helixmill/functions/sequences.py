"""Text of sequence files: names, cleaning, and a projection of any text to nucleotides."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
NUCLEOTIDES = "".join("acgt"[i % 26 % 4] for i in range(len(LETTERS)))


def clean_sequence(line: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(line, r"\s+", "")


def genome_name(header: Column) -> Column:
    """A header as a name: the `>` stays, commas don't."""
    return F.replace(header, F.lit(","), F.lit(" - "))


def as_dna(text: Column) -> Column:
    """Letters to a, c, g, t by their place in the alphabet; everything else goes."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), LETTERS, NUCLEOTIDES), "[^acgt]+", "")


def csv_field(value: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line break."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[,"\r\n]'), quoted).otherwise(value)
