"""Tokens, adjacent pairs, previews and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """The text in lower case, cut at each single space. Adjacent spaces give empty tokens."""
    return F.split(F.lower(text), " ")


def bigrams(text: Column) -> Column:
    """Pairs of adjacent tokens, joined by a space; none for a text of one token."""
    t = tokens(text)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def preview(counts: Column, most: int = 10) -> Column:
    """The first entries of a list of counts as text, with dots if there are more."""
    shown = F.array_join(F.transform(F.slice(counts, 1, most), lambda c: F.concat(c["k"].cast("string"), F.lit(":"), c["n"].cast("string"))), " ")
    return F.concat(shown, F.when(F.size(counts) > most, F.lit(" ...")).otherwise(F.lit("")))


def list_hash(counts: Column) -> Column:
    """A rolling hash of a list of (k, n) that depends on its order: 31 times what came before plus k and n, in 31 bits."""

    def step(h: Column, c: Column) -> Column:
        return F.pmod((h * 31 + F.pmod(c["k"], F.lit(1 << 31))) * 31 + F.pmod(c["n"], F.lit(1 << 31)), F.lit(1 << 31))

    return F.aggregate(counts, F.lit(17).cast("long"), step)
