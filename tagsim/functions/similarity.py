"""Cosine in its three forms, and the score as a percentage. The formula is dot / (sqrt(na) * sqrt(nb)) everywhere, in this order:
another order gives other last bits, and ties would break another way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(dot: Column, na: Column, nb: Column) -> Column:
    """0 if either norm is 0."""
    return F.when((na > 0) & (nb > 0), dot.cast("double") / (F.sqrt(na) * F.sqrt(nb))).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Of two numeric arrays of equal length."""
    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)

    return ratio(total(F.zip_with(a, b, lambda x, y: (x * y).cast("double"))), total(F.transform(a, lambda x: (x * x).cast("double"))), total(F.transform(b, lambda x: (x * x).cast("double"))))


def mask_cosine(a: Column, b: Column) -> Column:
    """Of two tag sets, as bit masks."""
    return ratio(F.bit_count(a.bitwiseAND(b)), F.bit_count(a), F.bit_count(b))


def set_cosine(a: Column, b: Column) -> Column:
    """Of two tag sets, as arrays of tag numbers without repeats."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def word_cosine(a: Column, b: Column) -> Column:
    """Of two tag sets, as masks of several 64-bit words: arrays of (word, bits)."""
    def size(mask: Column) -> Column:
        return F.aggregate(mask, F.lit(0), lambda n, w: n + F.bit_count(w["bits"]))

    def shared(both: Column) -> Column:
        return F.aggregate(both["a"], F.lit(0), lambda n, w: n + F.coalesce(F.bit_count(F.try_element_at(both["b"], w["word"]).bitwiseAND(w["bits"])), F.lit(0)))

    # the map is made once for each pair, not once for each word
    return ratio(F.transform(F.array(F.struct(a.alias("a"), F.map_from_entries(b).alias("b"))), shared)[0], size(a), size(b))


def match_pct(score: Column) -> Column:
    return F.floor(score * 100 + 0.5).cast("int")
