"""Hashed and dictionary fingerprints of a text's token n-grams."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corvane.functions.vectors import let, pack_bits, unpack_bits


def tokens(text: Column) -> Column:
    """Lower-case whitespace tokens of the whole text."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def ngrams(words: Column, n: int = 3) -> Column:
    """Distinct runs of ``n`` neighbouring tokens."""

    def runs(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(
            F.expr("cast(array() as array<int>)")
        )
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.element_at(w, i + j) for j in range(n)]))

    return F.array_distinct(let(words, runs))


def bit_positions(grams: Column, n_bits: int = 2048, hasher: str = "xxhash64") -> Column:
    """Distinct bit positions of the n-grams. ``md5`` gives the same bits in any engine, ``xxhash64`` is the fast choice."""
    def spot(g: Column) -> Column:
        if hasher == "md5":
            return F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("bigint") % n_bits
        return F.pmod(F.xxhash64(g), F.lit(n_bits).cast("bigint"))

    return F.array_distinct(F.transform(grams, spot))


def hashed_fingerprint(text: Column, n_bits: int = 2048, n: int = 3, hasher: str = "xxhash64") -> Column:
    """Packed words. Row-local: no explode and no shuffle."""
    return pack_bits(bit_positions(ngrams(tokens(text), n), n_bits, hasher), n_bits)


def narrower(fp: Column, n_bits: int) -> Column:
    """The fingerprint of ``n_bits``, a divisor of the width of ``fp``, from its bits alone: nothing is hashed again."""
    spots = F.when(fp.isNotNull(), F.array_distinct(F.transform(unpack_bits(fp), lambda p: p.cast("bigint") % n_bits)))
    return pack_bits(spots, n_bits)


def key_fingerprint(text: Column, patterns: list[str]) -> Column:
    """One 0/1 flag per fixed pattern."""
    return F.array(*[text.rlike(p).cast("int") for p in patterns])
