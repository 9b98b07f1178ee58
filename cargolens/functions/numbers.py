"""Rounding, number formats and key hashes as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Multiplicative hash, known to every SQL engine as integer arithmetic.
HASH_MULTIPLIER = 2654435761
HASH_RANGE = 4294967296
HASH_INPUT_RANGE = 2147483648


def scaled_round(x: Column, digits: int) -> Column:
    """Scale, round half to even, scale back (the rounding of numeric array libraries)."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def exact_round(x: Column, digits: int) -> Column:
    """Round the binary value of ``x`` half to even, without error from the scaling.

    ``x * scale`` may land on a tie the true product is not on. The rounding
    error of that product, found by splitting ``x`` into two short halves, says
    to which side of the tie the true product lies.
    """
    scale = F.lit(float(10**digits))

    def rounded(v: Column) -> Column:
        product = v * scale
        split = v * F.lit(134217729.0)
        high = split - (split - v)
        error = (high * scale - product) + (v - high) * scale
        down = F.floor(product).cast("double")
        on_tie = (product - down) == F.lit(0.5)
        return (
            F.when(on_tie & (error > 0), down + 1.0)
            .when(on_tie & (error < 0), down)
            .otherwise(F.rint(product))
        ) / scale

    # As a lambda argument the input is computed once, however often it is read.
    return F.transform(F.array(x.cast("double")), rounded)[0]


def whole_text(x: Column) -> Column:
    """``12.5`` → ``12``: no decimals, ties to even."""
    return F.rint(x).cast("bigint").cast("string")


def tenth_text(x: Column) -> Column:
    """``12.345`` → ``12.3``."""
    return F.format_string("%.1f", exact_round(x, 1))


def hundredth_text(x: Column) -> Column:
    """``12.345`` → ``12.35`` or ``12.34``, whichever is nearer to the binary value."""
    return F.format_string("%.2f", exact_round(x, 2))


def signed_tenth_text(x: Column) -> Column:
    """``2.04`` → ``+2.0``; the sign is that of the unrounded value."""
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("+")), tenth_text(F.abs(x)))


def currency_text(x: Column) -> Column:
    """``1234.5`` → ``$1,234``."""
    return F.concat(F.lit("$"), F.format_number(F.rint(x), 0))


def percent_text(x: Column, already_fraction: bool = True) -> Column:
    """``0.1234`` → ``12.3%``."""
    return F.concat(tenth_text(x * 100.0 if already_fraction else x), F.lit("%"))


def spread(key: Column) -> Column:
    """Map an integer key evenly over [0, 2^32); distinct keys below 2^31 stay distinct."""
    bounded = F.pmod(key.cast("bigint"), F.lit(HASH_INPUT_RANGE))
    return F.pmod(bounded * F.lit(HASH_MULTIPLIER), F.lit(HASH_RANGE))


def spread_key(df: DataFrame, column: str) -> Column:
    """``spread`` for integer columns, a 32-bit checksum for all others."""
    if dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint"):
        return spread(F.col(column))
    return F.crc32(F.col(column).cast("string"))
