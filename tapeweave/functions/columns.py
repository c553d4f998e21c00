"""Column functions: intervals, quantile conventions, amounts and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEE, SLIPPAGE, Z = 0.01, 0.02, 1.96


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Score interval of a share, clamped to 0..1; null for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits / n
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    known = n.isNotNull()
    return F.when(known, F.greatest(F.lit(0.0), centre - spread)), F.when(known, F.least(F.lit(1.0), centre + spread))


def nearest_rank(values: Column, q: float) -> Column:
    """Of a collected array: the element at round-half-even(q * (n - 1)); nulls left out; null for none."""
    known = F.sort_array(F.array_compact(values))
    return F.get(known, F.bround(F.lit(q) * (F.size(known) - 1), 0).cast("int"))


def floor_rank(values: Column, q: float) -> Column:
    """Of a collected array: the element at floor(q * (n - 1))."""
    known = F.sort_array(F.array_compact(values))
    return F.get(known, F.floor(F.lit(q) * (F.size(known) - 1)).cast("int"))


def upper_median(values: Column) -> Column:
    known = F.sort_array(F.array_compact(values))
    return F.get(known, F.floor(F.size(known) / 2).cast("int"))


def exclusive_quantile(values: Column, q: float) -> Column:
    """Of a collected array of n: linear between elements around place q * (n + 1), counted from 1; needs 1 <= place < n."""
    known = F.sort_array(F.array_compact(values))
    place = F.lit(q) * (F.size(known) + 1)
    low = F.floor(place).cast("int")
    return F.get(known, low - 1) + (place - low) * (F.get(known, low) - F.get(known, low - 1))


def count_rank(values: Column, q: float) -> Column:
    """Of a collected array: the element at round-half-even(q * n), the last one at most."""
    known = F.sort_array(F.array_compact(values))
    return F.get(known, F.least(F.size(known) - 1, F.bround(F.lit(q) * F.size(known), 0).cast("int")))


def slice_rank(values: Column, k: int) -> Column:
    """Of a collected array: the element at n div k."""
    known = F.sort_array(F.array_compact(values))
    return F.get(known, F.floor(F.size(known) / k).cast("int"))


def round_trip(price_in: Column, price_out: Column) -> Column:
    """Net return of a purchase and a sale, each with fee and slippage."""
    return price_out * (1 - FEE) * (1 - SLIPPAGE) / (price_in * (1 + FEE) * (1 + SLIPPAGE)) - 1


def units(amount: Column, scale: int = 9) -> Column:
    """An amount as whole units, for exact comparison."""
    return F.round(amount * 10**scale).cast("bigint")


def roundness(amount_units: Column) -> Column:
    """The coarsest decimal that an amount in billionths is a multiple of."""
    out = F.when(amount_units % 1_000_000_000 == 0, "whole")
    for size, name in ((100_000_000, "tenth"), (10_000_000, "hundredth"), (1_000_000, "thousandth")):
        out = out.when(amount_units % size == 0, name)
    return out.otherwise("precise")


def significant_decimals(amount: Column) -> Column:
    return F.length(F.rtrim(F.split(F.format_string("%.9f", amount), "\\.")[1], F.lit("0")))


def significant(x: Column, digits: int) -> Column:
    """x rounded to so many significant digits."""
    return F.format_string(f"%.{digits - 1}e", x).cast("double")


def pseudonym(x: Column, prefix: str = "ID-") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(x.cast("string"), 256), 1, 10))


def rounded_to(amount: Column) -> Column:
    """How many decimals an amount has, up to two, within 1e-9."""
    out = F.when(F.abs(amount - F.round(amount, 0)) < 1e-9, "unit")
    for digits, name in ((1, "one"), (2, "two")):
        out = out.when(F.abs(amount - F.round(amount, digits)) < 1e-9, name)
    return out.otherwise("more")


def zero_bound(hits: Column, n: Column, alpha: float = 0.05) -> Column:
    """The upper bound of a share of which nothing was seen in n trials; null if something was."""
    return F.when(hits == 0, 1 - F.pow(F.lit(alpha), F.lit(1.0) / n))


def is_base58(x: Column, least: int, most: int) -> Column:
    """Whether a text is so many letters of the base-58 alphabet, which leaves out 0, O, I and l."""
    return F.rlike(x, F.lit(f"^[1-9A-HJ-NP-Za-km-z]{{{least},{most}}}$"))


def hmac_sha256(x: Column, key: bytes) -> Column:
    """The keyed hash of a text, in hexadecimal, from two plain ones. Keys are 64 bytes at most."""
    inner, outer = (F.lit(bytes(b ^ pad for b in key.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, x.cast("binary")), 256))), 256)
