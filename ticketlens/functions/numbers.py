"""Rounding, number formatting, clamping and order-independent sums."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXACT_INTEGERS = float(2**52)
# A bigint holds four billion whole parts of this size, and trillionths of any number of rows.
_USUAL_BOUND = float(2**31)
_TINY_BOUND = 1e-6
_LARGE_BOUND = 1e24


def fixed(x: Column, digits: int, *, grouped: bool = False) -> Column:
    """Text of ``x`` with exactly ``digits`` decimals, half-even on the binary value."""
    pattern = ("#,##0" if grouped else "0") + ("." + "0" * digits if digits else "")
    return F.call_function("format_number", x, F.lit(pattern))


def thousands(x: Column) -> Column:
    return fixed(x, 0, grouped=True)


def percent(x: Column, digits: int) -> Column:
    return F.concat(fixed(x * F.lit(100.0), digits), F.lit("%"))


def round_exact(x: Column, digits: int) -> Column:
    """Round half-even on the exact binary value.

    Spark's ``round`` works on the shortest decimal text (2.675 gives 2.68); the
    formatted value does not. Doubles from 2**52 on hold no decimals to round.
    """
    rounded = fixed(x, digits).try_cast("double")
    return F.when(F.abs(x) < F.lit(_EXACT_INTEGERS), rounded).otherwise(x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, 0 where ``whole`` is 0."""
    whole_d = whole.cast("double")
    return F.when(whole_d != 0, part.cast("double") / whole_d).otherwise(F.lit(0.0))


# Exact sums ---------------------------------------------------------------
#
# A plain sum of doubles depends on the order in which partitions arrive, so its
# last bits change between runs. Each usual value is cut into whole units, millionths
# and trillionths, which are added as bigint: the order no longer matters, the
# buffers stay primitive (no decimal objects per row), and partial sums may be
# added up again at a coarser grouping. Values that such parts would cut or overflow are added as
# decimals instead: small ones with 30 decimals, large ones with 6. Only beyond 10**24, and for infinities, is
# the sum one of doubles.

def limb_columns(x: Column, prefix: str) -> list[Column]:
    size = F.abs(x)
    usual = F.when((size <= F.lit(_USUAL_BOUND)) & ((size >= F.lit(_TINY_BOUND)) | (x == 0)), x)
    whole = F.floor(usual)
    millionths = (usual - whole) * F.lit(1e6)
    full_millionths = F.floor(millionths)
    trillionths = F.rint((millionths - full_millionths) * F.lit(1e6)).cast("bigint")
    tiny = F.when((size < F.lit(_TINY_BOUND)) & (x != 0), x.cast("decimal(38,30)"))
    large = F.when((size > F.lit(_USUAL_BOUND)) & (size <= F.lit(_LARGE_BOUND)), x.cast("decimal(38,6)"))
    huge = F.when((size > F.lit(_LARGE_BOUND)) | F.isnan(x), x)
    return [
        F.sum(whole).alias(f"{prefix}_whole"),
        F.sum(full_millionths).alias(f"{prefix}_micro"),
        F.sum(trillionths).alias(f"{prefix}_pico"),
        F.sum(tiny).alias(f"{prefix}_tiny"),
        F.sum(large).alias(f"{prefix}_large"),
        F.sum(huge).alias(f"{prefix}_huge"),
    ]


def limb_resums(prefix: str) -> list[Column]:
    """Aggregates that add already summed limbs up once more."""
    names = [f"{prefix}_{part}" for part in ("whole", "micro", "pico", "tiny", "large", "huge")]
    return [F.sum(name).alias(name) for name in names]


def limb_total(prefix: str) -> Column:
    def scaled(part: str, unit: str) -> Column:
        return F.col(f"{prefix}_{part}").cast("decimal(20,0)") * F.lit(Decimal(unit))

    usual = (
        F.col(f"{prefix}_whole").cast("decimal(20,0)")
        + scaled("micro", "0.000001")
        + scaled("pico", "0.000000000001")
    ).cast("double")
    parts = [usual, *(F.col(f"{prefix}_{part}").cast("double") for part in ("tiny", "large", "huge"))]
    # Adding them in this order depends on their values only; a group without any value has no sum.
    total = reduce(lambda a, b: a + b, (F.coalesce(part, F.lit(0.0)) for part in parts))
    return F.when(F.coalesce(*parts).isNotNull(), total)
