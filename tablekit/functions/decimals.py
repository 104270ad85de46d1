"""Decimal arithmetic of a chosen scale, and the string hash of Java, by JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import MAX_DIGITS


def divide(a: Column, b: Column, scale: int) -> Column:
    """a / b to ``scale`` digits, cut off toward zero; an error where b is 0, null where one is null.

    Spark's quotient is rounded; where it is farther from zero than the exact one, one unit of the last digit goes. The
    check is a product, so quotients and divisors must fit into 38 digits together.
    """
    kind = f"decimal({MAX_DIGITS},{scale})"
    near = F.when(b == 0, F.raise_error(F.lit("division by zero")).cast(kind)).otherwise((a / b).cast(kind))
    unit = F.lit(f"1e-{scale}").cast(kind)
    return F.when(F.abs(near) * F.abs(b) > F.abs(a), (near - F.signum(near).cast("int") * unit).cast(kind)).otherwise(near)


def divide_by_int(a: Column, b: Column, scale: int) -> Column:
    """A decimal of ``scale`` digits over a whole number, in the same scale."""
    return divide(a, b.cast("decimal(20,0)"), scale)


def java_hash(text: Column) -> Column:
    """The 32-bit string hash of Java (31 times what came before, plus the UTF-16 unit); null stays null."""
    span = 1 << 32

    def step(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("bigint")
        high, low = F.shiftright(code - 65536, 10) + 0xD800, (code - 65536).bitwiseAND(F.lit(1023).cast("bigint")) + 0xDC00
        one = F.pmod(h * 31 + code, F.lit(span))
        two = F.pmod(F.pmod(h * 31 + high, F.lit(span)) * 31 + low, F.lit(span))
        return F.when(code > 65535, two).otherwise(one)

    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("bigint"), step)
    return F.when(h >= span // 2, h - span).otherwise(h).cast("int")
