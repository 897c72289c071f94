"""Unsigned integers of 256 bits in built-in columns: arrays of eight limbs of 32 bits, the highest first.

Arrays of one length compare by their limbs in turn, so orders, minima and maxima of limbs are those of the numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .decode import bare

LIMBS, BITS = 8, 32
#: Groups of nine decimal digits that hold a sum of 2 ** 31 numbers.
GROUPS, GROUP = 10, 10**9


def limbs(text: Column) -> Column:
    """A hex number of at most 64 digits, with or without 0x; null if it isn't one."""
    digits = bare(text)
    wide = F.lpad(digits, 64, "0")
    fits = (digits != "") & (F.length(digits) <= 64) & F.unhex(wide).isNotNull()
    return F.when(fits, F.array(*[F.conv(F.substring(wide, 8 * i + 1, 8), 16, 10).cast("long") for i in range(LIMBS)]))


def carried(numbers: Column) -> Column:
    """Limbs that additions have filled, with what is above 32 bits carried to the limb before; the highest keeps its own."""
    none = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("carry"))
    low = lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1))
    step = lambda a, x: F.struct(F.concat(F.array(low(x + a["carry"])), a["out"]).alias("out"), F.shiftright(x + a["carry"], BITS).alias("carry"))
    high = lambda s: F.transform(s["out"], lambda x, i: F.when(i == 0, x + F.call_function("shiftleft", s["carry"], F.lit(BITS))).otherwise(x))
    return F.when(numbers.isNotNull(), F.aggregate(F.reverse(numbers), none, step, high))


def add(a: Column, b: Column) -> Column:
    return carried(F.zip_with(a, b, lambda x, y: x + y))


def total(column: str) -> Column:
    """Aggregate: the sum of up to 2 ** 31 numbers; null for none."""
    return carried(F.when(F.count(column) > 0, F.array(*[F.sum(F.col(column)[i]) for i in range(LIMBS)])))


def decimal(numbers: Column) -> Column:
    """The number in decimal digits."""
    def step(groups: Column, limb: Column) -> Column:
        none = F.struct(F.array().cast("array<bigint>").alias("out"), limb.alias("carry"))

        def each(a: Column, g: Column) -> Column:
            whole = g * (1 << BITS) + a["carry"]
            return F.struct(F.concat(a["out"], F.array(whole % GROUP)).alias("out"), F.call_function("div", whole, F.lit(GROUP)).alias("carry"))

        return F.aggregate(groups, none, each)["out"]

    groups = F.aggregate(numbers, F.array_repeat(F.lit(0).cast("long"), GROUPS), step)
    text = F.array_join(F.transform(F.reverse(groups), lambda g: F.lpad(g.cast("string"), 9, "0")), "")
    return F.when(numbers.isNotNull(), F.regexp_replace(text, "^0+(?=.)", ""))
