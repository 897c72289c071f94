"""Scalar functions of predictions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params


# Logarithms and exponentials are those of the C library, as in the SQL. The JVM's differ from them in the last bit now and then, and rules whose
# adjustments are the same number from other counts rank by that bit.
@F.udf(T.DoubleType(), useArrow=True)
def _ln(x: float | None) -> float | None:
    return None if x is None else math.log(x)


@F.udf(T.DoubleType(), useArrow=True)
def _exp(x: float | None) -> float | None:
    return None if x is None else math.inf if x > 709 else math.exp(x)


def logit(p: Column) -> Column:
    inside = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return _ln(F.when(p.isNotNull(), inside / (1 - inside)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + _exp(-x))


def shrunk_rate(completed: Column, funded: Column, base: float = params.BASE_RATE, weight: float = params.BASE_WEIGHT) -> Column:
    """A provider's completion rate, pulled to the base rate by ``weight`` imagined jobs."""
    return (completed + F.lit(base * weight)) / (funded + F.lit(weight))


def bin_of(p: Column) -> Column:
    return F.least(F.floor(p * 10), F.lit(9)).cast("int")


def evidence_weight(age: Column, half_life: int = params.HALF_LIFE, expiry: int = params.EXPIRY) -> Column:
    """1 for new and future evidence, half after each half-life, 0 from expiry on."""
    age = F.greatest(age, F.lit(0))
    return F.when(age >= expiry, F.lit(0.0)).otherwise(F.pow(F.lit(0.5), age / F.lit(float(half_life))))


def reliability(acted: Column, confirmed: Column, prior: float = params.RESPONSE_PRIOR, weight: float = params.RESPONSE_WEIGHT) -> Column:
    """The share of kept promises, pulled to the prior; exactly the prior without evidence."""
    return F.when(F.coalesce(acted, F.lit(0.0)) == 0, F.lit(prior)).otherwise((confirmed + F.lit(weight * prior)) / (acted + F.lit(weight)))
