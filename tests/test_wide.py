"""Integers of 256 bits against Python's."""

import random

from pyspark.sql import functions as F

from ledgerloom.functions import wide


def test_wide_integers(spark):
    r = random.Random(1)
    top = (1 << 256) - 1
    numbers = [0, 1, 10**9, 10**77, top, top - 1, 1 << 255, (1 << 64) - 1, 1 << 32, *[r.getrandbits(r.randrange(1, 257)) for _ in range(40)]]
    text = [hex(n) if k % 2 else f"{n:064x}" for k, n in enumerate(numbers)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(text)], "k int, t string").repartition(3).withColumn("n", wide.limbs(F.col("t")))
    assert [int(x.d) for x in df.select("k", wide.decimal(F.col("n")).alias("d")).orderBy("k").collect()] == numbers
    x = df.agg(wide.decimal(wide.total("n")).alias("s"), wide.decimal(F.max("n")).alias("b"), wide.decimal(F.min("n")).alias("a")).first()
    assert (int(x.s), int(x.b), int(x.a)) == (sum(numbers), top, 0)
    assert [numbers[x.k] for x in df.orderBy("n", "k").collect()] == sorted(numbers)
    both = df.select(wide.decimal(wide.add(F.col("n"), wide.limbs(F.lit(hex(top))))).alias("d"), "k").orderBy("k").collect()
    assert [int(x.d) for x in both] == [n + top for n in numbers]
    odd = spark.createDataFrame([(None,), ("",), ("0x",), ("xyz",), ("1" * 65,)], "t string").select(wide.decimal(wide.limbs(F.col("t"))).alias("d"))
    assert [x.d for x in odd.collect()] == [None] * 5
    assert df.where("k < 0").agg(wide.total("n").alias("s")).first().s is None
