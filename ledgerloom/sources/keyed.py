"""Keyed tables that live in deltas: each batch writes the keys that it changes, and a read merges what the batches wrote.

Batch n writes run n of level 0. Whenever FANOUT runs of a level are complete, they merge into one run of the next, so a read meets few
runs and each change is written again once a level. Which runs hold batches 0 to n follows from n alone. A run is never
changed afterwards, so every earlier state can still be read, and a batch that runs again replaces its own runs and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 8


def runs(batch: int, fanout: int = FANOUT) -> list[tuple[int, int]]:
    """(level, number) of the runs that together hold batches 0 to ``batch``; run r of level k holds those from r * fanout ** k on."""
    out, at, level = [], 0, 0
    while fanout ** (level + 1) <= batch + 1:
        level += 1
    for k in range(level, -1, -1):
        size = fanout**k
        while batch + 1 - at >= size:
            out.append((k, at // size))
            at += size
    return out


@dataclass(frozen=True)
class Keyed:
    """A table by ``keys``. Columns of ``how`` (sum, min or max) add up; without it the row of the last batch wins, and rows marked
    ``_gone`` end their key. ``until``: a column; rows in which it lies before the time of a read have left the table. It must not
    fall from one row of a key to the next, so that merges can leave out what has left."""

    keys: tuple[str, ...]
    how: dict[str, str] = field(default_factory=dict)
    until: str | None = None

    def merged(self, rows: DataFrame, version: str, now: int | None = None, whole: bool = True) -> DataFrame:
        """One row a key of rows of several batches. whole: rows go back to the first batch, so that ended keys need no mark any more."""
        if self.how:
            agg = {"sum": lambda c: F.sum(c).cast("long"), "min": F.min, "max": F.max}
            return rows.groupBy(*self.keys).agg(*[agg[h](c).alias(c) for c, h in self.how.items()])
        values = [c for c in rows.columns if c not in (*self.keys, version)]
        out = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), F.col(version)).alias("_v")).select(*self.keys, "_v.*")
        if self.until and now is not None:
            out = out.where(F.col(self.until).isNull() | (F.col(self.until) >= now))
        return out.where("not _gone") if whole else out

    def after(self, before: DataFrame | None, delta: DataFrame, now: int | None = None) -> DataFrame:
        """The table of a batch, from the one before and the changes."""
        rows = delta.withColumn("_batch", F.lit(1))
        if before is not None:
            rows = rows.unionByName(before.withColumns({"_batch": F.lit(0)} | ({} if self.how else {"_gone": F.lit(False)})))
        out = self.merged(rows, "_batch", now)
        return out if self.how else out.drop("_gone")

    def write(self, delta: DataFrame, path: str, batch: int, now: int | None = None, fanout: int = FANOUT) -> None:
        """Batch's changes, and the merge of every level that they complete; what has left by ``now`` isn't merged on."""
        spark, level = delta.sparkSession, 1
        delta.sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(f"{path}/level=0/run={batch}")
        while (batch + 1) % fanout**level == 0:
            number = (batch + 1) // fanout**level - 1
            rows = self._runs(spark, path, [(level - 1, number * fanout + k) for k in range(fanout)], fanout)
            self.merged(rows, "_run", now, whole=number == 0).withColumns({} if self.how or number else {"_gone": F.lit(False)}).sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(f"{path}/level={level}/run={number}")
            level += 1

    def _runs(self, spark: SparkSession, path: str, which: list[tuple[int, int]], fanout: int = FANOUT) -> DataFrame:
        """Rows of runs; _run grows with the batches that a run holds."""
        rows = spark.read.option("basePath", path).parquet(*[f"{path}/level={k}/run={r}" for k, r in which])
        return rows.withColumn("_run", (F.col("run") + 1) * F.pow(F.lit(float(fanout)), F.col("level"))).drop("level", "run")

    def read(self, spark: SparkSession, path: str, batch: int, now: int | None = None, fanout: int = FANOUT) -> DataFrame:
        """The table as it was after a batch."""
        out = self.merged(self._runs(spark, path, runs(batch, fanout), fanout), "_run", now)
        return out if self.how else out.drop("_gone")

    @staticmethod
    def superseded(path: str, batch: int, fanout: int = FANOUT) -> list[str]:
        """Runs that no read from ``batch`` on needs, to be deleted once no earlier state is wanted."""
        out = []
        for k, number in runs(batch, fanout):
            for below in range(k):
                size = fanout ** (k - below)
                out += [f"{path}/level={below}/run={r}" for r in range(number * size, (number + 1) * size)]
        return out
