"""Order statistics of what was added so far, by weighted ranks.

Amounts are ranked once, and the ranks' bits, the highest first, split the additions into two lists again and again, each in the order of time. A
list keeps running sums of its weights, so the k-th amount among the additions before a row is found by one look-up a bit,
whatever the weights: an amount that was added a thousand million times costs as much as one that was added once. All look-ups of
all keys that a task holds go through the bits together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .asof import Running, running

#: Rows that a task looks up at once, at least; a key's rows stay together.
TOGETHER = 1 << 18
#: Quantiles at which the additions of a large key are split at once; each is a part of its own, and so is what lies between two.
QUANTILES = 15
FAN = 2 * QUANTILES + 1


def kth(values: np.ndarray, weights: np.ndarray, first: np.ndarray, upto: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each query the k-th smallest (from 1) of values[first:upto], each counted weights times. k must not exceed their sum."""
    known, rank = np.unique(values, return_inverse=True)
    low, high, k = first.copy(), upto.copy(), k.copy()
    found = np.zeros(len(k), np.int64)
    for bit in range(max(0, len(known) - 1).bit_length() - 1, -1, -1):
        zero = (rank >> bit) & 1 == 0
        place = np.concatenate([[0], np.cumsum(zero)])
        total = np.concatenate([[0], np.cumsum(np.where(zero, weights, 0))])
        under = total[high] - total[low]
        left, n = k <= under, place[-1]
        k = np.where(left, k, k - under)
        found |= np.where(left, 0, 1 << bit)
        low, high = np.where(left, place[low], n + low - place[low]), np.where(left, place[high], n + high - place[high])
        order = np.argsort(~zero, kind="stable")
        rank, weights = rank[order], weights[order]
    return known[found] if len(known) else found


def medians(key: np.ndarray, value: np.ndarray, weight: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, any) of each row that asks: the two middle amounts added before it under its key, and whether there are any.

    Rows stand by key (numbered in ascending order), then in time; those that don't ask add value, weight times.
    """
    add = ~asks
    before = np.concatenate([[0], np.cumsum(add)])[:-1]
    first = before[np.searchsorted(key, key)]
    values, weights = value[add], weight[add]
    total = np.concatenate([[0], np.cumsum(weights)])
    a, b = first[asks], before[asks]
    n = total[b] - total[a]
    some = n > 0
    out = [np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)]
    for side, k in zip(out, ((n + 1) // 2, n // 2 + 1)):
        side[some] = kth(values, weights, a[some], b[some], k[some])
    return out[0], out[1], some


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches that are sorted by their first column, put together to tables that hold all rows of the keys in them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(0).combine_chunks()
            key = keys.dictionary_encode().indices.to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # codes of sorted keys grow
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _codes(table: pa.Table) -> np.ndarray:
    return table.column(0).combine_chunks().dictionary_encode().indices.to_numpy()


ASK = ["job_id", "funding_block", "log_index"]


def _run_medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _by_key(batches):
        asks = t.column("late").to_numpy() == 0
        value, weight = (t.column(c).fill_null(0).to_numpy() for c in ("budget", "n"))
        low, high, some = medians(_codes(t), value, weight, asks)
        at = t.filter(pa.array(asks))
        yield pa.RecordBatch.from_arrays([*(at.column(c).combine_chunks() for c in ("job_id", "block", "log_index")), pa.array((low + high) / 2, mask=~some)], [*ASK, "median"])


def _run_kth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _by_key(batches):
        asks = t.column("late").to_numpy() == 0
        key, add = _codes(t), ~asks
        value, weight, k = (t.column(c).fill_null(0).to_numpy() for c in ("budget", "n", "k"))
        before = np.concatenate([[0], np.cumsum(add)])[:-1]
        first = before[np.searchsorted(key, key)]
        at = t.filter(pa.array(asks))
        found = kth(value[add], weight[add], first[asks], before[asks], k[asks])
        yield pa.RecordBatch.from_arrays([*(at.column(c).combine_chunks() for c in ("job_id", "block", "log_index")), pa.array(found)], [*ASK, "amount"])


ROW = "job_id long, funding_block long, log_index long"


def small_medians(rows: DataFrame) -> DataFrame:
    """ASK and median of each row that asks (late = 0), the rows of a key passing through one task.

    rows: key, block, late, job_id, log_index, budget and n; a row with late = 1 adds its budget n times for blocks after its own.
    """
    dealt = rows.select("key", "block", "late", "job_id", "log_index", "budget", "n").repartition("key").sortWithinPartitions("key", "block", "late", "log_index")
    return dealt.mapInArrow(_run_medians, f"{ROW}, median double")


def split(rows: DataFrame) -> DataFrame:
    """Rows of large keys, dealt to keys of a part of the amounts each: additions by amount, questions (k, a place) to the part that holds their place.

    Parts are approximate quantiles of a key's amounts, each alone, and what lies between them: so a frequent amount has a part
    of its own, and every other part holds about 1 / QUANTILES of the additions at most. One running pass counts, for each question, what was added
    before it to each part, so that no question meets the additions themselves.
    """
    share = [j / (QUANTILES + 1) for j in range(1, QUANTILES + 1)]
    bounds = rows.where("late = 1").groupBy("key").agg(F.percentile_approx("budget", share, 1_000).alias("_q"))
    # a part holds the values above the bound before it, up to its own
    bounds = bounds.select("key", F.array_sort(F.array_distinct(F.flatten(F.transform("_q", lambda q: F.array(q - 1, q))))).alias("_bounds"))
    rows = rows.join(bounds, "key").withColumn("_part", F.when(F.col("late") == 1, F.size(F.filter("_bounds", lambda b: b < F.col("budget"))))).drop("_bounds")
    measures = [Running(f"_u{j}", F.when(F.col("_part") <= j, F.col("n")).otherwise(0)) for j in range(FAN)]
    counted = running(rows, ["key"], "block", measures)
    # what was added before to the parts up to each; stored, so that the array isn't made anew wherever it is read
    upto = F.array(F.lit(0).cast("long"), *[F.col(f"_u{j}").cast("long") for j in range(FAN)])
    asked = staged(counted.where("late = 0").select("key", "block", "late", "job_id", "log_index", "budget", "n", "k", upto.alias("_upto"))).where(F.col("_upto")[FAN] > 0)
    middle = F.array(*[F.expr(x.format(FAN)) for x in ("(_upto[{}] + 1) div 2", "_upto[{}] div 2 + 1")])
    asked = asked.withColumn("k", F.explode(F.when(F.col("k").isNotNull(), F.array("k")).otherwise(middle)))
    asked = asked.withColumn("_part", F.size(F.filter("_upto", lambda u: u < F.col("k"))) - 1).withColumn("k", F.col("k") - F.col("_upto")[F.col("_part")])
    own = F.concat_ws("/", "key", "_part").alias("key")
    cols = ["block", "late", "job_id", "log_index", "budget", "n"]
    return rows.where("late = 1").select(own, *cols, "k").unionByName(asked.select(own, *cols, "k"))


def large_medians(rows: DataFrame, size: int) -> DataFrame:
    """As small_medians, for keys of any number of rows; no task takes many more than 2 * ``size`` of them.

    Keys are split by amount until a part has ``size`` additions or a single amount, which then is the answer. Questions of a part are
    dealt in runs of ``size``, and each run gets the part's additions.
    """
    rows, answers = rows.withColumn("k", F.lit(None).cast("long")), []
    while True:
        rows = staged(split(rows))
        parts = rows.groupBy("key").agg(F.count_if(F.col("late") == 1).alias("adds"), F.count_if(F.col("late") == 0).alias("asks"), F.min("budget").alias("low"), F.max("budget").alias("high")).where("asks > 0")
        parts = staged(parts)
        one, few = F.col("low") == F.col("high"), F.col("adds") <= size
        answers.append(rows.where("late = 0").join(parts.where(one).select("key", F.col("low").alias("amount")), "key").select("job_id", F.col("block").alias("funding_block"), "log_index", "amount"))
        leaves = parts.where(~one & few).select("key", F.ceil(F.col("asks") / size).alias("runs"))
        runs = rows.join(leaves, "key")
        # the additions go to every run of their part
        to = F.when(F.col("late") == 1, F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).otherwise(F.array(F.pmod(F.xxhash64("job_id", "block", "log_index"), F.col("runs"))))
        runs = runs.withColumn("_run", F.explode(to)).withColumn("key", F.concat_ws(":", "key", "_run"))
        dealt = runs.select("key", "block", "late", "job_id", "log_index", "budget", "n", "k").repartition("key").sortWithinPartitions("key", "block", "late", "log_index")
        answers.append(dealt.mapInArrow(_run_kth, f"{ROW}, amount long"))
        more = parts.where(~one & ~few).select("key")
        if more.isEmpty():
            break
        rows = rows.join(more, "key")
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    return out.groupBy(*ASK).agg((F.sum("amount") / 2).alias("median"))


def running_medians(rows: DataFrame, size: int) -> DataFrame:
    """ASK and median of all questions: null where nothing was added before; keys with more than ``size`` rows are split."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n_rows"))
    large = counts.where(F.col("n_rows") > size).select("key")
    if large.isEmpty():
        return small_medians(rows)
    out = small_medians(rows.join(large, "key", "left_anti"))
    hot = staged(rows.join(large, "key", "left_semi"))
    asked = hot.where("late = 0").select("job_id", F.col("block").alias("funding_block"), "log_index")
    return out.unionByName(asked.join(large_medians(hot, size), ASK, "left").select(*ASK, "median"))
