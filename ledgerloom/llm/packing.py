"""Packing into padded batches: optimal length buckets by dynamic programming.

Texts are cut into pieces of at most ``max_words`` words, so the global histogram of lengths has at
most that many entries, whatever the corpus. The driver's dynamic program picks the bucket
boundaries that minimise padding; Spark then numbers the pieces of each bucket and cuts the
numbering into batches within the token budget.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .mixing import sizes

MAX_WORDS, BUCKETS, BUDGET = 2048, 8, 16_384
#: Pieces that one task numbers, on average at most.
SHARD_ROWS = 20_000


def boundaries(counts: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """At most ``buckets`` upper bounds that minimise padding: each length is padded to the next bound.

    best[j] is the least padding of the shortest j lengths; one round per bucket.
    """
    lengths = np.array(sorted(counts), np.float64)
    n = len(lengths)
    if not n:
        return []
    rows = np.array([counts[int(x)] for x in lengths], np.float64)
    many, words = np.concatenate([[0], rows.cumsum()]), np.concatenate([[0], (rows * lengths).cumsum()])
    best, back = np.full(n + 1, np.inf), []
    best[0] = 0
    for _ in range(min(buckets, n)):
        new, choice = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (many[j] - many[:j]) - (words[j] - words[:j])
            choice[j] = int(cost.argmin())
            new[j] = cost[choice[j]]
        best = new
        back.append(choice)
    out, j = [], n
    for choice in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(choice[j])
    return sorted(set(out))


def pack(docs: DataFrame, max_words: int = MAX_WORDS, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Pieces with their batch: doc_id, piece, first_word, n_words, bucket, padded_words, batch, slot.

    Every text gives ceil(words / max_words) pieces, an empty or null one a piece of 0 words; no
    word is dropped. A piece is padded to its bucket's bound; a batch holds
    max(1, budget // padded_words) pieces of one bucket, so only a bucket's last batch can be
    short. Batches count from 0 within their bucket, slots within their batch. Within a bucket the
    order is by shard of a hash of doc_id, text and piece, then by doc_id, piece and text's hash; rows that tie in all
    of them are interchangeable. So rows without doc_id, or of one doc_id, are numbered apart unless their texts are
    equal too. Other columns are ignored; an empty table gives no rows.
    """
    # words are counted once; what follows reads three numbers a document
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), sizes().alias("_n"), F.xxhash64("text").alias("_text")))
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("_n") / max_words) - 1).cast("long"))))
    pieces = pieces.select("doc_id", "piece", "_text", (F.col("piece") * max_words).alias("first_word"), F.least(F.lit(max_words).cast("long"), F.col("_n") - F.col("piece") * max_words).alias("n_words"))
    counts = {r.n_words: r.rows for r in pieces.groupBy("n_words").agg(F.count("*").alias("rows")).collect()}
    bounds = boundaries(counts, buckets) or [0]
    held = [sum(c for n, c in counts.items() if n <= b and (not k or n > bounds[k - 1])) for k, b in enumerate(bounds)]
    shards = [max(1, math.ceil(h / SHARD_ROWS)) for h in held]
    bucket = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_words") <= bounds[k], k).otherwise(bucket)
    look = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)
    placed = pieces.withColumn("bucket", bucket.cast("int")).withColumn("padded_words", look(bounds))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "_text"), look(shards)))
    held_by = placed.groupBy("bucket", "shard").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held_by.select("bucket", "shard", before.alias("offset"))
    at = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "_text")) - 1
    ranked = placed.withColumn("_at", at).join(offsets, ["bucket", "shard"])
    rank, fits = F.col("offset") + F.col("_at"), F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("padded_words"), F.lit(1))))
    return ranked.select("doc_id", "piece", "first_word", "n_words", "bucket", "padded_words", F.floor(rank / fits).alias("batch"), (rank % fits).alias("slot"))
