"""Hard negatives by segment summaries.

Each vector is stored with the mean and deviation of its segments. For two segments of n components, n times the product of their
means, plus or minus n times the product of their deviations, bounds their dot product. Sums over a few
wide segments rule most rows out, finer segments rule out more, and only what is left is scored exactly. Anchors meet all rows
in blocks; a block returns its best few rows for each anchor, so no pair of rows is written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_by_size
from .integer_vectors import check_range, exact_products, integer_vectors, largest, matrix

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: Positive scores in percent between which a negative's score must lie.
NEAR, FAR = 100, 80
#: Segments of the levels, coarse to fine; the finest are stored.
LEVELS = (1, 4, 16)
#: Rows of a block at least and at most, blocks that a space should have, and anchors of a block.
BLOCK_LEAST, BLOCK_MOST, BLOCKS, ANCHORS = 256, 16_384, 24, 1_024
#: Pairs that are bounded at once.
STRIP = 1 << 20


def edges(d: int, segments: int) -> np.ndarray:
    """Where the segments of d components begin, and the end."""
    return np.arange(min(d, segments) + 1) * d // min(d, segments)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the mean and deviation of each of their finest segments; vectors of one length go together."""
    for batch in batches:
        size = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
        for d in np.unique(size).tolist():
            part = batch.filter(pa.array(size == d))
            x, at = matrix(part.column("v")).astype(np.float64), edges(d, LEVELS[-1])
            n = np.diff(at)
            mean = np.add.reduceat(x, at[:-1], axis=1) / n
            dev = np.sqrt(np.add.reduceat((x - np.repeat(mean, n, axis=1)) ** 2, at[:-1], axis=1) / n)
            starts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(len(n)))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.ListArray.from_arrays(starts, pa.array(c.reshape(-1))) for c in (mean, dev))], [*batch.schema.names, "mean", "dev"])


def coarser(mean: np.ndarray, dev: np.ndarray, n: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of fewer segments, both times the root of their length, from those of segments of n components."""
    at = edges(len(n), segments)[:-1]
    size = np.add.reduceat(n, at)
    middle = np.add.reduceat(mean * n, at, axis=1) / size
    square = np.add.reduceat((dev * dev + mean * mean) * n, at, axis=1) / size
    return middle * np.sqrt(size), np.sqrt(np.maximum(square - middle * middle, 0) * size)


def best(x: np.ndarray, y: np.ndarray, xs: tuple, ys: tuple, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows, ties among the last included.

    x, y are int64 matrices of anchors and rows, xs, ys their (mean, dev); query q asks for anchor of[q], the rows that
    allowed[of[q]] marks, and scores from low[q] to high[q].
    """
    n = np.diff(edges(x.shape[1], LEVELS[-1]))
    slack = 1 + 1e-9 * np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0) * (y.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
    alive = np.flatnonzero(allowed.any(axis=0))
    open_ = allowed[:, alive][of]

    def kth(bound: np.ndarray) -> np.ndarray:
        if bound.shape[1] < k:
            return np.full(len(bound), -np.inf)
        return np.partition(bound, -k, axis=1)[:, -k]

    for segments in LEVELS:
        if not len(alive) or segments > len(n):
            break
        a, e = coarser(*xs, n, segments)
        b, f = coarser(ys[0][alive], ys[1][alive], n, segments)
        middle, wide = (a @ b.T)[of], (e @ f.T)[of] + slack
        above, below = middle + wide, middle - wide
        open_ &= (above >= low[:, None]) & (below <= high[:, None])
        sure = open_ & (below >= low[:, None]) & (above <= high[:, None])
        open_ &= above >= kth(np.where(sure, below, -np.inf))[:, None]
        kept = open_.any(axis=0)
        alive, open_ = alive[kept], open_[:, kept]
    score = exact_products(x, y[alive])[of]
    open_ &= (score >= low[:, None]) & (score <= high[:, None])
    open_ &= score >= kth(np.where(open_, score, -np.inf))[:, None]
    q, r = np.nonzero(open_)
    return q, alive[r], score[q, r]


def _searched(k: int, same: bool):
    def run(rows: pa.Table) -> pa.Table:
        """One block of anchors (side 0, a row per query) against one block of rows (side 1)."""
        side = rows.column("side").to_numpy()
        asked, there = rows.filter(pa.array(side == 0)).sort_by("row"), rows.filter(pa.array(side == 1)).sort_by([("vec_id", "ascending"), ("row", "ascending")])
        own, first, of = np.unique(asked.column("row").to_numpy(), return_index=True, return_inverse=True)
        anchors = asked.take(pa.array(first))
        low, high = (asked.column(c).to_numpy() for c in ("low", "high"))
        x, y = matrix(anchors.column("v")), matrix(there.column("v"))
        xs, ys = (tuple(matrix(t.column(c)) for c in ("mean", "dev")) for t in (anchors, there))
        labels = pa.chunked_array([*anchors.column("of").chunks, *there.column("of").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        la, lb, other = labels[: len(own)], labels[len(own) :], there.column("row").to_numpy()
        found, strip = [], max(1, STRIP // max(1, len(other)))
        for at in range(0, len(of) if len(other) else 0, strip):  # queries of an anchor stand together
            q = slice(at, at + strip)
            some, inner = np.unique(of[q], return_inverse=True)
            allowed = ((la[some][:, None] == lb) == same) & (own[some][:, None] != other)
            part = best(x[some], y, (xs[0][some], xs[1][some]), ys, allowed, low[q], high[q], inner, k)
            found.append((part[0] + at, *part[1:]))
        q, r, score = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3))
        order = np.lexsort((r, -score, q))  # rows stand by vec_id, those without last
        q, r, score = q[order], r[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        q, r, score = (pa.array(a[rank < k]) for a in (q, r, score))
        got, to = asked.take(q), there.take(r)
        return pa.table([got.column("row"), got.column("vec_id"), got.column("to"), got.column("to_id"), got.column("to_score"), to.column("row"), to.column("vec_id"), score], SEARCHED)

    return run


SEARCHED = ["row", "vec_id", "to", "to_id", "to_score", "found", "found_id", "score"]


def searched(queries: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best rows of each query with score between its low and high; of the anchor's label, if ``same``, else of others.

    Highest scores come first, ties by smaller vec_id, missing ones last. queries: rows with to, to_id, to_score, low and high, unique by (row, to).
    Rows are compared inside a space: vectors of one length, and of one label if ``same``. Each space is dealt to blocks by hash.
    """
    space = F.concat_ws("/", F.size("v").cast("string"), "of") if same else F.size("v").cast("string")
    rows, queries = rows.withColumn("space", space), queries.withColumn("space", space)
    size = rows.groupBy("space").agg(F.count("*").alias("size"), F.max(F.size("v")).alias("d"))
    asked = queries.groupBy("space").agg(F.countDistinct("row").alias("anchors"), F.count("*").alias("queries"))
    most = F.least(F.greatest(F.col("size") / BLOCKS, F.lit(BLOCK_LEAST)), F.lit(BLOCK_MOST), F.greatest(F.lit(1 << 22) / F.col("d"), F.lit(1)))
    blocks = lambda n, most: F.ceil(F.col(n) / most).cast("int").alias(f"{n}_blocks")
    spaces = cut(size.join(asked, "space").select("space", "size", "queries", blocks("size", most), blocks("anchors", F.lit(ANCHORS))))
    of = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = join_by_size(rows, spaces, "space", "size", rows.count()).select("space", of("size_blocks").alias("block"), every("anchors_blocks").alias("anchors"), F.lit(1).alias("side"), "row", "vec_id", "of", "v", "mean", "dev", *[F.lit(None).cast(t).alias(c) for c, t in ASKED.items()])
    here = join_by_size(queries, spaces, "space", "queries", queries.count()).select("space", every("size_blocks").alias("block"), of("anchors_blocks").alias("anchors"), F.lit(0).alias("side"), "row", "vec_id", "of", "v", "mean", "dev", *ASKED)
    found = there.unionByName(here).groupBy("space", "block", "anchors").applyInArrow(_searched(k, same), ", ".join(f"{c} long" for c in SEARCHED))
    order = Window.partitionBy("row", "to").orderBy(F.desc("score"), F.col("found_id").asc_nulls_last(), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


ASKED = {"to": "long", "to_id": "long", "to_score": "long", "low": "long", "high": "long"}
_LEAST, _MOST = -(1 << 62), 1 << 62


def hard_negatives(vectors: DataFrame, anchors: str = "vec_id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE) -> DataFrame:
    """A row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the dot product of floor(scale * x). ``anchors`` is a condition on vec_id and label. An anchor's positives are the best other
    rows of its label; the negatives of each are the best rows of other labels with a score from FAR to NEAR percent of the positive's.
    Higher scores come first, ties by smaller vec_id, rows without vec_id last. Rows with a null label, a null or empty vector, or a null or non-finite component
    take no part. Vectors are compared with those of their length. Rows that share a vec_id are rows each by itself, so
    they may be each other's positives. Other columns are ignored; an empty table gives no rows. Components so large that
    twice a score would leave 64 bits (some 260 million for 64 components, after scaling) are an error.
    """
    rows = integer_vectors(vectors.where("label is not null"), scale).where(F.size("v") > 0)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.expr(anchors).alias("anchor"), F.col("label").cast("string").alias("of"), "v")
    rows = cut(rows.mapInArrow(_summed, "row long, vec_id long, anchor boolean, of string, v array<long>, mean array<double>, dev array<double>"))
    check_range(largest(rows), rows.agg(F.max(F.size("v")).alias("d")).first()["d"] or 1, 2)
    asked, none = rows.where("anchor").drop("anchor"), F.lit(None).cast("long")
    rows = rows.drop("anchor")
    firsts = searched(asked.withColumns({"to": none, "to_id": none, "to_score": none, "low": F.lit(_LEAST), "high": F.lit(_MOST)}), rows, positives, True)
    firsts = cut(firsts.select("row", F.col("found").alias("to"), F.col("found_id").alias("to_id"), F.col("score").alias("to_score")))
    # whole numbers n with FAR * positive <= 100 * n <= NEAR * positive
    bounds = firsts.withColumns({"low": F.expr(f"-floor(cast(-{FAR} * to_score as decimal(38, 0)) / 100)"), "high": F.expr(f"floor(cast({NEAR} * to_score as decimal(38, 0)) / 100)")})
    bounds = bounds.withColumns({c: F.col(c).cast("long") for c in ("low", "high")}).where("low <= high")
    found = searched(asked.join(bounds, "row"), rows, negatives, False)
    return found.select(F.col("vec_id").alias("anchor_id"), F.col("to_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), F.col("to_score").alias("positive_score"), F.col("score").alias("negative_score"))
