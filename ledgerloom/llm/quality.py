"""Document quality: histogram gradient-boosted trees over statistics of the whole text.

The trees are grown here on a bounded sample of labelled rows; their nodes lie in flat arrays,
so that a batch of documents walks all trees with numpy indexing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that are learned from, at most: those of the lowest hash of doc_id.
TRAIN_ROWS = 20_000
ROUNDS, DEPTH, BINS, RATE, LEAST_WEIGHT, RIDGE = 60, 4, 64, 0.15, 2.0, 1.0
KEEP_SCORE = 0.7

FEATURES = (
    "log_bytes log_words word_bytes longest_word upper_share digit_share space_share high_share symbol_share stop_share "
    "comma_share exclaim_share pipe_share entropy distinct_words distinct_lines line_words top_word short_words "
    "symbol_words upper_words sentence_words"
).split()
_KIND = np.zeros((256, 10), np.float64)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r", "", "#$%&*@^~_=<>+\\/{}[]", ".?;:", ",", "!", "|", "\"'()-")):
    for _c in _chars:
        _KIND[ord(_c), _i] = 1
_KIND[128:, 3] = 1


def statistics(text: str | None) -> list[float]:
    """FEATURES of one whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (count @ _KIND) / max(n, 1)
    p = count[count > 0] / max(n, 1)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    distinct = Counter(words)
    last = [x[-1] for x in words]
    sentences = sum(x in b".!?" for x in last)
    return [
        math.log1p(n),
        math.log1p(len(words)),
        n / w,
        float(lengths.max(initial=0)),
        shares[0],
        shares[1],
        shares[2],
        shares[3],
        shares[4],
        shares[5],
        shares[6],
        shares[7],
        shares[8],
        float(-(p * np.log2(p)).sum()),
        len(distinct) / w,
        len(set(lines)) / max(len(lines), 1),
        len(words) / max(len(lines), 1),
        max(distinct.values(), default=0) / w,
        float((lengths <= 3).sum()) / w,
        sum(x in b"#$%&*|" for x in last) / w,
        sum(x.isupper() for x in words) / w,
        w / max(sentences, 1),
    ]


@dataclass
class Trees:
    """Complete trees of one depth, node k's children at 2k + 1 and 2k + 2."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.cut[tree, at])
        total = self.start + self.leaf[tree, at - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees | None:
    """Boosted trees for the log odds of label 1; None without rows. One class alone gives its prior."""
    if not len(y):
        return None
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    start = math.log(prior / (1 - prior))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, cut, leaf = np.zeros((ROUNDS, inner), np.int64), np.full((ROUNDS, inner), np.inf), np.zeros((ROUNDS, leaves))
    margin = np.full(len(y), start)
    for t in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            local = node - first
            best, pick = np.zeros(width), np.full((width, 2), -1)
            for f in range(x.shape[1]):
                key = local * BINS + binned[:, f]
                gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hs < LEAST_WEIGHT) | (ht - hs < LEAST_WEIGHT)] = 0
                gain[:, len(cuts[f]) :] = 0
                at = gain.argmax(axis=1)
                value = gain[np.arange(width), at]
                better = value > best + 1e-9
                best[better], pick[better, 0], pick[better, 1] = value[better], f, at[better]
            right = np.zeros(len(y), bool)
            for k in range(width):
                f, b = pick[k]
                if f >= 0:
                    feature[t, first + k], cut[t, first + k] = f, cuts[f][b]
                    own = local == k
                    right[own] = binned[own, f] > b
            node = 2 * node + 1 + right
        end = node - inner
        value = np.bincount(end, g, leaves) / (np.bincount(end, h, leaves) + RIDGE) * RATE
        leaf[t] = value
        margin += value[end]
    return Trees(feature, cut, leaf, start)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row's label is kept for measurement; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Learn from the documents of at most ``rows`` labelled doc_ids that aren't held out; where doc_ids repeat, from at most 4 * ``rows`` documents.

    Labels that are null are ignored; of several labels for one doc_id the largest counts. The
    sample takes the lowest hashes of doc_id, so it is the same in every run. None if no
    labelled document exists.
    """
    named = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    sample = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    found = chosen.select("doc_id", "quality", "text").mapInArrow(_measure, "doc_id long, quality int, x array<double>").orderBy("doc_id", "x").limit(4 * rows).collect()
    return fit(np.array([r.x for r in found]).reshape(len(found), len(FEATURES)), np.array([float(r.quality) for r in found]))


def score(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """Every input row with score (0 to 1) and predicted (1 from KEEP_SCORE on).

    Only the text counts, null as empty. Without trees nothing speaks against a text: score 1.
    Columns named score or predicted are replaced. An empty table gives no rows.
    """
    docs = docs.drop("score", "predicted")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array([statistics(t) for t in part.column(names.index("text")).to_pylist()])
                s = trees.score(x) if trees else np.ones(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= KEEP_SCORE).astype(np.int32))], [*names, "score", "predicted"])

    schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)
