"""SimHash near-duplicates: fingerprints, and a self-join of their binary trie.

Two fingerprints within ERRORS bits agree in at least one of ERRORS + 1 groups of bits, so the trie is
dealt out by (group, value) and every task walks the pairs of nodes of its subtries together, level
by level, adding up differing bits and dropping a pair of nodes once the budget is exceeded. A
subtrie that is too large for a task is dealt again by groups of its remaining bits, which loses no
pair either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, join_by_size, spread

ERRORS, SHINGLE, SEED = 3, 3, 42
#: Shingles of a text that are hashed at once.
SLAB = 1 << 16
#: Distinct fingerprints of a subtrie above which it is dealt again.
SUBTRIE = 20_000
#: Node pairs that are walked at once.
FRONTIER = 1 << 18


def fingerprint(text: str | None) -> int:
    """64 bits, unsigned: a bit is 1 if more than half of the shingles' hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SLAB):
        spans = zip(starts[at : min(n, at + SLAB)].tolist(), last[at : at + SLAB].tolist())
        part = np.array([digest(line[a:b], SEED) for a, b in spans], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the columns ``also`` of each row; null and empty texts give 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64)), *map(batch.column, also)], ["doc_id", "fp", *also])

    return rows.mapInArrow(run, T.StructType([*T.StructType.fromDDL("doc_id long, fp long"), *(rows.schema[c] for c in also)]))


def trie_pairs(fps: np.ndarray, runs: np.ndarray, errors: int = ERRORS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within ``errors`` bits of each other and in one subtrie.

    ``fps`` is sorted within each subtrie; ``runs`` has the subtries' bounds, so subtrie k is
    fps[runs[k]:runs[k + 1]]. A node is a range of fps that agree in all bits above its level.
    """
    ones = None
    stack = [(63, runs[:-1], runs[1:], runs[:-1], runs[1:], np.zeros(len(runs) - 1, np.int64))]
    prefix: dict[int, np.ndarray] = {}

    def split(bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if bit not in prefix:
            prefix[bit] = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        ones = prefix[bit]
        return hi - (ones[hi] - ones[lo])

    while stack:
        bit, a, b, c, d, wrong = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack.append((bit, a[half:], b[half:], c[half:], d[half:], wrong[half:]))
            stack.append((bit, a[:half], b[:half], c[:half], d[:half], wrong[:half]))
            continue
        own = a == c
        small = ((b - a) * (d - c) <= 64) & ((b - a > 1) | ~own) | (bit < 0)
        if small.any():
            # leaves: few pairs are left below, compare them by their bits
            wide = (d - c)[small]
            count = (b - a)[small] * wide
            which = np.repeat(np.arange(len(count)), count)
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            i, j = a[small][which] + inner // wide[which], c[small][which] + inner % wide[which]
            near = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= errors)
            if near.any():
                yield i[near], j[near]
        go = ~small & ((b - a > 1) | ~own)
        if not go.any():
            continue
        a, b, c, d, wrong, own = a[go], b[go], c[go], d[go], wrong[go], own[go]
        m, n = split(bit, a, b), split(bit, c, d)
        nodes = [(a, m, c, n, wrong), (m, b, n, d, wrong), (a, m, n, d, wrong + 1), (m[~own], b[~own], c[~own], n[~own], wrong[~own] + 1)]
        a, b, c, d, wrong = (np.concatenate(x) for x in zip(*nodes))
        keep = (a < b) & (c < d) & (wrong <= errors)
        if keep.any():
            stack.append((bit - 1, a[keep], b[keep], c[keep], d[keep], wrong[keep]))


def _groups(free: int) -> list[int]:
    """The free bits, dealt to ERRORS + 1 masks."""
    bits = [b for b in range(64) if free >> b & 1]
    masks = []
    for k in range(ERRORS + 1):
        part = bits[k * len(bits) // (ERRORS + 1) : (k + 1) * len(bits) // (ERRORS + 1)]
        masks.append(sum(1 << b for b in part))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mask, key, fp as unsigned): stars of the links in each subtrie."""
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray) -> pa.RecordBatch:
        fps = np.ascontiguousarray(rows[2]).view(np.uint64)
        new = np.flatnonzero(np.any(np.diff(rows[:2], axis=1) != 0, axis=0)) + 1
        runs = np.concatenate([[0], new, [len(fps)]])
        left, right, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for i, j in trie_pairs(fps, runs):
            left.append(i)
            right.append(j)
            size += len(i)
            if size > 1 << 20:
                i, j = spread(np.concatenate(left), np.concatenate(right))
                left, right, size = [i], [j], len(i)
        i, j = spread(np.concatenate(left), np.concatenate(right))
        return pa.RecordBatch.from_arrays([pa.array(fps[i].view(np.int64)), pa.array(fps[j].view(np.int64))], ["a", "b"])

    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]]))
        rows = np.concatenate(held, axis=1) if len(held) > 1 else held[0]
        if not rows.shape[1]:
            continue
        changes = np.flatnonzero(np.any(np.diff(rows[:2], axis=1) != 0, axis=0))
        if len(changes) and rows.shape[1] > 50_000:
            end = changes[-1] + 1
            yield flush(rows[:, :end])
            held = [rows[:, end:]]
        else:
            held = [rows]
    if held and held[0].shape[1]:
        yield flush(np.concatenate(held, axis=1))


def links(distinct: DataFrame, limit: int = SUBTRIE) -> DataFrame:
    """(a, b): links that join every two distinct fingerprints (column fp) within ERRORS bits, by paths if not directly."""
    full = (1 << 64) - 1
    level = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in _groups(full)])).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    masks, ready = _groups(full), []
    for _ in range(3):
        crowded = level.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > limit).drop("n")
        crowded = cut(crowded)
        if crowded.isEmpty():
            break
        ready.append(level.join(crowded, ["mask", "key"], "left_anti"))
        again = level.join(crowded, ["mask", "key"], "left_semi")
        deeper = {m: [m | x for x in _groups(full & ~m)] for m in masks}
        masks = sorted({x for found in deeper.values() for x in found})
        choices = F.create_map(*[x for m, found in deeper.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(v)) for v in found]))])
        level = again.select("fp", F.explode(F.element_at(choices, F.col("mask"))).alias("mask")).distinct().withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        level = cut(level)
    ready.append(level)
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    unsigned = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))  # orders longs as if unsigned
    dealt = rows.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", unsigned)
    return dealt.mapInArrow(_join, "a long, b long")


def rooted(found: DataFrame) -> DataFrame:
    """fp, first (the smallest doc_id), n_rows and root of each distinct fingerprint; those of one component have one root."""
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_rows")))
    roots = cut(components(links(distinct)))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "n_rows", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per input row: doc_id, fp (signed long) and component_id.

    Component_id is the smallest doc_id that links reach; null ids count only if a component has no
    other. Texts without words all have fingerprint 0 and are linked like any other. Other columns
    are ignored; an empty table gives no rows.
    """
    found = cut(fingerprints(docs))
    fps = cut(rooted(found))
    least = fps.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n_fps"))
    of = cut(join_by_size(fps, least, "root", "n_fps", fps.count()).select("fp", "n_rows", "component_id"))
    return join_by_size(found, of, "fp", "n_rows", found.count()).select("doc_id", "fp", "component_id")
