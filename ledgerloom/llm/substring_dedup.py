"""Removal of passages that repeat across documents, by Rabin-Karp hashes of token windows.

Documents are cut into blocks of neighbouring doc_ids. Each block hashes all its windows and ships
every distinct hash once, packed by hash bucket, so a passage that a third of all documents share
costs one entry per block. A bucket's task counts in how many places a hash stands and tells each
block, one bit per hash, whether a block of smaller doc_ids has it; the block then marks the windows
and merges them into maximal removal intervals. A doc_id with more text than a block has blocks of its
own, which share a rank and so don't judge each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Bytes of text in a block, at least and at most; between them they grow with the root of all bytes,
#: so that a block's hashes of one bucket stay many.
BLOCK_LEAST, BLOCK_MOST, BLOCK_GROWTH = 4 << 20, 64 << 20, 24
#: Windows hashed at once.
SLAB = 1 << 18
#: Distinct windows of a bucket on average, at most, for each byte of a block.
BUCKET_SHARE = 1 / 4
_BASE, _SEED = 0xD6E8FEB86659FD93, 0x51AFD7ED
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and _BASE ** -i modulo 2 ** 64 for i < n; n has few values, so they are kept."""
    if n not in _powers:
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[n] = (out[0], out[1])
    return _powers[n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text, and all words one after the other; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    words = lists.flatten()
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(words), 0)
    if pc.any(empty).as_py():  # a text without words splits to one empty word
        first = np.cumsum(count) - count
        none = np.zeros(len(words) + 1, np.int64)
        np.cumsum(empty.to_numpy(zero_copy_only=False), out=none[1:])
        count -= none[first + count] - none[first]
        words = words.filter(pc.invert(empty))
    return count, words


def word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word, by a hash of the distinct ones."""
    coded = words.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    known = np.array([digest(w, _SEED) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    return known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)


def window_hashes(hashes: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp: the polynomial of each ``window`` word hashes that follow each other, rolled along a prefix sum."""
    n = len(hashes) - window + 1
    out = np.zeros(max(0, n), np.uint64)
    up, down = _power(SLAB + window)
    for at in range(0, n, SLAB):
        part = hashes[at : at + SLAB + window - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        k = len(part) - window + 1
        out[at : at + k] = _mix((total[window : window + k] - total[:k]) * down[:k])
    return out


def windows(texts: pa.Array, window: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, all words, and of each window inside one text: its hash, its text and its first word."""
    count, words = tokens(texts)
    hashes = window_hashes(word_hashes(words), window)
    ends = np.repeat(np.cumsum(count), count)[: len(hashes)]
    at = np.flatnonzero(np.arange(len(hashes)) + window <= ends)
    return count, words, hashes[at], np.repeat(np.arange(len(count)), count)[at], at


def block_bytes(size: int) -> int:
    """Bytes of a block, for a corpus of so many bytes."""
    return int(min(BLOCK_MOST, max(BLOCK_LEAST, BLOCK_GROWTH * math.sqrt(size))))


def block_ends(lengths: DataFrame, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last doc_id of each block but the final one; the doc_ids that hold over ``target`` bytes, and how many blocks each needs.

    Rows are (doc_id, bytes). A prefix sum in two levels: each range of doc_ids is summed, starts at what the
    ranges before it hold, and closes a block whenever the sum of all passes a multiple of ``target``. So ends
    follow from the corpus and ``target`` alone, however it is partitioned, and only ends meet on the driver.
    """
    by = lengths.where("doc_id is not null").groupBy("doc_id").agg(F.sum("bytes").alias("bytes"))
    ranged = cut(by.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.min("doc_id").alias("first"), F.sum("bytes").alias("bytes")).orderBy("first").collect()
    offsets = dict(zip([r.part for r in sums], np.cumsum([0, *[r.bytes for r in sums]]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: int | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "bytes"))
            before = offsets[batch.column("part")[0].as_py()] if before is None else before
            passed = before + np.cumsum(size)
            closes = np.diff(passed // target, prepend=before // target) > 0
            big = size > target
            alone = ids[big & (ids > np.iinfo(np.int64).min)] - 1  # a big one starts a block as well
            end = np.unique(np.concatenate([ids[closes | big], alone]))
            parts = np.concatenate([np.zeros(len(end), np.int64), -(-size[big] // target)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([end, ids[big]])), pa.array(parts)], ["id", "parts"])
            before = int(passed[-1])

    found = ranged.mapInArrow(run, "id long, parts long").toPandas().astype("int64")
    big = found[found["parts"] > 0].sort_values("id")
    return np.unique(found.loc[found["parts"] == 0, "id"].to_numpy()), big["id"].to_numpy(), big["parts"].to_numpy()


def _packed(column: pa.ChunkedArray, keep: int) -> list[np.ndarray]:
    out = []
    for raw in column.to_pylist():
        wide = np.zeros((len(raw) // keep, 8), np.uint8)
        wide[:, 8 - keep :] = np.frombuffer(raw, np.uint8).reshape(-1, keep)
        out.append(wide.view(">u8").reshape(-1).astype(np.uint64))
    return out


def _send(bits: int, window: int):
    keep = 8 - bits // 8  # the bucket says the leading bytes

    def run(block: pa.Table) -> pa.Table:
        hashes = np.unique(windows(block.column("text").combine_chunks(), window)[2])
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - keep :]
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        packed = [raw[a:b].tobytes() for a, b in zip(at, [*at[1:], len(bucket)])]
        same = lambda name: pa.array([block.column(name)[0].as_py()] * len(at), pa.int64())
        return pa.table({"block": same("block"), "part": same("part"), "bucket": pa.array(bucket[at], pa.int64()), "hashes": pa.array(packed, pa.binary())})

    return run


def _answer(bits: int):
    keep = 8 - bits // 8

    def run(found: pa.Table) -> pa.Table:
        found = found.sort_by("block")
        parts = _packed(found.column("hashes"), keep)
        size = [len(p) for p in parts]
        every = np.concatenate(parts)
        block = np.repeat(found.column("block").to_numpy(), size)
        order = np.argsort(every, kind="stable")  # of one hash, the least block first
        new = np.diff(every[order], prepend=every[order[:1]] ^ np.uint64(1)) != 0
        least = block[order[np.flatnonzero(new)[np.cumsum(new) - 1]]]
        seen = np.zeros(len(every), bool)
        seen[order] = block[order] > least
        bitmaps = [np.packbits(seen[e - n : e]).tobytes() for n, e in zip(size, np.cumsum(size))]
        return pa.table([*(found.column(c) for c in ("block", "part", "bucket")), pa.array(bitmaps, pa.binary())], ["block", "part", "bucket", "seen"])

    return run


#: doc_id, n_words, n_removed, intervals of removed words (start, end exclusive), text that is left.
RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept_text", T.StringType()),
    ]
)


def removed_words(ids: pa.Array, count: np.ndarray, words: pa.Array, first: np.ndarray, window: int) -> list[pa.Array]:
    """The columns of RESULT, given the first words of all windows that go."""
    n, of = len(words), np.repeat(np.arange(len(count)), count)
    edges = np.bincount(first, minlength=n + 1) - np.bincount(first + window, minlength=n + 1)
    gone = np.cumsum(edges[:n]) > 0
    apart = np.diff(of, prepend=-1) != 0
    start = np.flatnonzero(gone & (apart | ~np.concatenate([[False], gone[:-1]])))
    end = np.flatnonzero(gone & np.concatenate([~gone[1:] | apart[1:], [True]])) + 1 if n else start
    begin = np.cumsum(count) - count
    offsets = lambda size: pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    lost = np.bincount(of[gone], minlength=len(count))
    spans = pa.StructArray.from_arrays([pa.array(start - begin[of[start]]), pa.array(end - begin[of[start]])], ["start", "end"])
    kept = pa.ListArray.from_arrays(offsets(count - lost), words.filter(pa.array(~gone)))
    return [ids, pa.array(count), pa.array(lost.astype(np.int64)), pa.ListArray.from_arrays(offsets(np.bincount(of[start], minlength=len(count))), spans), pc.binary_join(kept, " ")]


def _cut_out(bits: int, window: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        block = block.sort_by("doc_id")
        ids = block.column("doc_id").combine_chunks()
        count, words, hashes, of, at = windows(block.column("text").combine_chunks(), window)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        buckets = (distinct >> np.uint64(64 - bits)).astype(np.int64)
        seen = np.zeros(len(distinct), bool)
        for bucket, bitmap in zip(answers.column("bucket").to_pylist(), answers.column("seen").to_pylist()):
            a, b = np.searchsorted(buckets, [bucket, bucket + 1])
            seen[a:b] = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=b - a).astype(bool)
        holder = ids.to_numpy()[of]
        return pa.table(removed_words(ids, count, words, at[seen[which] | (holder > holder[first][which])], window), names=RESULT.names)

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that lose nothing."""
    for batch in batches:
        count, words = tokens(batch.column("text"))
        yield pa.RecordBatch.from_arrays(removed_words(batch.column("doc_id"), count, words, np.zeros(0, np.int64), 1), RESULT.names)


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """Remove each word that a repeated window of ``window`` words covers; see RESULT.

    A window repeats if the same words also start in a document of smaller doc_id; windows are
    judged on the input. Null texts have no words. Rows that share a doc_id don't judge each other;
    however many they are, they are dealt to as many blocks as their bytes need. A row without doc_id
    keeps all its words and makes no other row lose any. Other columns are ignored; an empty table
    gives no rows.

    Words are told apart by 64-bit hashes, and windows by a polynomial of those modulo 2 ** 64, where
    at least 56 bits tell two windows of 13 words apart however their words repeat. Nothing compares words, so
    among n distinct windows one that doesn't repeat is taken for a repeat with a probability of about n / 2 ** 64.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")
    lengths = cut(named.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")).groupBy("doc_id").agg(F.sum("bytes").alias("bytes")))
    size = lengths.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()["bytes"]
    target = block_bytes(size)
    bits = max(8, math.ceil(math.log2(max(1, size / 6 / (target * BUCKET_SHARE)))))
    placed = docs.sparkSession.sparkContext.broadcast(block_ends(lengths, target))

    @F.pandas_udf("struct<block:long,part:long>")
    def place(ids: pd.Series, row: pd.Series) -> pd.DataFrame:
        ends, big, parts = placed.value
        ids = ids.to_numpy()
        at = np.searchsorted(big, ids)
        own = at < len(big)
        own[own] = big[at[own]] == ids[own]
        part = np.zeros(len(ids), np.int64)
        part[own] = row.to_numpy()[own] % parts[at[own]]
        return pd.DataFrame({"block": np.searchsorted(ends, ids), "part": part})

    blocked = named.withColumn("_at", place("doc_id", F.monotonically_increasing_id())).select("doc_id", "text", "_at.block", "_at.part")
    sent = blocked.groupBy("block", "part").applyInArrow(_send(bits, window), "block long, part long, bucket long, hashes binary")
    told = sent.groupBy("bucket").applyInArrow(_answer(bits), "block long, part long, bucket long, seen binary")
    judged = blocked.groupBy("block", "part").cogroup(told.groupBy("block", "part")).applyInArrow(_cut_out(bits, window), RESULT)
    return judged.unionByName(nameless.mapInArrow(_whole, RESULT))
