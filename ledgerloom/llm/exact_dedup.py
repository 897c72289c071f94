"""Exact deduplication through counting quotient filters.

A 64-bit fingerprint splits into region, quotient and remainder, and a filter keeps all three, so it
loses nothing: two filters of a region merge by merging their sorted remainders and adding counts.
Only fingerprints counted more than once send their texts on to a comparison of the bytes; a sieve
keeps most other texts from being shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_size, sieve

#: Bits of a quotient inside a region.
QUOTIENT_BITS = 10
#: Fingerprints that one region holds on average, at most.
REGION_ROWS = 1 << 19


@dataclass
class QuotientFilter:
    """Runs of sorted remainders, one run per quotient, with a count each."""

    remainder_bits: int
    runs: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, fingerprints: np.ndarray, remainder_bits: int) -> QuotientFilter:
        """From fingerprints without their region bits."""
        values, counts = np.unique(fingerprints, return_counts=True)
        return cls._from_sorted(values, counts.astype(np.uint64), remainder_bits)

    @classmethod
    def _from_sorted(cls, values: np.ndarray, counts: np.ndarray, remainder_bits: int) -> QuotientFilter:
        quotient = (values >> np.uint64(remainder_bits)).astype(np.int64)
        runs = np.bincount(quotient, minlength=1 << QUOTIENT_BITS).astype(np.uint32)
        return cls(remainder_bits, runs, values & np.uint64((1 << remainder_bits) - 1), counts)

    def values(self) -> np.ndarray:
        quotient = np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs)
        return (quotient << np.uint64(self.remainder_bits)) | self.remainders

    @staticmethod
    def merged(filters: list[QuotientFilter]) -> QuotientFilter:
        """The filter of all fingerprints of the given filters."""
        values = np.concatenate([f.values() for f in filters])
        order = np.argsort(values, kind="stable")  # merges the sorted runs
        values, counts = values[order], np.concatenate([f.counts for f in filters]).astype(np.uint64)[order]
        first = np.flatnonzero(np.diff(values, prepend=values[:1] ^ np.uint64(1)))
        return QuotientFilter._from_sorted(values[first], np.add.reduceat(counts, first), filters[0].remainder_bits)

    def to_bytes(self) -> tuple[bytes, bytes, bytes]:
        values = self.values()
        return tuple(c[0].as_py() for c in stored(values, self.counts, np.array([0, len(values)]), self.remainder_bits))

    @classmethod
    def from_bytes(cls, runs: bytes, remainders: bytes, counts: bytes, remainder_bits: int) -> QuotientFilter:
        keep = -(-remainder_bits // 8)
        wide = np.zeros((len(remainders) // keep, 8), np.uint8)
        wide[:, 8 - keep :] = np.frombuffer(remainders, np.uint8).reshape(-1, keep)
        found = np.frombuffer(runs, RUN)
        lengths = np.zeros(1 << QUOTIENT_BITS, np.uint32)
        lengths[found["quotient"]] = found["length"]
        return cls(remainder_bits, lengths, wide.view(">u8").reshape(-1).astype(np.uint64), np.frombuffer(counts, np.uint64))


#: A run as it is stored; empty ones aren't.
RUN = np.dtype([("quotient", "<u2"), ("length", "<u4")])


def stored(values: np.ndarray, counts: np.ndarray, at: np.ndarray, remainder_bits: int) -> list[pa.Array]:
    """(runs, remainders, counts) of the filters of regions at once: region i has the sorted distinct fingerprints values[at[i]:at[i + 1]].

    A filter stores its non-empty runs alone, so its bytes follow its fingerprints, however many regions there are.
    """
    keep, low = -(-remainder_bits // 8), np.uint64((1 << remainder_bits) - 1)
    quotient = ((values >> np.uint64(remainder_bits)) & np.uint64((1 << QUOTIENT_BITS) - 1)).astype(np.int64)
    region = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = np.flatnonzero(np.diff((region << QUOTIENT_BITS) | quotient, prepend=-1))
    runs = np.zeros(len(first), RUN)
    runs["quotient"], runs["length"] = quotient[first], np.diff(first, append=len(values))
    raw = (values & low).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - keep :]

    def binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())

    return [binary(np.searchsorted(first, at) * RUN.itemsize, runs), binary(at * keep, raw), binary(at * 8, counts.astype(np.uint64))]


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, n_rows) of each fingerprint in column fp that more than one row has."""
    bits = max(7, math.ceil(math.log2(max(1, rows / REGION_ROWS))))
    low = 64 - bits - QUOTIENT_BITS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            region = (values >> np.uint64(64 - bits)).astype(np.int64)
            at = np.flatnonzero(np.diff(region, prepend=-1))
            columns = stored(values, counts, np.append(at, len(values)), low)
            return pa.RecordBatch.from_arrays([pa.array(region[at]), *columns], ["region", "runs", "remainders", "counts"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= 4 * REGION_ROWS:
                yield flush()
                held = []
        if held:
            yield flush()

    def merge(found: pa.Table) -> pa.Table:
        parts = [QuotientFilter.from_bytes(*x, low) for x in zip(*(found.column(c).to_pylist() for c in ("runs", "remainders", "counts")))]
        whole = QuotientFilter.merged(parts)
        many = whole.counts > 1
        fp = (np.uint64(found.column("region")[0].as_py()) << np.uint64(64 - bits)) | whole.values()[many]
        return pa.table({"fp": pa.array(fp.view(np.int64)), "n_rows": pa.array(whole.counts[many].astype(np.int64))})

    filters = fingerprints.select("fp").mapInArrow(build, "region long, runs binary, remainders binary, counts binary")
    return filters.groupBy("region").applyInArrow(merge, "fp long, n_rows long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """A row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their bytes are; null counts as empty. Of equal texts the row with the
    largest doc_id stays; null ids are smaller than all others, and among rows that tie in both
    text and doc_id each says kept. Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    light = cut(texts.select("doc_id", F.xxhash64("text").alias("fp"), F.sha2("text", 256).alias("text_sha256")))
    rows = light.count()
    repeated = cut(repeated_fingerprints(light, rows))
    maybe, _ = sieve(texts.select("doc_id", F.xxhash64("text").alias("fp"), "text"), repeated, F.col("fp"))
    suspects = join_by_size(maybe, repeated, "fp", "n_rows", rows)
    same = suspects.groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = cut(same.where("group_size > 1").select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    joined = join_by_size(light.drop("fp"), groups, "text_sha256", "group_size", rows, "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
