"""Compression of vectors to codes of one byte a part, with codebooks that are learned in exact integers.

Every round assigns each part of each vector to the nearest entry of the part's codebook and moves the entries to the
mean of what they got. Assignments come from exact integer dot products (limbs in float64 BLAS), so that codes are the same on any
machine and partitioning. A task returns sums per entry; only those and the codebooks, of a fixed size, meet on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_size
from .integer_vectors import check_range, exact_products, integer_vectors, largest, matrix

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, of ties the first, and its squared distance."""
    apart = (book * book).sum(axis=1) - 2 * exact_products(x, book)
    code = apart.argmin(axis=1)
    return code, apart[np.arange(len(x)), code] + (x * x).sum(axis=1)


def _sums(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = matrix(batch.column("v")).reshape(batch.num_rows, parts, width)
            for p in range(parts if len(x) else 0):
                code, _ = nearest(x[:, p], books[p])
                n[p] += np.bincount(code, minlength=entries)
                for e in np.unique(code):
                    total[p, e] += x[code == e, p].sum(axis=0)
        p, e, k = (a.reshape(-1) for a in np.indices(total.shape))
        got = n[p, e] > 0
        yield pa.RecordBatch.from_arrays([pa.array(a[got]) for a in (p, e, k, n[p, e], total.reshape(-1))], ["part", "entry", "place", "n", "total"])

    return run


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry at the floor of its parts' mean, unused ones where they were."""
    sums = rows.select("v").mapInArrow(_sums(books), "part long, entry long, place long, n long, total long")
    out = books.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # one row a number of the codebooks
        out[r.part, r.entry, r.place] = r.total // r.n
    return out


def learn(rows: DataFrame, first: list[list[int]], rounds: int = ROUNDS, parts: int = PARTS) -> np.ndarray:
    """Codebooks (parts, entries, width) that begin with the parts of the given vectors."""
    books = np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = moved(rows, books)
    return books


def _coded(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        for batch in batches:
            x = matrix(batch.column("v")).reshape(batch.num_rows, parts, width)
            found = [nearest(x[:, p], books[p]) for p in range(parts)]
            raw = np.stack([c for c, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            codes = [raw[at : at + 2 * parts] for at in range(0, len(raw), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("of"), pa.array(codes, pa.string()), pa.array(sum(e for _, e in found))], ["vec_id", "of", "code", "error"])

    return run


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(a row per kept vector: vec_id, code, error, label_error; the codebooks).

    Rows whose vector is null or holds null or non-finite components are dropped. Kept vectors have one length, that of the
    smallest vec_id whose vector can be cut into equal parts; vectors of another length are dropped too. Codebooks begin
    with the vectors of the smallest vec_ids (a missing one is the largest; of equal ones the smaller vector is first), or with
    all if there are fewer; no kept vector, no codebooks and no rows. Rows that share a vec_id are vectors each by itself, and
    rows without label have their errors summed together. Other columns are ignored. Components so large that squared
    distances would leave 64 bits (65,536 and more for parts of 8 components) are an error.
    """
    whole = (F.size("v") > 0) & (F.size("v") % parts == 0)
    key = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
    rows = cut(integer_vectors(vectors, scale).where(whole).select("vec_id", key.alias("of"), "v"))
    ahead = rows.orderBy(*order).limit(1).collect()
    if not ahead:
        return rows.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), np.zeros((parts, 0, 0), np.int64)
    d = len(ahead[0].v)
    rows = rows.where(F.size("v") == d)
    check_range(largest(rows), d // parts, 8)
    books = learn(rows, [r.v for r in rows.orderBy(*order).limit(entries).collect()], rounds, parts)
    coded = cut(rows.mapInArrow(_coded(books), "vec_id long, of string, code string, error long"))
    sums = cut(coded.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("size")))
    return join_by_size(coded, sums, "of", "size", coded.count()).select("vec_id", "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all numbers of the codebooks, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
