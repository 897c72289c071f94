"""Helpers shared by the corpus operators: tables, checkpoints, skew-safe joins, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key above 1/HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 500
#: Keys with fewer rows than this are never hot.
HOT_LEAST = 2_000
#: Bytes of the ASCII white space [\x20\x09-\x0D].
SPACES = b"\t\n\x0b\x0c\r "
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; only a local session without one gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def join_by_size(left: DataFrame, right: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows with one row per key, whatever share of the rows one key holds.

    ``right`` has a row per ``key`` with the number of ``left`` rows of it in ``size``, and should be cheap to
    read. Keys above 1/HOT_SHARE of ``total`` are fewer than HOT_SHARE, a proven bound, and are broadcast; the rest
    are shuffled. ``how`` is inner or left.
    """
    limit = max(HOT_LEAST, total // HOT_SHARE)
    hot, cold = right.where(F.col(size) > limit), right.where(F.col(size) <= limit)
    if hot.isEmpty():
        return left.join(right, key, how)
    first = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return first.unionByName(rest)


#: Bits of the largest sieve; what is broadcast has a row for each 64 of them, at most 1,048,576 rows of two longs.
SIEVE_BITS = 1 << 26


def sieve(rows: DataFrame, keys: DataFrame, by: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key among ``keys``, rows that surely have none), told apart without a shuffle of rows.

    ``by`` is a hash of the key as a long, readable in both. Hashes of the keys set the bits of a map, 16 or
    more bits a key up to SIEVE_BITS. Beyond 67 million keys it fills up and more and more rows pass for nothing, so
    the first part always needs the exact join behind it. ``keys`` should be cheap to read.
    """
    bits = min(SIEVE_BITS, 1 << max(10, (16 * keys.count()).bit_length()))
    at = F.pmod(by, F.lit(bits).cast("long"))
    word, bit = F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    words = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    return marked.where(hit).select(*rows.columns), marked.where(~hit).select(*rows.columns)


def spread(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task reduced to a spanning star per component: (node, root), node != root."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label[i] == label[j]).all():
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


#: Links of a graph that one task finishes.
SMALL_GRAPH = 1 << 19


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (a, b) of a small graph at once: (node, to) for every node of a link."""
    ends = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
    a, b = (np.concatenate([e[k] for e in ends] or [np.zeros(0, np.int64)]) for k in (0, 1))
    node, root = spread(a, b)
    alone = np.setdiff1d(root, node)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, alone])), pa.array(np.concatenate([root, alone]))], ["node", "to"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b) between longs: one row (node, root) per node of any link.

    Every round maps each node to the neighbour of lowest random rank and contracts the graph;
    the expected number of rounds grows with the logarithm of the longest path. What is left once
    SMALL_GRAPH links bound it is finished by one task. Roots then go back down round by round. All state stays
    in DataFrames, each round is checkpointed, and nodes with a large share of the links are joined by size.
    """
    e = cut(edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a <> b").distinct())
    levels: list[DataFrame] = []
    while (n := e.count()) > SMALL_GRAPH:
        rank = lambda c, s=len(levels): F.struct(F.xxhash64(F.col(c), F.lit(s)).alias("h"), F.col(c).alias("n"))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("m"), F.count("*").alias("size"))
        to = cut(near.select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["n"].alias("to"), "size"))
        for end in ("a", "b"):
            e = join_by_size(e, to.select(F.col("node").alias(end), F.col("to").alias(f"t{end}"), "size"), end, "size", n).drop("size")
        e = cut(e.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct())
        levels.append(to.select("node", "to"))
    roots = e.coalesce(1).mapInArrow(_stars, "node long, to long").select("node", F.col("to").alias("root"))
    for to in reversed(levels):
        size = to.groupBy("to").agg(F.count("*").alias("size"))
        up = cut(size.join(roots.withColumnRenamed("node", "to"), "to", "left").select("to", F.coalesce("root", "to").alias("root"), "size"))
        roots = join_by_size(to, up, "to", "size", to.count()).select("node", "root")
    return roots
