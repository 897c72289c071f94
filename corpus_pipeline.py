"""A corpus from documents: quality, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the
shared folder and reads it again as the next stage's docs. All but the last return the columns of
documents. Null texts count as empty; an empty table passes through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, mixing, packing, quality, simhash
from ledgerloom.llm.common import cut, join_by_size, shared_folder, sieve, table


def wrapped(docs: DataFrame, *read: str) -> DataFrame:
    """What an operator reads of documents beside the text, and all other columns as one, so that no name clashes."""
    return docs.select("text", *read, F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("_rest"))


def unwrapped(found: DataFrame, columns: list[str]) -> DataFrame:
    return found.select(*[F.col("text") if c == "text" else F.col("_rest")[c].alias(c) for c in columns])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; its labels are those of the given docs."""
    scored = quality.score(wrapped(docs, "doc_id"), quality.train(docs, table(spark, sf_dir, "labels")))
    return unwrapped(scored.where("predicted = 1"), docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """Wrapped rows with a key of doc_id and text."""
    return wrapped(docs, "doc_id").withColumn("_key", row_key(F.sha2(F.coalesce("text", F.lit("")), 256)))


def row_key(sha: Column) -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), sha).alias("_key")


def without(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Keyed rows without those whose key isn't kept, and any one of each kept key that several rows tie in.

    ``named``: _key, _kept and the number of its rows in _ties, one row a key; rows of other keys stay. Only what
    a sieve can't clear is shuffled, and a key with a large share of all rows is joined by size.
    """
    found = cut(named.where("not _kept or _ties > 1"))
    maybe, clear = sieve(rows, found, F.xxhash64("_key"))
    other = join_by_size(maybe, found.select("_key", "_ties"), "_key", "_ties", rows.count(), "left").where("_ties is null").drop("_ties")
    ties = found.where("_kept").select("_key")
    kept = clear.unionByName(other)
    return kept if ties.isEmpty() else kept.unionByName(sieve(rows, ties, F.xxhash64("_key"))[0].dropDuplicates(["_key"]).join(ties, "_key", "left_semi"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the largest doc_id, any one of rows that tie in it."""
    found = exact_dedup.exact_dedup(docs)
    named = found.where("group_size > 1").groupBy(row_key(F.col("text_sha256"))).agg(F.max("kept").alias("_kept"), F.count("*").alias("_ties"))
    return unwrapped(without(keyed(docs), named), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id, then of the smallest sha256 of its text.

    Null ids come last. Rows are told apart by both, so other texts of a doc_id that is dropped, or null, stay; of rows
    that tie in both any one is kept.
    """
    rows = keyed(docs)
    found = cut(simhash.fingerprints(rows, "_key"))
    least = found.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_key")).alias("least"))
    fps = cut(simhash.rooted(found).join(least, "fp"))
    groups = fps.groupBy("root").agg(F.min("least")["_key"].alias("_least"), F.count("*").alias("n_fps"), F.sum("n_rows").alias("n")).where("n > 1")
    of = cut(join_by_size(fps.select("fp", "n_rows", "root"), groups, "root", "n_fps", fps.count()).select("fp", "n_rows", "_least"))
    linked = join_by_size(found, of, "fp", "n_rows", found.count())
    return unwrapped(without(rows, linked.groupBy("_key").agg(F.max(F.col("_key") == F.col("_least")).alias("_kept"), F.count("*").alias("_ties"))), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate and its draw say."""
    return unwrapped(mixing.emit(mixing.mix(wrapped(docs, "doc_id", "source"))), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in padded batches."""
    return packing.pack(docs)


STAGES = [("quality", classify), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: SQL can't express the trees or the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
