"""Reading event logs and evidence: scan files, landed logs, exports; static and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.decode import RAW, decode, hex_to_long

SCAN = f"state struct<cursor: long>, logs array<{RAW.simpleString()}>"


def read_scan(spark: SparkSession, path: str) -> DataFrame:
    """Raw logs of scan files, plain or gzip. A scan is one JSON value and so one task: land it once with land()."""
    return spark.read.schema(SCAN).json(path, multiLine=True).select(F.inline("logs"))


#: Logs of a scan file that write_scans() makes, about.
SCAN_LOGS = 20_000


def write_scans(logs: DataFrame, path: str, span: int = 100, size: int = SCAN_LOGS) -> None:
    """Write raw logs as gzip scan files of ``span`` blocks whose last block is the cursor; a span of more than ``size`` logs is dealt over several files.

    Logs are sorted into their files and written as text that opens where a file begins and closes where it ends, so no task holds
    the logs of a scan, and a reader holds about ``size``.
    """
    rows = logs.select(F.to_json(F.struct(*RAW.fieldNames())).alias("log"), hex_to_long(F.col("blockNumber")).alias("block"), hex_to_long(F.col("logIndex")).alias("index")).withColumn("span", F.floor(F.col("block") / span))
    parts = logs.groupBy(F.floor(hex_to_long(F.col("blockNumber")) / span).alias("span")).agg(F.ceil(F.count("*") / size).alias("parts"))
    rows = rows.join(F.broadcast(parts), "span").withColumn("part", F.pmod(F.xxhash64("block", "index"), "parts"))  # a row a span
    by = Window.partitionBy("span", "part").orderBy("block", "index")
    opening = F.concat(F.lit('{"state":{"cursor":'), (F.col("span") * span + (span - 1)).cast("string"), F.lit('},"logs":['))
    value = F.concat(F.when(F.row_number().over(by) == 1, opening).otherwise(","), "log", F.when(F.lead(F.lit(1)).over(by).isNull(), "]}").otherwise(""))
    rows.select("span", "part", value.alias("value")).write.partitionBy("span", "part").option("compression", "gzip").text(path)


def read_cursor(spark: SparkSession, path: str) -> int | None:
    return spark.read.schema(SCAN).json(path, multiLine=True).select(F.max("state.cursor").alias("c")).first()["c"]


def land(events: DataFrame, path: str, partitions: int, span: int = 100_000) -> None:
    """Write events in chain order, range-partitioned by block and split into folders of ``span`` blocks.

    The folder names hold span and first block, so that a reader needs to know neither.
    """
    ranged = events.withColumns({"block_span": F.lit(span).cast("long"), "block_range": F.floor(F.col("block") / span) * span}).repartitionByRange(partitions, "block")
    ranged.sortWithinPartitions("block", "log_index", "job_id").write.partitionBy("block_span", "block_range").mode("append").parquet(path)


def read_events(spark: SparkSession, path: str, after: int | None = None) -> DataFrame:
    """Landed events, only those after a block if given; folders that end before it are pruned, and the pushed filter reads no more of the rest."""
    rows = spark.read.parquet(path)
    if after is not None:
        rows = rows.where((F.col("block") > after) & (F.col("block_range") + F.col("block_span") > after))
    return rows.drop("block_span", "block_range")


def settled(logs: DataFrame, cursor: int, head: int, confirmations: int = params.CONFIRMATIONS, contract: str | None = None) -> DataFrame:
    """Decoded events of whole blocks in (cursor, head - confirmations], of one contract if given."""
    return decode(logs, contract).where((F.col("block") > cursor) & (F.col("block") <= head - confirmations))


def resume_from(start: int, saved: int | None) -> int:
    """Never before the start and never back behind what was saved."""
    return max(start, saved if saved is not None else start)


def with_history(history: DataFrame, live: DataFrame) -> DataFrame:
    """History and live events as one, each log once."""
    return history.unionByName(live).dropDuplicates(["block", "log_index"])


def stream_logs(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files).json(path)


EXPORT = "provider string, observations array<struct<job: long, job_id: long, block: long, confirmed: boolean>>"
#: Observations of a file of exports, about.
EXPORT_ROWS = 20_000


def write_evidence(observations: DataFrame, path: str, size: int = EXPORT_ROWS) -> None:
    """Write observations as evidence exports, one a provider; a file is a JSON array of the exports that share it."""
    files = -(-observations.count() // size)
    one = observations.groupBy(F.upper("provider").alias("provider")).agg(F.collect_list(F.struct(F.col("job_id").alias("job"), "block", "confirmed")).alias("observations"))
    shared = one.groupBy(F.pmod(F.xxhash64("provider"), F.lit(max(1, files)))).agg(F.collect_list(F.to_json(F.struct("provider", "observations"))).alias("exports"))
    shared.select(F.concat(F.lit("["), F.array_join("exports", ","), F.lit("]")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Observations of evidence exports, one a file or several as an array; the job column may be named job or job_id."""
    rows = spark.read.schema(EXPORT).json(path, multiLine=True)
    rows = rows.select(F.lower("provider").alias("provider"), F.lit("availability").alias("declaration_type"), F.explode("observations").alias("o"))
    return rows.select("provider", "declaration_type", F.coalesce("o.job_id", "o.job").alias("job_id"), "o.block", "o.confirmed")
