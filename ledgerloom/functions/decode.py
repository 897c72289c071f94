"""Contract logs to typed events, for static and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params

_TYPES = {"string": T.StringType(), "long": T.LongType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


def schema(fields: str) -> T.StructType:
    """A schema from "name type, ...", without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])


RAW = schema("address string, topics array<string>, data string, blockNumber string, logIndex string, blockTimestamp string, removed boolean")
EVENT = schema("kind string, job_id long, block long, log_index long, ts long, client string, provider string, evaluator string, funder string, payee string, rejector string, recipient string, amount long, expired_at long")

# fixed values: kinds whose first word is an amount
PAID = ("BudgetSet", "JobFunded", "PaymentReleased", "Refunded", "EvaluatorFeePaid")


def bare(text: Column) -> Column:
    """Hex digits without 0x."""
    return F.when(F.substring(text, 1, 2).isin("0x", "0X"), F.substring(text, 3, 1 << 30)).otherwise(text)


def hex_to_long(text: Column) -> Column:
    """A hex number of at most 64 digits, with or without 0x; null if it isn't one or doesn't fit 63 bits."""
    return digits_to_long(bare(text))


def digits_to_long(digits: Column) -> Column:
    """As hex_to_long, without 0x. No regular expressions and no trimming: the leading 48 digits are compared, unhex checks the rest."""
    wide = F.lpad(digits, 64, "0")
    low = F.substring(wide, 49, 16)
    fits = (digits != "") & (F.length(digits) <= 64) & wide.startswith("0" * 48) & (F.substring(low, 1, 1) <= "7") & F.unhex(low).isNotNull()
    return F.when(fits, F.conv(low, 16, 10).cast("long"))


def hex_to_decimal(text: Column) -> Column:
    """A hex number below 2 ** 126 as DECIMAL(38, 0), else null."""
    digits = F.lpad(F.regexp_replace(F.regexp_replace(F.lower(text), "^0x", ""), "^0+(?=.)", ""), 32, "0")
    whole = (F.length(F.regexp_replace(F.lower(text), "^(0x)?0*", "")) <= 32) & digits.rlike("^[0-3][0-9a-f]{31}$")
    half = lambda at: F.conv(F.when(whole, F.substring(digits, at, 16)), 16, 10).cast("decimal(20,0)")
    product = half(1) * F.lit(2**32).cast("decimal(10,0)")
    return F.when(whole, (product.cast("decimal(38,0)") * F.lit(2**32).cast("decimal(10,0)") + half(17)).cast("decimal(38,0)"))


def word(data: Column, i: int) -> Column:
    """Word i of 32 bytes of the data; null where the data ends before it."""
    return F.nullif(F.substring(bare(data), 64 * i + 1, 64), F.lit(""))


def address(word: Column) -> Column:
    """The last 20 bytes, in lower case, with 0x."""
    return F.when(F.length(bare(word)) >= 40, F.concat(F.lit("0x"), F.lower(F.substring(word, -40, 40))))


def to_usdc(raw: Column) -> Column:
    return raw / F.lit(1_000_000)


def from_usdc(amount: Column) -> Column:
    return F.rint(amount * 1e6).cast("long")


def short_address(text: Column) -> Column:
    plain = text.isNull() | ~text.startswith("0x") | (F.length(text) < 12)
    return F.when(plain, text).otherwise(F.concat(F.left(text, F.lit(6)), F.lit("…"), F.right(text, F.lit(4))))


def decode(logs: DataFrame, contract: str | None = None, raw_amounts: bool = False) -> DataFrame:
    """Typed events (EVENT) of raw logs (RAW); raw_amounts: with amount_word, the amount's 64 hex digits, which wide.limbs() reads in full.

    Removed logs, other contracts, unknown signatures and logs without a job topic give no row. A
    log with too few topics or too short data keeps null in what is missing.
    """
    if contract is not None:
        logs = logs.where(F.lower("address") == contract.lower())
    kinds = F.create_map(*[F.lit(x) for kind, sig in params.SIGNATURES.items() for x in (sig, kind)])
    topic = lambda i: F.get("topics", F.lit(i))
    rows = logs.where(~F.coalesce("removed", F.lit(False)) & (F.size("topics") >= 2))
    # words are split once, in a projection of their own
    split = {"_first": word(F.col("data"), 0), "_second": word(F.col("data"), 1), "_who": topic(2)}
    rows = rows.select("*", F.try_element_at(kinds, F.lower(topic(0))).alias("kind")).where("kind is not null").withColumns(split)
    at = lambda kind, value: F.when(F.col("kind") == kind, value)
    first, who = F.col("_first"), address(F.col("_who"))
    named = F.when(~F.lit("0" * 64).startswith(first), address(first))  # at creation the zero address means none
    amount = F.when(F.col("kind").isin(*PAID), F.when(first.isNull(), F.lit(0).cast("long")).otherwise(digits_to_long(first)))
    return rows.select(
        "kind",
        hex_to_long(topic(1)).alias("job_id"),
        hex_to_long(F.col("blockNumber")).alias("block"),
        hex_to_long(F.col("logIndex")).alias("log_index"),
        hex_to_long(F.col("blockTimestamp")).alias("ts"),
        at("JobCreated", who).alias("client"),
        at("JobCreated", address(topic(3))).alias("provider"),
        F.when(F.col("kind") == "JobCreated", named).when(F.col("kind") == "JobCompleted", who).alias("evaluator"),
        at("JobFunded", who).alias("funder"),
        at("PaymentReleased", who).alias("payee"),
        at("JobRejected", who).alias("rejector"),
        F.when(F.col("kind").isin("Refunded", "EvaluatorFeePaid"), who).alias("recipient"),
        amount.alias("amount"),
        at("JobCreated", digits_to_long(F.col("_second"))).alias("expired_at"),
        *([F.when(F.col("kind").isin(*PAID), F.coalesce(first, F.lit("0"))).alias("amount_word")] if raw_amounts else []),
    )


def encode(events: DataFrame, contract: str = "0x" + "11" * 20) -> DataFrame:
    """Raw logs (RAW) of events whose parties are 0x addresses; decode() gives the events back."""
    pad = lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 64, "0")
    party = lambda c: F.lpad(bare(F.coalesce(c, F.lit("0x0"))), 64, "0")
    topic = lambda c: F.concat(F.lit("0x"), c)
    signatures = F.create_map(*[F.lit(x) for kind, sig in params.SIGNATURES.items() for x in (kind, sig)])
    who = F.coalesce("client", "funder", "payee", "rejector", "recipient", "evaluator")
    topics = F.array(F.element_at(signatures, F.col("kind")), topic(pad(F.col("job_id"))), topic(party(who)), topic(party(F.col("provider"))))
    data = F.when(F.col("kind") == "JobCreated", F.concat(party(F.col("evaluator")), pad(F.coalesce("expired_at", F.lit(0))))).otherwise(pad(F.coalesce("amount", F.lit(0))))
    number = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(F.col(c).cast("long"))))
    return events.select(F.lit(contract).alias("address"), topics.alias("topics"), F.concat(F.lit("0x"), data).alias("data"), number("block").alias("blockNumber"), number("log_index").alias("logIndex"), number("ts").alias("blockTimestamp"), F.lit(False).alias("removed"))
