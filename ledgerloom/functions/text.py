"""Requirement texts of jobs: validation, counting, extractive summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("(?U)\\S+")), F.lit(0)).cast("long")


def flat(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "(?U)\\s+", " "), "^ | $", "")


def extractive_summary(text: Column, sentences: int = 3, otherwise: int = 300) -> Column:
    """The first sentences joined by spaces, or the first characters of a text without any."""
    one_line = flat(text)
    # sentences follow each other, so each is read from the start: linear also in texts without an end of sentence
    one = "[^.!?]++[.!?]++"
    found = F.array(*[F.regexp_extract(one_line, f"^[.!?]*+(?:{one}){{{k}}}({one})", 1) for k in range(sentences)])
    picked = F.array_join(F.filter(found, lambda x: x != ""), " ")
    return F.coalesce(F.nullif(F.trim(picked), F.lit("")), F.left(one_line, F.lit(otherwise)))


def validate(payload: Column, most: int = params.MAX_WORDS) -> Column:
    """The tag of a JSON requirement: ok, unparseable, missing text, empty text or text too long."""
    parsed = F.try_parse_json(payload)
    text = F.try_variant_get(parsed, "$.text", "string")
    is_text = F.schema_of_variant(F.try_variant_get(parsed, "$.text", "variant")) == "STRING"
    n = word_count(text)
    return (
        F.when(parsed.isNull(), "unparseable")
        .when(~F.coalesce(is_text, F.lit(False)), "missing text")
        .when(n == 0, "empty text")
        .when(n > most, "text too long")
        .otherwise("ok")
    )


def requirement_texts(entries: DataFrame, most: int = params.MAX_WORDS) -> DataFrame:
    """The first valid requirement of each job: job_id, text. entries: job_id, entry_order, content_type, content."""
    good = entries.where((F.col("content_type") == "requirement") & validate(F.col("content"), most).isin("ok", "text too long"))
    text = F.try_variant_get(F.try_parse_json("content"), "$.text", "string")
    return good.groupBy("job_id").agg(F.min_by(text, "entry_order").alias("text"))
