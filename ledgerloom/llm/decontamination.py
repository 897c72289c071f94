"""Benchmark decontamination as a prefix-filtered set join, in built-in functions alone.

Each item is cut into windows of its words, and a window is a set of shingles. A document that holds a window holds all of its
shingles, so joining the rarest one of each window (its necessary prefix) finds every occurrence. One scan
of the documents keeps the places where any shingle of the benchmark stands, with the few words around each; counts of
those tell which shingle of a window is the rarest. The place of the shingle inside the window bounds where the window begins and ends, and a comparison
of the words decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_size, sieve

WINDOW, SHINGLE = 10, 5
#: Shingles of the benchmark that are broadcast as they are, at most; more of them go through a sieve of a fixed size.
BROADCAST = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    r"""Runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lowered; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _shingle(ws: Column, at: Column, n: Column | int) -> Column:
    return F.xxhash64(F.slice(ws, at, n))


def benchmark_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Distinct windows: words, the ids of the items that have it, and its shingles (hash, offset); an item without id has the empty one."""
    ws = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = ws.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("at"))
    found = starts.groupBy(F.slice("w", F.col("at"), window).alias("words")).agg(F.collect_set("item").alias("items"))
    k = F.least(F.size("words"), F.lit(shingle))
    each = F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda i: F.struct(_shingle(F.col("words"), i + 1, k).alias("h"), i.alias("offset")))
    return found.select("words", "items", each.alias("shingles"))


def places(docs: DataFrame, shingles: DataFrame, lengths: list[int], window: int = WINDOW) -> DataFrame:
    """One scan of the documents: a row per document (h null), and one for each place of a shingle with the words around it.

    Columns: row (of the document), doc_id, n_words, h, at (from 1), around, and skip: how many words before the place around has.
    shingles: distinct h; lengths: how many words these have.
    """
    ws = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    rows = ws.select("row", "doc_id", F.size("w").alias("n_words"), "w", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("at"))
    fits = lambda k: F.when((F.col("at") > 0) & (F.col("at") + k - 1 <= F.col("n_words")), _shingle(F.col("w"), F.col("at"), k))
    if len(lengths) == 1:
        rows = rows.withColumn("h", fits(lengths[0]))
    else:
        # the row of the document comes once, with the first length
        rows = rows.withColumn("h", F.explode(F.when(F.col("at") == 0, F.array(F.lit(None).cast("long"))).otherwise(F.array(*[fits(k) for k in lengths]))))
    rows = rows.where((F.col("at") == 0) | F.col("h").isNotNull())
    skip = F.least(F.col("at") - 1, F.lit(window - 1))
    kept = lambda d: d.select("row", "doc_id", "n_words", "h", "at", F.when(F.col("at") > 0, F.slice("w", F.col("at") - skip, skip + window)).alias("around"), skip.alias("skip"))
    if shingles.count() <= BROADCAST:
        return kept(rows.join(F.broadcast(shingles.withColumn("_in", F.lit(True))), "h", "left").where((F.col("at") == 0) | F.col("_in")))
    maybe, _ = sieve(rows.where("at > 0"), shingles, F.col("h"))
    return kept(maybe).unionByName(kept(rows.where("at = 0")))


def covered(spans: Column) -> Column:
    """How many words the spans (at, n) cover."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["at"] + s["n"] - F.greatest(a["end"], s["at"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["end"], s["at"] + s["n"]).alias("end"))
    return F.aggregate(F.array_sort(spans), none, step)["n"]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, items (ids as sorted strings of those with an occurring window), spans.

    Words are lowered runs of letters, digits and all beyond ASCII. A window is ``window`` words in a row of an item, or the whole item if it has
    fewer. spans are the occurrences (at, n), from word 1; n_hit counts the words inside any. Null and empty texts
    have no words, and items without words no window; items that share an id count as one, and those without id have the empty one. Rows that share a
    doc_id, or have none, are documents each by itself. Other columns are ignored; an empty table gives no rows, and
    without items nothing is hit.
    """
    windows = benchmark_windows(items, window, shingle)
    lengths = sorted(r.k for r in windows.select(F.least(F.size("words"), F.lit(shingle)).alias("k")).distinct().collect())  # at most ``shingle`` numbers
    each = windows.select("words", "items", F.explode("shingles").alias("s"))
    shingles = each.select("s.h").distinct()
    found = cut(places(docs, shingles, lengths or [shingle], window))
    rows = found.where("h is not null")
    counts = rows.groupBy("h").agg(F.count("*").alias("size"))
    # the rarest shingle of each window; a window with one that no document has can't occur
    ranked = each.join(counts, each["s.h"] == counts["h"], "left").groupBy("words").agg(F.first("items").alias("items"), F.min(F.struct(F.coalesce("size", F.lit(0)).alias("size"), F.col("s.h").alias("h"), F.col("s.offset").alias("offset"))).alias("rare"))
    prefix = ranked.where("rare.size > 0").select(F.col("rare.h").alias("h"), F.col("rare.size").alias("size"), F.struct(F.col("rare.offset").alias("offset"), "words", "items").alias("x"))
    prefix = cut(prefix.groupBy("h", "size").agg(F.collect_list("x").alias("xs")))
    met = join_by_size(rows, prefix, "h", "size", rows.count()).select("row", "n_words", "at", "around", "skip", F.explode("xs").alias("x"))
    begin = F.col("at") - F.col("x.offset")
    n = F.size("x.words")
    met = met.where((begin >= 1) & (begin + n - 1 <= F.col("n_words"))).where(F.slice("around", F.col("skip") + 1 - F.col("x.offset"), n) == F.col("x.words"))
    hits = met.groupBy("row").agg(F.collect_set(F.struct(begin.alias("at"), n.alias("n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("x.items")))).alias("items"))
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    out = found.where("h is null").select("row", "doc_id", "n_words").join(hits, "row", "left")
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        none("items", "array<string>").alias("items"), none(F.array_sort("spans"), "array<struct<at:int,n:int>>").alias("spans"),
    )
