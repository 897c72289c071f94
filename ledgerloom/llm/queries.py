"""The corpus queries, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_dedup, exact_dedup, hard_negatives, mixing, packing, pii, quality, secrets, simhash, substring_dedup, urls, vector_codes
from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def _joined(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(kinds: list[str]) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(kinds))


def _digest(found: DataFrame, base: list[str]) -> DataFrame:
    counts = [F.size(_of([k])).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(_joined(_of(base)), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(secrets.secret_spans(table(spark, sf_dir, "documents")), list(secrets.BASE))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pii.pii_spans(table(spark, sf_dir, "documents")), list(pii.BASE))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vec_id has the next label, as the contract of this query has it."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_quality, op3_mixing, op4_packing, op5_exact_dedup, op6_secrets, op7_pii, op8_urls, op9_simhash, op10_embeddings,
        op11_hard_negatives, op12_decontamination, op13_vector_codes,
    )
}

_GLOBS = " OR ".join(f"(host || path) LIKE '{g.replace('*', '%')}'" for g in urls.BLOCKED)
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)

def _spans_sql() -> str:
    """All spans of the secret rules: positions follow from the lengths of matches and of what lies between them."""
    total = lambda x: f"coalesce(list_sum([length(s) for s in {x}]), 0)"
    kinds = []
    for k, (kind, (pattern, group, least)) in enumerate(secrets.RULES.items()):
        p = "'" + pattern.decode().replace("'", "''") + "'"
        kinds.append(f"""SELECT doc_id, '{kind}' AS kind, {k} AS k, {total("gap[:i]")} + {total("hit[:i - 1]")} AS a, length(hit[i]) AS n, length(part[i]) AS size, {least} AS least
FROM (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS hit, regexp_extract_all(t, {p}, {group}) AS part, string_split_regex(t, {p}) AS gap FROM d WHERE regexp_matches(t, {p})))""")
    return " UNION ALL ".join(kinds)


def _codes_sql() -> str:
    """The rounds one after the other, each as a table of assignments and one of entries."""
    v, n = vector_codes, f"(len(embedding) // {vector_codes.PARTS})"
    steps = [f"""e AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, [floor({v.SCALE} * y::DOUBLE)::BIGINT for y in embedding[p * {n} + 1:(p + 1) * {n}]] AS v FROM e, range({v.PARTS}) r(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v AS b FROM x QUALIFY k < {v.ENTRIES})"""]
    for r in range(v.ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, p, v, min((list_sum([(y[1] - y[2]) * (y[1] - y[2]) for y in list_zip(v, b)])::BIGINT, k)) AS m FROM x JOIN b{r} USING (p) GROUP BY ALL)")
        if r < v.ROUNDS:
            steps.append(f"""s{r} AS (SELECT p, k, list(floor(s / n)::BIGINT ORDER BY i) AS b FROM (SELECT p, m[2] AS k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, unnest(range(1, len(v) + 1)) u(i) GROUP BY ALL) GROUP BY p, k),
b{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(s{r}.b, b{r}.b) AS b FROM b{r} LEFT JOIN s{r} USING (p, k))""")
    return "WITH " + ",\n".join(steps) + f"""
, c AS (SELECT vec_id, label, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM a{v.ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, k)) FROM b{v.ROUNDS}) AS codebooks_sha256 FROM c
"""


_BASE_KINDS = ", ".join(f"'{k}'" for k in secrets.BASE)
_SPAN_COUNTS = ", ".join(f"(count(*) FILTER (kind = '{k}'))::BIGINT AS n_{k}" for k in secrets.BASE)

ORACLE_SQL = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM starts),
firsts AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM grams),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM firsts WHERE f < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op3_mixing": r"""
WITH s AS (SELECT doc_id, source, md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
b AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER ()
        - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM b),
w AS (SELECT arg_min(level, (source_size / weight, source)) AS water FROM l WHERE level * weight < 3 * source_size),
t AS (SELECT source, source_size, CASE WHEN water IS NULL OR water * weight > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE water * weight END AS target FROM b, w),
r AS (SELECT s.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
        ('0x' || substr(h, 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS draw
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
""",
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, (count(*) OVER g)::BIGINT AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
FROM d WINDOW g AS (PARTITION BY text)
""",
    "op8_urls": f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, v) AS (VALUES {_RULES}),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
      FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN {_GLOBS} THEN 'block' ELSE 'allow' END) AS verdict FROM s LEFT JOIN m USING (page_id)
""",
    "op6_secrets": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, kind, k, a, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS span FROM ({_spans_sql()}) WHERE size >= least),
g AS (SELECT doc_id, {_SPAN_COUNTS}, string_agg(span, ',' ORDER BY a, k) FILTER (kind IN ({_BASE_KINDS})) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
""",
    "op10_embeddings": f"""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {embedding_dedup.COSINE}),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS least FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id <= coalesce(least, vec_id) AS kept FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
""",
    "op11_hard_negatives": f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({hard_negatives.SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum([y[1] * y[2] for y in list_zip(a.v, b.v)])::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {hard_negatives.POSITIVES})
SELECT a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY a, p.b ORDER BY s.score DESC, s.b))::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (a) WHERE NOT same AND {hard_negatives.FAR} * p.score <= 100 * s.score AND 100 * s.score <= {hard_negatives.NEAR} * p.score QUALIFY rank <= {hard_negatives.NEGATIVES}
""",
    "op12_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos, w FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[pos:pos + n - 1], ' ') AS t FROM g),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM windows)),
hits AS (SELECT doc_id, pos, windows.n, item FROM starts JOIN windows ON windows.n = starts.n AND array_to_string(w[pos:pos + starts.n - 1], ' ') = t),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op13_vector_codes": _codes_sql(),
}
