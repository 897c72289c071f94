"""The pipeline's stages, each on what the one before kept, against plain models."""

import random
import re
from collections import Counter
from hashlib import sha256

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_operators import linked, plain_simhash  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    r = random.Random(8)
    rows = []
    for k in range(600):
        junk = k % 5 == 0
        rows.append((k, " ".join((f"JUNK{r.randrange(9)}###" if junk else f"word{r.randrange(400)}") for _ in range(r.randrange(20, 90))), "en", f"s{k % 4}", 0, 1, "x", 2))
    rows += [(1000 + k, rows[k][1], "en", "s1", 0, 1, "x", 2) for k in range(1, 40)]
    rows += [(2000 + k, rows[k][1] + " word1", "en", "s2", 0, 1, "x", 2) for k in range(1, 40)]
    rows += [(3000, None, "en", None, 0, 1, "x", 2), (3001, "", "en", "s1", 0, 1, "x", 2), (3002, rows[7][1], None, "s1", 0, 1, "x", 2), (3002, rows[7][1], None, "s1", 0, 1, "x", 2)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, score string, target int").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept[name] = [(r.doc_id, r.text) for r in out.collect()]
        assert {r["size"] for r in out.collect()} == {1} and {r.score for r in out.collect()} == {"x"}
        docs = out
    first = {i for i, _ in kept["quality"]}
    assert len([i for i in first if i < 600 and i % 5 == 0]) <= 3 and len([i for i in range(600) if i % 5 and i in first]) > 470
    texts = {}
    for i, t in kept["quality"]:
        texts[t or ""] = max(i, texts.get(t or "", i))
    assert sorted(kept["exact_dedup"]) == sorted(((i, t) for i, t in set(kept["quality"]) if texts[t or ""] == i), key=lambda x: x[0])
    data = sorted(kept["exact_dedup"])
    fps = [plain_simhash(t) for _, t in data]
    roots = linked(len(data), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    least = {}
    for (i, _), root in zip(data, roots):
        least[root] = min(i, least.get(root, i))
    assert sorted(i for i, _ in kept["near_dedup"]) == sorted(least.values())
    assert set(kept["mixing"]) <= set(kept["near_dedup"]) and max(Counter(kept["mixing"]).values()) <= 3
    whole = corpus_pipeline.run(spark, sf).collect()
    words = Counter()
    for r in whole:
        words[r.doc_id] += r.n_words
    want = Counter()
    for i, t in kept["mixing"]:
        want[i] += len(WORD.findall(t or ""))
    assert +words == +want


def test_near_copies_are_dropped_by_row(spark):
    """Null and reused doc_ids: one row of each component stays, and no row goes for its doc_id alone."""
    r = random.Random(3)
    text = lambda: " ".join(f"word{r.randrange(4000)}" for _ in range(120))
    a, b, c, d, e, f, g = (text() for _ in range(7))
    near = {t: t.upper() for t in (a, b, c, d)}  # words fold, so the fingerprints agree
    rows = [(1, a), (None, near[a])]  # a named row and its nameless near copy
    rows += [(None, t) for t in (e, f)]  # nameless, without copies
    rows += [(None, b), (None, near[b])]  # nameless both
    rows += [(7, c), (7, near[c]), (7, g)]  # one doc_id, two near copies and another text
    rows += [(2, d), (9, near[d]), (9, text())]  # a dropped doc_id whose other text stays
    rows += [(5, text())] * 3 + [(None, text())] * 2  # equal rows
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, fp string").repartition(3)
    roots = linked(len(rows), lambda i, j: (plain_simhash(rows[i][1]) ^ plain_simhash(rows[j][1])).bit_count() <= 3)
    least = {}
    for (i, t), root in zip(rows, roots):
        at = (i is None, i or 0, sha256(t.encode()).hexdigest())
        least[root] = min((at, (i, t)), least.get(root, (at, (i, t))))
    want = sorted((x for _, x in least.values()), key=repr)
    assert len(want) == 10 and {(None, e), (None, f), (7, g)} <= set(want)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns and sorted(((q.doc_id, q.text) for q in out.collect()), key=repr) == want


def test_empty_tables(spark, sf, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
