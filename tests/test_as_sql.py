"""Figures bit for bit as the SQL has them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import probability
from ledgerloom.operators import lifecycle, mining
from ledgerloom.plans import backtest, queries

SF = "/root/testdata/sf0.1"


def test_halves_round_as_in_sql(spark):
    """Rates such as 2739 / 5120 end in a 5 at the tenth place and have no exact double."""
    pairs = [(n, 5120) for n in range(1, 5120, 2)] + [(3 * n, -10240) for n in range(1, 3000)]
    want = duckdb.connect().execute(f"SELECT n, d, round(n / d, 9), round(n / d, 4) FROM (VALUES {', '.join(map(str, pairs))}) v(n, d)").fetchall()
    df = spark.createDataFrame(pairs, "n long, d long").selectExpr("n", "d", "n / d as a", "n / d as b")
    assert sorted(tuple(r) for r in queries.places(queries.places(df, "a"), "b", n=4).collect()) == sorted(want)


def test_logarithms_are_those_of_the_sql(spark):
    """Adjustments of rules such as logit(0.2) - logit(3 / 7) and logit(4 / 23) - logit(12 / 31) are one number, and rank by its last bit."""
    pairs = [(c, m) for m in range(2, 120) for c in range(1, m)]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE v AS SELECT c, m, c / m AS p, ln((c / m) / (1 - c / m)) AS l FROM (VALUES {', '.join(map(str, pairs))}) v(c, m)")
    want = con.execute("SELECT c, m, l, 1 / (1 + exp(-l)) FROM v").fetchall()
    df = spark.createDataFrame(pairs, "c long, m long").select("c", "m", probability.logit(F.expr("c / m")).alias("l"))
    assert sorted(tuple(r) for r in df.withColumn("p", probability.sigmoid(F.col("l"))).collect()) == sorted(want)
    odd = spark.createDataFrame([(-1000.0,), (1000.0,), (None,)], "x double").select(probability.sigmoid(F.col("x")).alias("p"))
    assert sorted((r.p for r in odd.collect()), key=str) == [0.0, 1.0, None]


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """The jobs of one provider two of whose rules on the amount are equally strong but for the last bit, and their backtest."""
    path = tmp_path_factory.mktemp("tied")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE one AS SELECT l_orderkey AS k FROM '{SF}/lineitem.parquet' GROUP BY 1 HAVING min(l_suppkey) = 60")
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        con.execute(f"COPY (SELECT * FROM '{SF}/{name}.parquet' WHERE {key} IN (FROM one)) TO '{path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS FROM '{path}/{name}.parquet'")
    return con, str(path), backtest.prepare(queries.market(spark, str(path)))


@pytest.mark.parametrize("name", ["rule_lifecycle", "predict_with_rules", "reversals", "rule_summary", "ablation"])
def test_tied_rules_rank_as_in_sql(spark, tied, name, monkeypatch):
    con, path, prepared = tied
    monkeypatch.setattr(backtest, "prepare", lambda events, with_rules=True: prepared)
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(str, found.fetchall()))
    assert sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, path).select(columns).collect()) == want


def worn(spark):
    """(the rules at their end, the one that the SQL ranks first): two tied rules meet the same twelve jobs, which all prove them wrong, and ten tell."""
    counts = [("R-1", 1, 5, 3, 7), ("R-2", 4, 23, 12, 31)]
    log = "ln(({0} / {1}) / (1 - {0} / {1}))"
    first = duckdb.connect().execute(f"SELECT id FROM (VALUES {', '.join(map(str, counts))}) v(id, c, m, d, n) ORDER BY abs({log.format('c', 'm')} - {log.format('d', 'n')}) DESC, id").fetchall()[0][0]
    rules = spark.createDataFrame(counts, "rule_id string, c long, m long, d long, n long").withColumns({"subject": F.lit("p"), "field": F.lit("amount"), "baseline_rate": F.expr("d / n")})
    rules = rules.withColumn("delta_logit", mining.adjustment(F.expr("c / m"), F.col("baseline_rate")))
    match = F.sort_array(F.collect_list(F.struct("rule_id", "field", "delta_logit", "baseline_rate"))).alias("matches")
    views = rules.groupBy(F.col("subject").alias("provider"), "field").agg(match).withColumn("job_id", F.explode(F.sequence(F.lit(1), F.lit(12)).cast("array<long>")))
    row = lambda phase, matches, completed: ["provider", "field", (F.col("job_id") * 2 + phase).alias("block"), F.lit(phase).alias("phase"), F.col("job_id").alias("log_index"), "job_id", matches, completed.cast("boolean").alias("completed")]
    none = F.filter("matches", lambda m: F.lit(False)).alias("matches")
    fold = lifecycle.folded(views.select(row(0, "matches", F.lit(None))).unionByName(views.select(row(1, none, F.lit(True)))))
    return lifecycle.rules_at_end(rules, fold), first


def test_the_first_of_tied_rules_is_retired(spark):
    at_end, first = worn(spark)
    assert [r.rule_id for r in lifecycle.retired(at_end).collect()] == [first]


def test_the_other_of_tied_rules_is_still_believed(spark):
    at_end, first = worn(spark)
    assert [(r.rule_id, r.status, r.applications) for r in lifecycle.believed(at_end).collect()] == [({"R-1": "R-2", "R-2": "R-1"}[first], "provisional", 2)]
