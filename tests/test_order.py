"""Numbers, medians and folds that no single task makes alone, against plain ones."""

import json
import random
import statistics

from pyspark.sql import functions as F

from ledgerloom.operators import lifecycle, order
from ledgerloom.streaming import live


def test_numbers_over_ranges(spark):
    r = random.Random(2)
    rows = [(r.randrange(5), k, f"x{k}") for k in range(500)]
    got = order.numbered(spark.createDataFrame(rows, "a int, b int, c string").repartition(7), "n", "a", "b").collect()
    assert [(x.a, x.b, x.c) for x in sorted(got, key=lambda x: x.n)] == sorted(rows) and sorted(x.n for x in got) == list(range(1, 501))
    assert order.numbered(spark.createDataFrame([], "a int"), "n", "a").count() == 0


def test_medians_by_counts_per_range(spark, monkeypatch):
    r = random.Random(4)
    for values in ([5], [5, 5], [1, 2], [-(1 << 60), 1 << 60, 3, 3], [r.randrange(-50, 10**9) for _ in range(301)], [r.choice([1, 10**12]) for _ in range(100)], [None, 4, None, 9]):
        for ranges in (4_096, 3):
            monkeypatch.setattr(order, "RANGES", ranges if max(abs(v or 0) for v in values) < 1 << 40 else 4_096)
            df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
            known = [v for v in values if v is not None]
            assert order.median(df, "v") == (len(known), statistics.median(known))
    assert order.median(df.limit(0), "v") == (0, None)


def test_hot_fields_fold_in_segments(spark):
    """A field with nine tenths of all rows folds in many tasks; segments that began with a wrong guess fold again."""
    r = random.Random(6)
    rows, at = [], 0
    for k in range(500):
        hot = r.random() < 0.9
        provider, field = ("p0", "amount") if hot else (f"p{k % 3}", "repeat_pair")
        drift = 0.2 if (k // 120) % 2 or k > 360 else 0.8  # rules stand, fall and fail as time goes
        match = [(f"{field}-{i}", field, [-1.0, 1.5, -2.0, 0.7][i], [0.5, 0.4, 0.6, 0.3][i]) for i in range(4) if r.random() < 0.6]
        match += [(f"{field}-late", field, -2.5, 0.9)] if k > 370 and r.random() < 0.7 else []
        rows.append((provider, field, at, 0, 0, k, match, None))
        if r.random() < 0.9:  # some never close
            rows.append((provider, field, at + r.randrange(1, 40), 1, k, k, [], r.random() < drift))
        at += r.randrange(2)
    schema = "provider string, field string, block long, phase int, log_index long, job_id long, matches array<struct<rule_id:string,field:string,delta_logit:double,baseline_rate:double>>, completed boolean"
    df = spark.createDataFrame(rows, schema).repartition(3)
    records = [dict(zip((c.split()[0] for c in schema.split(", ")), x)) for x in rows]
    records = [x | {"matches": [dict(zip(("rule_id", "field", "delta_logit", "baseline_rate"), m)) for m in x["matches"]]} for x in records]
    records.sort(key=lambda x: (x["provider"], x["field"], x["block"], x["phase"], x["log_index"], x["job_id"]))
    want = sorted(lifecycle.fold(iter(records)), key=repr)
    assert {x[9] for x in want if x[0] == "rule"} >= {"demoted", "graduated"}
    for segment in (100_000, 60):
        assert sorted(map(tuple, lifecycle.folded(df, segment=segment).collect()), key=repr) == want


def test_typed_trials_forget_what_never_closes(spark, tmp_path):
    """Rules stand where the batch fold leaves them after restarts; decisions whose time is over leave the state."""
    r, rows = random.Random(9), []
    for k in range(60):
        match = [{"rule_id": f"r{i}", "field": "amount", "delta_logit": [-1.0, 1.5][i], "baseline_rate": 0.5} for i in range(2) if r.random() < 0.8]
        never = k % 4 == 0
        one = {"provider": f"p{k % 2}", "field": "amount", "log_index": k, "job_id": k}
        rows.append(one | {"block": 2 * k, "phase": 0, "matches": match, "completed": None, "until": 4 * k + 1010 if never else None, "ts": 4 * k + 1000})
        if not never:
            rows.append(one | {"block": 2 * k + 1, "phase": 1, "matches": [], "completed": r.random() < 0.4, "until": None, "ts": 4 * k + 1002})
    order_ = lambda x: (x["provider"], x["block"], x["phase"])
    want = list(lifecycle.fold(iter(sorted(rows, key=order_))))
    schema = "provider string, field string, block long, phase int, log_index long, job_id long, matches array<struct<rule_id:string,field:string,delta_logit:double,baseline_rate:double>>, completed boolean, until long, ts long"
    (tmp_path / "in").mkdir()
    got = []
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):
            part = [x for x in rows if x["block"] // 40 == k]
            (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
            stream = spark.readStream.schema(schema).json(str(tmp_path / "in")).withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", "1 second")
            live.stream_trials(stream).writeStream.foreachBatch(lambda b, n: got.append([tuple(x) for x in b.collect()])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        waiting = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "waiting").load()
        assert waiting.count() == 0
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    assert sorted(x for b in got for x in b if x[0] == "applied") == sorted(x for x in want if x[0] == "applied")
    last = {(x[2], x[5]): x for b in got for x in b if x[0] == "rule"}
    assert sorted(last.values()) == sorted(x for x in want if x[0] == "rule")
