"""The marketplace library against goldens, a plain model and DuckDB."""

import json
import random

import duckdb
import pytest
from model import managed, views_of
from pyspark.sql import functions as F

from ledgerloom import params
from ledgerloom.functions import decode, probability, text
from ledgerloom.operators import calibration, evidence, features, jobs, lifecycle, mining
from ledgerloom.plans import queries
from ledgerloom.sources import journal, logs
from ledgerloom.streaming import live

SF = "/root/testdata/sf0.001"
NOW = 51_000_000


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def random_events(seed, n=60):
    r = random.Random(seed)
    rows, log = [], 0
    order = []
    for job in range(n):
        b = 1 + r.randrange(40)
        client, provider = f"c{r.randrange(3)}", f"p{r.randrange(3)}"
        order.append((b, "JobCreated", job, dict(client=client, provider=provider, expired_at=2 * b + 40)))
        for _ in range(r.randrange(3)):
            order.append((b + r.randrange(3), "BudgetSet", job, dict(amount=r.choice([0, 5, 60_000, 300_000]))))
        if r.random() < 0.8:
            fb = b + r.randrange(3)
            order.append((fb, "JobFunded", job, dict(amount=r.choice([0, 5, 60_000, 300_000]), funder=client)))
            for _ in range(r.randrange(3)):
                kind = r.choice(params.TERMINAL)
                order.append((fb + r.randrange(4), kind, job, dict(rejector=r.choice([client, provider])) if kind == "JobRejected" else {}))
        elif r.random() < 0.5:
            order.append((b + r.randrange(5), "JobExpired", job, {}))
    r.shuffle(order)
    for b, kind, job, payload in sorted(order, key=lambda x: x[0]):
        log += 1
        rows.append({f.name: None for f in decode.EVENT} | dict(kind=kind, job_id=job, block=b, log_index=log, ts=2 * b) | payload)
    return rows


def test_decode_round_trip_and_odd_logs(spark):
    raw = lambda **k: {"address": "0xA", "topics": None, "data": "0x", "blockNumber": "0x1", "logIndex": "0x0", "blockTimestamp": None, "removed": None} | k
    pad = lambda x: "0x" + x.rjust(64, "0")
    sig = params.SIGNATURES
    a = "AB" * 20
    rows = [
        raw(topics=[sig["JobCreated"].upper().replace("0X", "0x"), pad("1"), pad(a), pad("cd" * 20)], data="0x" + "0" * 64 + "64".rjust(64, "0")),
        raw(topics=[sig["JobFunded"], pad(hex(76935)[2:]), pad(a)], data=pad(hex(10_000)[2:])),
        raw(topics=["0xdead", pad("1")]),
        raw(topics=[]),
        raw(topics=[sig["BudgetSet"]]),
        raw(topics=[sig["JobCreated"], pad("2")]),
        raw(topics=[sig["BudgetSet"], pad("3")], data=pad("f" * 16)),
        raw(topics=[sig["BudgetSet"], pad("4")], removed=True),
        raw(topics=[sig["BudgetSet"], pad("5")]),
        raw(topics=[sig["JobCompleted"], pad("6"), pad("0")]),
    ]
    got = {r.job_id: r for r in decode.decode(spark.createDataFrame(rows, decode.RAW)).collect()}
    assert sorted(got) == [1, 2, 3, 5, 6, 76935]
    assert (got[1].client, got[1].provider, got[1].evaluator, got[1].expired_at, got[1].ts) == ("0x" + a.lower(), "0x" + "cd" * 20, None, 100, None)
    assert got[76935].amount == 10_000 and got[2].client is None and got[3].amount is None and got[5].amount == 0
    assert got[6].evaluator == "0x" + "0" * 40
    assert one(spark, decode.to_usdc(F.lit(10_000))) == 0.01 and one(spark, decode.from_usdc(F.lit(0.25))) == 250_000
    assert one(spark, decode.hex_to_decimal(F.lit("0x" + "f" * 20))) == int("f" * 20, 16)
    assert one(spark, decode.short_address(F.lit("0x" + "12" * 20))) == "0x1212…1212"


def test_probability_goldens(spark):
    rate = lambda c, f: one(spark, probability.shrunk_rate(F.lit(c), F.lit(f)))
    assert round(rate(0, 0), 4) == 0.7947 and 0.5 < rate(0, 3) < 0.7947 and round(rate(110, 168), 4) == 0.6626
    w = lambda age: one(spark, probability.evidence_weight(F.lit(age)))
    assert w(43_200) == 0.5 and w(216_000) == 0 and w(215_999) > 0 and w(-5) == 1
    assert one(spark, probability.reliability(F.lit(0.0), F.lit(0.0))) == 0.4669
    assert one(spark, probability.logit(F.lit(None).cast("double"))) is None
    assert abs(one(spark, probability.sigmoid(probability.logit(F.lit(0.3)))) - 0.3) < 1e-12


def test_promises(spark):
    obs = lambda *kept: spark.createDataFrame([("p", "availability", k, NOW - 10 + k, x) for k, x in enumerate(kept)], "provider string, declaration_type string, job_id long, block long, confirmed boolean")
    none = spark.createDataFrame([], "provider string, declaration_type string, job_ref long, status string, declared_at_block long")
    at = lambda o, b=NOW: evidence.response_reliability(o, none, b).first()["reliability"]
    assert at(obs(False)) < 0.4669 <= at(obs(False, True)) and at(obs(True, False, False)) < 0.4669
    assert at(obs(False), NOW + 216_000) == 0.4669
    declared = spark.createDataFrame([("P", "availability", k, "available", 1) for k in range(5)], none.schema)
    assert evidence.response_reliability(obs(True), declared, NOW).first()["coverage"] == 0.2
    twice = obs(True).unionByName(obs(True).withColumn("confirmed", F.lit(False)).withColumn("block", F.col("block") + 1))
    assert [r.confirmed for r in evidence.first_observations(twice).collect()] == [True]


def test_curve_by_sums_equals_the_copies(spark, monkeypatch):
    """Every block as a grid point, lives that end inside and at the borders of buckets."""
    from ledgerloom.operators import evidence

    r = random.Random(4)
    rows = [(f"p{r.randrange(3)}", "availability", k, r.randrange(90) if k % 5 else 1000 + k, r.random() < 0.5) for k in range(60)]
    df = spark.createDataFrame(rows, "provider string, declaration_type string, job_id long, block long, confirmed boolean")
    for step, expiry, half in ((1, 40, 9), (3, 50, 100), (1, 17, 2)):
        found = []
        for copies in (10_000, 0):
            monkeypatch.setattr(evidence, "COPIES", copies)
            found.append({tuple(x[:3]): x[3:] for x in evidence.reliability_curve(df, step, expiry, half).collect()})
        assert found[0].keys() == found[1].keys() and len(found[0]) > 50
        assert all(abs(a - b) < 1e-9 for k, x in found[0].items() for a, b in zip(x, found[1][k]))


def test_evidence_export(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"provider": "0xA", "observations": [{"block": 5, "confirmed": True, "job": 7}]}))
    assert [tuple(r) for r in logs.read_evidence(spark, str(tmp_path / "e.json")).collect()] == [("0xa", "availability", 7, 5, True)]


def test_exports_share_files(spark, tmp_path):
    """300 providers in a few files, each export whole and the providers' names as written."""
    rows = [(f"0xa{k % 300}", "availability", k, k + 5, k % 3 == 0) for k in range(900)]
    df = spark.createDataFrame(rows, "provider string, declaration_type string, job_id long, block long, confirmed boolean")
    logs.write_evidence(df, str(tmp_path / "e"), size=200)
    found = [json.loads(f.read_text()) for f in (tmp_path / "e").glob("part-*")]
    exports = [x for held in found for x in held]
    assert len(found) <= 5 and len(exports) == 300 and all(len(x["observations"]) == 3 and x["provider"].startswith("0XA") for x in exports)
    assert sorted(tuple(r) for r in logs.read_evidence(spark, str(tmp_path / "e")).collect()) == sorted(rows)
    logs.write_evidence(df.limit(0), str(tmp_path / "none"))
    assert logs.read_evidence(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_views_match_the_plain_model(spark, seed):
    rows = random_events(seed)
    want, _ = views_of(rows)
    df = spark.createDataFrame(rows, decode.EVENT).repartition(3)
    got = features.decision_views(df).select(
        "job_id", "provider", "client", "funding_block", "amount", "budget_set_count", "expiry_window", "funding_delay", "provider_prior_funded", "provider_prior_completed",
        "provider_prior_rejected_by_self", "provider_prior_expired", "provider_median_completed_amount", "provider_blocks_since_first_seen", "provider_blocks_since_last_activity",
        "provider_concurrent_open", "client_prior_created", "client_prior_funded", "pair_prior_jobs", "pair_prior_completed",
    )
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_later_events_change_no_view(spark):
    rows = random_events(9)
    early = [r for r in rows if r["block"] <= 20]
    every = {tuple(r) for r in features.decision_views(spark.createDataFrame(rows, decode.EVENT)).where("funding_block <= 20").collect()}
    assert every == {tuple(r) for r in features.decision_views(spark.createDataFrame(early, decode.EVENT)).collect()}


def test_rule_lifecycle():
    r = random.Random(3)
    for trial in range(30):
        outcomes = [r.random() < 0.3 for _ in range(40)]
        match = [{"rule_id": "R-1", "field": "amount", "delta_logit": -1.0, "baseline_rate": 0.5}]
        rows = []
        for k, done in enumerate(outcomes):
            rows.append({"provider": "p", "phase": 0, "block": 2 * k, "log_index": 0, "job_id": k, "matches": match})
            rows.append({"provider": "p", "phase": 1, "block": 2 * k + 1, "log_index": 0, "job_id": k, "completed": done})
        end = [x for x in lifecycle.fold(iter(rows)) if x[0] == "rule"]
        assert [(x[9], x[10], x[11]) for x in end] == [managed(outcomes, -1.0, 0.5)]
    two = [{"rule_id": "R-10", "field": "amount", "delta_logit": -2.0, "baseline_rate": 0.5}, {"rule_id": "R-9", "field": "amount", "delta_logit": -2.0, "baseline_rate": 0.5}]
    assert [x[0] for x in lifecycle.strongest(two, {})] == ["R-10"]


def test_ladder_holds_as_matched(spark):
    rule = spark.createDataFrame([("R-1", "p", "amount", ">", 500_000.0, 1)], "rule_id string, subject string, field string, op string, value double, created_at_block long")
    row = {f: 250_000.0 if f == "amount" else 0.0 for f in params.FIELDS}
    views = spark.createDataFrame([(1, "p", 5, 0, *row.values())], "job_id long, provider string, funding_block long, log_index long, " + ", ".join(f"{f} double" for f in row))
    assert mining.rule_matches(views, rule).count() == 0
    assert mining.rule_matches(views, rule.withColumn("value", F.lit(50_000.0))).count() == 1
    assert mining.rule_matches(views, rule.withColumn("value", F.lit(50_000.0)).withColumn("created_at_block", F.lit(5))).count() == 0


def test_threshold_needs_support(spark):
    rows = [(7, b, 100 if b in (3, 8) else 0, 20 if b == 3 else 90 if b == 8 else 0) for b in range(10)]
    df = spark.createDataFrame(rows, "block long, bin int, n long, hits long")
    assert calibration.thresholds(df).first()["hire_threshold"] == 0.0  # bin 0 qualifies once all episodes do
    assert calibration.thresholds(df.where("bin <> 3")).first()["hire_threshold"] == 0.5


def test_texts(spark):
    cases = {"nope": "unparseable", '{"x": 1}': "missing text", '{"text": 5}': "missing text", '{"text": "  "}': "empty text", '{"text": "a b"}': "ok", json.dumps({"text": "w " * 2001}): "text too long"}
    df = spark.createDataFrame([(k,) for k in cases], "payload string")
    assert {r.payload: r.v for r in df.select("payload", text.validate(F.col("payload")).alias("v")).collect()} == cases
    summary = lambda t: one(spark, text.extractive_summary(F.lit(t)))
    assert summary(" A b.  C!? D. E.") == "A b.  C!?  D." and summary("x" * 400) == "x" * 300 and summary("...A. B") == "A."


def test_journal(spark, tmp_path):
    path = str(tmp_path / "j")
    views = spark.createDataFrame([(1, "p", "c", 5, 0, 10, 0.7947, 0.61237)], "job_id long, provider string, client string, funding_block long, log_index long, amount long, p0 double, p_final double")
    eps = spark.createDataFrame([(1, 0.5, "success", 0.61237, True, 0.15, 9, None, False)], "job_id long, hire_threshold double, outcome string, predicted double, correct boolean, brier double, resolved_at_block long, failure_kind string, inferred_expiry boolean")
    rows = journal.decision_rows(views).unionByName(journal.episode_rows(eps))
    journal.append(rows, path)
    assert journal.append_above(spark, rows, path) == 9
    held = journal.read(spark, path)
    assert held.count() == 2 and journal.rebuild(held, {"accuracy": 1.0}).first()["accuracy_agrees"]
    assert [r.type for r in journal.audit_trail(held, provider="p").collect()] == ["decision", "episode"]
    assert journal.under_policy(views, "none").count() == 0


def test_one_jobs_trail_reads_one_folder(spark, tmp_path):
    decisions = [(f"decision:{j}", "decision", j, f"p{j % 7}", j) for j in range(400)]
    episodes_ = [(f"episode:{j}", "episode", j, None, j + 5) for j in range(0, 400, 2)]
    rows = spark.createDataFrame(decisions + episodes_, "id string, type string, job_id long, provider string, block long").repartition(6)
    rows = rows.withColumns({"predicted_at_block": F.when(F.col("type") == "decision", F.col("block")), "resolved_at_block": F.when(F.col("type") == "episode", F.col("block"))}).drop("block")
    path = str(tmp_path / "journal")
    for _ in range(2):  # the second time every id comes again
        journal.append(journal._full(rows), path)
    assert journal.read(spark, path).count() == 600
    whole = journal.audit_trail(journal.read(spark, path), job_id=42)
    own = journal.trail_of_job(spark, path, 42)
    assert [tuple(x) for x in own.collect()] == [tuple(x) for x in whole.select(own.columns).collect()] and own.count() == 2
    files = list((tmp_path / "journal").rglob("*.parquet"))
    read = {x[0] for x in journal.stored(spark, path, 42).select(F.input_file_name()).distinct().collect()}
    plan = journal.stored(spark, path, 42)._jdf.queryExecution().toString()
    assert 0 < len(read) < 0.08 * len(files) and "Exchange" not in plan and "PartitionFilters: [isnotnull(bucket" in plan


def test_live_tail_settles_what_batch_decodes(spark, tmp_path):
    events = spark.createDataFrame(random_events(4), decode.EVENT)
    raw = decode.encode(queries._addressed(events)).select("*", F.col("blockNumber").alias("_b")).collect()
    for k, part in enumerate([raw[:50], raw[50:90], raw[90:]]):
        rows = [json.dumps({c: r[c] for c in decode.RAW.fieldNames()}) for r in part]
        (tmp_path / "logs").mkdir(exist_ok=True)
        (tmp_path / "logs" / f"{k}.json").write_text("\n".join(rows + rows[:3]))
    for _ in range(2):  # a restart adds nothing
        live.tail(logs.stream_logs(spark, str(tmp_path / "logs")), str(tmp_path / "landed"), str(tmp_path / "out"), str(tmp_path / "check"), confirmations=5).awaitTermination()
    last = max(r["block"] for r in random_events(4))
    got = sorted(r.log_index for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r["log_index"] for r in random_events(4) if r["block"] <= last - 5)


def test_snapshots_roll_forward(spark):
    state = features.with_job_state(spark.createDataFrame(random_events(6), decode.EVENT))
    whole = live.roll_forward(None, state)
    parts = live.roll_forward(live.roll_forward(None, state.where("block <= 20")), state.where("block > 20"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_views_open_with_the_snapshot(spark):
    state = features.with_job_state(spark.createDataFrame(random_events(7), decode.EVENT)).cache()
    old, new = state.where("block <= 20"), state.where("block > 20")
    for keys, asof in ((("provider",), features.provider_asof), (("client",), features.client_asof), (("client", "provider"), features.pair_asof)):
        names = [*features.VIEW, *live.OPENING[keys]]
        whole = asof(state).where("funding_block > 20").select(names)
        part = asof(new).join(state.select("job_id", "client", "provider").where("client is not null and provider is not null").distinct(), "job_id")
        got = live.with_opening(part, live.roll_forward(None, old, *keys), *keys).select(names)
        assert whole.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_streamed_rules_stand_where_the_fold_leaves_them(spark, tmp_path):
    r = random.Random(5)
    rows, at = [], 0
    for k in range(60):
        match = [(f"R-{i}", r.choice(["amount", "repeat_pair"]) if i < 0 else ["amount", "repeat_pair"][i % 2], [-1.0, 1.5, -2.0][i], [0.5, 0.4, 0.6][i]) for i in range(3) if r.random() < 0.7]
        provider = f"p{k % 2}"
        rows.append((provider, at, 0, 0, k, match, None))
        rows.append((provider, at + 1, 1, 0, k, [], r.random() < 0.4))
        at += 2
    schema = "provider string, block long, phase int, log_index long, job_id long, matches array<struct<rule_id:string,field:string,delta_logit:double,baseline_rate:double>>, completed boolean"
    whole = spark.createDataFrame(rows, schema)
    for k in range(3):
        whole.where(f"block div 40 = {k}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    records = [x.asDict(recursive=True) for x in whole.orderBy("provider", "block", "phase").collect()]
    want = list(lifecycle.fold(iter(records)))
    files = sorted((f.stat().st_mtime_ns, json.loads(f.read_text().split("\n")[0])["block"], f) for f in (tmp_path / "in").glob("*.json"))
    got = []
    for k, (_, _, f) in enumerate(sorted(files, key=lambda x: x[1])):  # a file at a time, with a restart after each
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / "src" / f"{k}.json").write_text(f.read_text())
        stream = live.stream_rules(spark.readStream.schema(schema).json(str(tmp_path / "src")))
        stream.writeStream.foreachBatch(lambda b, n: got.append([tuple(x) for x in b.collect()])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    applied = sorted(x for b in got for x in b if x[0] == "applied")
    assert applied == sorted(x for x in want if x[0] == "applied")
    last = {x[5]: x for b in got for x in b if x[0] == "rule" and x[2] == "p0"}
    assert sorted(last.values(), key=lambda x: x[5]) == [x for x in want if x[0] == "rule" and x[2] == "p0"]


def test_streamed_episodes(spark, tmp_path):
    make = lambda kind, job, block, **x: {f.name: None for f in decode.EVENT} | dict(kind=kind, job_id=job, block=block, log_index=block, ts=2 * block) | x
    rows = [make("JobCreated", j, 1, client="c", provider="p", expired_at=40) for j in range(4)] + [make("JobFunded", j, 3) for j in range(3)]
    later = [make("JobCompleted", 0, 5), make("JobRejected", 0, 6), make("JobRejected", 1, 7), make("JobExpired", 3, 8), make("JobCreated", 9, 500, expired_at=5000)]
    end = [make("JobCreated", 10, 600, expired_at=5000)]
    got = []
    (tmp_path / "in").mkdir()
    for k, part in enumerate((rows, later, end, end)):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        events = spark.readStream.schema(decode.EVENT).json(str(tmp_path / "in")).withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", "1 second")
        live.stream_episodes(events).writeStream.foreachBatch(lambda b, n: got.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == [(0, "success", None, 5, False), (1, "failure", "JobRejected", 7, False), (2, "failure", "JobExpired", 3, True)]


QUICK = ["funnel", "provider_table", "rejector_roles", "fee_to_creator", "inflight_jobs", "client_asof", "median_completed_amount", "response_gate", "reliability_curve", "response_verdicts", "pending_requests", "validate_requirements", "requirement_texts", "rule_lifecycle", "ablation"]


@pytest.mark.parametrize("name", QUICK)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "documents", "conversations", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(v) for v in r) for r in con.execute(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall()), key=repr)
    assert got == want


def test_matrix_of_nothing(spark):
    none = spark.createDataFrame([], decode.EVENT)
    assert jobs.job_matrix(none).count() == 0 and jobs.base_rate(jobs.job_matrix(none)).first()["base_rate"] is None
    assert features.decision_views(none).count() == 0
