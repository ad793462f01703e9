"""Ties, nulls and reordering in the folds."""

from tracelake.functions import metrics as m
from tracelake.functions import text as t
from tracelake.operators import detectors, folds
from tracelake.sources import store

RUN = "seq long, ts long, phase_id string, phase_doc_path string, project_id string, architect_verdict string, bounces_to_approval long, bugs_filed long, warnings long"
REVIEW = RUN + ", failure_class array<string>"


def test_review_ties_and_latest_runs(spark):
    runs = spark.createDataFrame([(1, 5, "a", "p", None, "old", 1, 1, 1), (2, 9, "a", "p", None, None, None, None, None), (3, 9, "a", "p", None, None, None, None, None), (4, 9, "a", None, None, None, None, None, None)], RUN)
    reviews = spark.createDataFrame([(1, 7, "a", "p", None, "first", None, 2, 3, []), (2, 7, "a", "p", None, "second", 5, 2, 3, [])], REVIEW)
    got = {r["seq"]: r for r in folds.fold_reviews(runs.repartition(3), reviews.repartition(2)).collect()}
    assert [got[i]["architect_verdict"] for i in (1, 2, 3, 4)] == ["old", "first", "first", None]
    assert got[2]["bounces_to_approval"] is None and got[2]["bugs_filed"] == 2


def test_last_write_wins_keeps_null_keys_and_first_place(spark):
    rows = spark.createDataFrame([(1, None, "x", 1), (2, "p", "x", 2), (3, None, "x", 3)], "seq long, project string, s string, v long")
    got = {(r["project"], r["v"], r["first_seq"]) for r in folds.last_write_wins(rows, ["project", "s"]).collect()}
    assert got == {(None, 3, 1), ("p", 2, 2)}


def test_scalars(spark):
    one = spark.range(1)
    from pyspark.sql import functions as F

    assert one.select(m.run_id(F.lit(1717000000000), F.lit("m"), F.lit("phase-01"))).first()[0] == "edb92851"
    ms = lambda s: one.select(m.zulu_millis(F.lit(s))).first()[0]
    assert ms("2024-01-02T03:04:05.6789Z") == 1704164645678 and ms("1970-01-01T00:00:01") == 1000
    assert ms("2023-02-31T00:00:00Z") == ms("2023-03-03T00:00:00Z") and ms("x") == 0 and ms("2023-13-01T00:00:00Z") == 0
    assert one.select(t.collapse_lines(F.lit("a\na\n\x1b[31mb\x1b[0m"))).first()[0] == "a (x2)\nb\n"
    assert one.select(t.luhn(F.lit("4111111111111111")), t.luhn(F.lit("4111111111111112"))).first() == (True, False)
    assert one.select(t.redact_secrets(F.lit("x token=sk-aaaaaaaaaaaaaaaaaaaaaaaa y"))).first()[0] == "x [REDACTED:tagged_value] y"
    assert one.select(t.strip_thinking(F.lit("<think>a</think>\nb<think>c"))).first()[0] == "b"
    assert one.select(m.nearest_rank(F.array(*[F.lit(i) for i in range(1, 7)]), 0.9)).first()[0] == 6


def test_persistence_falls_start_anew(spark):
    rows = [("s", i, e) for i, e in enumerate([1, 2, 2, 1, 1, 0, 3])]
    log = spark.createDataFrame(rows, "session string, seq long, errors long")
    assert detectors.persistence(log).first()["value"] == 3
    assert detectors.persistence(spark.createDataFrame([("z", i, 0) for i in range(4)], "session string, seq long, errors long")).first()["value"] == 0


def test_store_reads_folds_and_compacts(spark, tmp_path):
    led = '{"record":"architect_ledger","session_id":"s","model":"m","skill":"k","tokens":{"input":%d},"schema_version":1}'
    lines = [led % 1, "", "{broken", '{"ts":1}', led % 2, '{"record":"review","ts":1,"phase_id":"a","architect_verdict":"v","failure_class":[],"schema_version":1}', '{"record":"odd","schema_version":1}', '{"record":"review","schema_version":2}']
    (tmp_path / "store.jsonl").write_text("\n".join(lines))
    s = store.lines(spark, str(tmp_path / "store.jsonl"))
    assert [r["tokens"]["input"] for r in store.records(s, "architect_ledger").orderBy("seq").collect()] == [1, 2]
    assert store.records(s, "review").count() == 1
    assert [r["class"] for r in store.classified(s).orderBy("seq").collect()] == ["superseded", "blank", "malformed", "legacy_run", "architect_ledger", "review", "other", "other"]
    assert [r["value"] for r in store.compacted(s).collect()] == [lines[4], lines[5]]
    store.append(store.records(s, "review"), str(tmp_path / "out"), "review")
    assert store.records(store.lines(spark, str(tmp_path / "out")), "review").count() == 1


def test_store_orders_files_by_batch(spark, tmp_path):
    """Of several files the newest row wins, in any folder layout; compaction keeps it, its place and the order of lines."""
    path = str(tmp_path / "store")
    row = lambda n: spark.createDataFrame([(n, "s", "m", "k", n)], "seq long, session_id string, model string, skill string, messages long").selectExpr("*", "struct(seq as input) as tokens").repartition(3)
    for n in (3, 1, 2):
        store.append_ledger(row(n), path)
    seen = lambda p: folds.last_write_wins(store.records(store.lines(spark, p), "architect_ledger"), ["session_id", "model", "skill"]).first()["messages"]
    assert seen(path) == 2
    classes = {r["class"]: r["n"] for r in store.compact(spark, path, str(tmp_path / "small")).collect()}
    assert classes == {"superseded": 2, "architect_ledger": 1} and seen(str(tmp_path / "small")) == 2
    store.append_ledger(row(9), str(tmp_path / "small"))
    assert seen(str(tmp_path / "small")) == 9
    big = tmp_path / "big.jsonl"
    big.write_text("".join('{"record":"odd","n":%d}\n' % i for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = store.lines(spark, str(big))
        assert got.rdd.getNumPartitions() > 3
        assert [r["value"] for r in got.orderBy("seq").collect()] == big.read_text().splitlines()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert store.lines(spark, str(tmp_path / "none")).count() == 0


def test_one_scan_equals_single_reads(spark, tmp_path):
    led = '{"record":"architect_ledger","session_id":"s","model":"m","skill":"k","tokens":{"input":%d},"schema_version":1}'
    act = '{"record":"architect_activity","ts":1,"phase_id":"p","activity":"draft","schema_version":1}'
    (tmp_path / "s.jsonl").write_text("\n".join([led % 1, act, led % 2 + led % 3, "x", act.replace('"schema_version":1', '"schema_version":2'), ""]))
    s = store.lines(spark, str(tmp_path / "s.jsonl"))
    for kind, frame in store.multiplexed(s).items():
        assert sorted(map(str, frame.collect())) == sorted(map(str, store.records(s, kind).collect()))
    assert store.multiplexed(s)["architect_ledger"].count() == 1
    unknown = store.append_review(spark.createDataFrame([(1, "p", "v", ["none", "odd"])], "ts long, phase_id string, architect_verdict string, failure_class array<string>"), str(tmp_path / "out"))
    assert [r[0] for r in unknown.collect()] == ["odd"]


def test_sweep_appends_only_what_changed(spark, tmp_path):
    from tracelake.streaming import sweep

    src, out = tmp_path / "in", str(tmp_path / "ledger")
    src.mkdir()
    (src / "a.json").write_text('{"k":"a","v":1,"seq":1}\n{"k":"a","v":2,"seq":2}\n')
    for number in (1, 2):
        stream, _ = sweep.follow(spark, str(src), "k string, v long, seq long")
        sweep.harvest_sweep(stream, out, ["k"], str(tmp_path / "cp")).awaitTermination()
        (src / "b.json").write_text('{"k":"a","v":2,"seq":1}\n{"k":"b","v":5,"seq":2}\n')
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect()) == [("a", 2), ("b", 5)]
