"""Streams: detectors with keyed state, files that grow, over batches of any size."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import detectors
from tracelake.streaming import live

STEP = "session long, seq long, tool string, arguments string, mutating boolean, output_bytes long, errors long, blank boolean, feedback string"
TIGHT = {"identical": 3, "persistence": 3, "output": 90, "window": 5, "flood_window": 3, "flood_limit": 200, "stall": 12, "novelty_window": 6, "novelty_floor": 2, "empty": 3, "feedback": 3}


def random_steps(n, sessions, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        tool = r.choice(["patch", "read_file", "search", None])
        rows.append((r.randrange(sessions), i, tool, r.choice(['{"path":"a"}', '{"path":"b"}', None]), r.choice([tool == "patch", tool == "patch", None]), r.choice([0, 50, 95, None]), r.choice([None, None, 0, 1, 2, 2, 3]), r.choice([True, False, False, None]), r.choice([None, "g", "g", "h"])))
    return rows


def streamed(spark, tmp_path, batches, **limits):
    src, cp, out = (str(tmp_path / x) for x in ("in", "cp", "hits"))
    for rows in batches:
        spark.createDataFrame(rows, STEP).coalesce(1).write.mode("append").json(src)
        assert live.live_detectors(spark.readStream.schema(STEP).json(src), cp, out, **limits).awaitTermination(120)
    return sorted(tuple(r) for r in spark.read.parquet(out).collect())


def test_sparse_counts_fire_across_batches(spark, tmp_path):
    """An error count on every 15th step of 105: persistence looks back over 75 steps, further than any window of rows."""
    rows = [(1, i, "read_file", f'{{"path":"{i}"}}', False, 0, 1 + i // 30 if i % 15 == 0 else None, False, None) for i in range(105)]
    want = sorted(tuple(r) for r in detectors.live(spark.createDataFrame(rows, STEP), stall=0).collect())
    assert (1, 75, "persistence") in want and (1, 90, "persistence") in want
    assert streamed(spark, tmp_path, [rows[:70], rows[70:76], rows[76:91], rows[91:]], stall=0) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_of_any_size_give_the_hits_of_one(spark, tmp_path, seed):
    rows = random_steps(260, 4, seed)
    cuts = sorted(random.Random(seed).sample(range(1, 260), 3))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 260])]
    want = sorted(tuple(r) for r in detectors.live(spark.createDataFrame(rows, STEP), terminate_on_novelty=True, **TIGHT).collect())
    assert len({w[2] for w in want}) >= 6
    assert streamed(spark, tmp_path, batches, terminate_on_novelty=True, **TIGHT) == want


@pytest.mark.parametrize("limits", [{}, TIGHT, TIGHT | {"stall": 0, "window": 0, "flood_window": 0, "novelty_window": 0}])
def test_the_rules_equal_the_batch_form(spark, limits):
    """Long sessions through the rules alone, one step at a time."""
    rows = random_steps(1500, 5, 3) + [(9, i, "patch", '{"path":"a"}', True, 40_000, 1, True, "f") for i in range(30)]
    df = spark.createDataFrame(rows, STEP)
    keyed = df.select("*", detectors.call_key().alias("call"), detectors.read_target().alias("target")).orderBy("seq").collect()
    sessions, got = {}, []
    x = detectors.DEFAULTS | limits
    for r in keyed:
        s = sessions.setdefault(r["session"], [None])
        s[0] = live.Session(x, True, s[0])
        hit = s[0].step(r["seq"], r["call"], r["target"], r["mutating"], r["output_bytes"], r["errors"], r["blank"], r["feedback"])
        s[0] = s[0].state()
        assert len(s[0][2]) <= max(x["identical"], x["window"]) and len(s[0][5]) <= x["novelty_window"]
        if hit:
            got.append((r["session"], r["seq"], hit))
    assert sorted(got) == sorted(tuple(r) for r in detectors.live(df, terminate_on_novelty=True, **limits).select("session", "seq", F.col("detector")).collect())


def test_repeats_are_ignored_and_silent_sessions_forgotten(spark, tmp_path):
    import time

    row = lambda i: (1, i, "patch", '{"path":"a"}', True, 0, None, False, None)
    assert streamed(spark, tmp_path, [[row(0), row(1)], [row(1), row(0)], [row(2)]], identical=3) == [(1, 2, "identical")]
    (tmp_path / "time").mkdir()
    src, cp, out = (str(tmp_path / "time" / x) for x in ("in", "cp", "hits"))
    timed, hour = STEP + ", at long", 3_600_000
    at = lambda i, t, session=1: (session, *row(i)[1:], t * hour)
    # session 1 falls silent while session 2 goes on; session 3 comes back in time
    for rows in ([at(0, 0), at(1, 1), at(0, 1, 3)], [at(0, 30, 2), at(1, 20, 3)], [at(1, 31, 2)], [at(2, 32), at(3, 33), at(2, 33, 3)]):
        spark.createDataFrame(rows, timed).coalesce(1).write.mode("append").json(src)
        steps = spark.readStream.schema(timed).json(src).withColumn("time", F.timestamp_millis("at"))
        live.live_detectors(steps, cp, out, identical=3, time="time", keep_ms=12 * hour, delay="12 hours").awaitTermination(60)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(3, 2, "identical")]
    with pytest.raises(ValueError):
        live.detected(spark.readStream.schema(STEP).json(src), odd=1)


def test_streamed_hits_number_the_steps_once(spark, sf, monkeypatch):
    """The three batches are cut from one pass over the events, and a step takes one column into Python."""
    from tracelake.plans import catalogue

    seen, whole, narrow, real = spark.sparkContext.accumulator(0), catalogue.a.steps(spark, sf), [], live.detected

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(catalogue.a, "steps", lambda *_: whole.mapInArrow(counted, whole.schema))
    monkeypatch.setattr(live, "detected", lambda *a, **k: narrow.append(real(*a, **k)) or narrow[-1])
    hits = catalogue.QUERIES["streamed_hits"](spark, sf)
    assert seen.value == whole.count() > 0
    assert sorted(map(tuple, hits.collect())) == sorted(tuple(r) for r in detectors.live(whole, terminate_on_novelty=True, **catalogue._LIMITS).select("session", "seq", "detector").collect())
    assert all("step#" in n._jdf.queryExecution().analyzed().toString() for n in narrow) and len(narrow) == 3


def test_growing_files_are_read_once(spark, tmp_path):
    """Appends in the middle of a line and of a character, new, replaced and removed files, restarts between all of them."""
    from tracelake.sources import tail

    logs, cp, out = tmp_path / "logs", str(tmp_path / "cp"), str(tmp_path / "out")
    (logs / "sub").mkdir(parents=True)

    def run():
        q = tail.growing(spark, f"file://{logs}", ".jsonl").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted((r["file"].rsplit("/", 1)[1], r["offset"], r["value"]) for r in spark.read.parquet(out).collect())

    def append(name, data):
        with open(logs / name, "ab") as f:
            f.write(data)

    word = "zwölf".encode()
    append("a.jsonl", b'{"n":1}\r\n\n{"n":' + word[:3])
    append("sub/b.jsonl", b"no end")
    append("other.txt", b"x\n")
    append("_hidden.jsonl", b"x\n")
    first = [("a.jsonl", 0, '{"n":1}'), ("a.jsonl", 9, "")]
    assert run() == first and run() == first
    append("a.jsonl", word[3:])
    assert run() == first
    append("a.jsonl", b"}\nlast\npart")
    append("sub/b.jsonl", b"\n\xff\n")
    second = sorted([*first, ("a.jsonl", 10, '{"n":zwölf}'), ("a.jsonl", 23, "last"), ("b.jsonl", 0, "no end"), ("b.jsonl", 7, "�")])
    assert run() == second
    (logs / "sub" / "b.jsonl").unlink()
    (logs / "a.jsonl").write_bytes(b"new\n")
    append("c.jsonl", b"c\n")
    assert run() == sorted([*second, ("a.jsonl", 0, "new"), ("c.jsonl", 0, "c")])


def test_parts_of_a_growing_file(tmp_path, monkeypatch):
    from tracelake.sources import tail

    r = random.Random(5)
    lines = ["x" * r.choice([0, 1, 3, 20, 90]) for _ in range(300)]
    (tmp_path / "a").write_text("\n".join(lines) + "\nunfinished")
    files, want, at = tail.Files(f"file://{tmp_path}", ""), [], 0
    for line in lines:
        want.append((at, line))
        at += len(line) + 1
    for part, block in ((7, 5), (64, 16), (1 << 20, 1 << 16)):
        monkeypatch.setattr(tail, "PART", part)
        monkeypatch.setattr(tail, "BLOCK", block)
        end = files.finished({}, {})
        assert list(end.values()) == [at]
        got = [(o, v) for p in files.stretches({}, end) for b in files.read(p) for o, v in zip(b["offset"].to_pylist(), b["value"].to_pylist())]
        assert got == want
        middle = {f: want[100][0] for f in end}
        assert [v for p in files.stretches(middle, end) for b in files.read(p) for v in b["value"].to_pylist()] == lines[100:]
    assert tail.Files(f"file://{tmp_path}/none", "").sizes() == {}


def test_calibration_grows_by_new_sessions_only(spark, tmp_path, monkeypatch):
    from tracelake.operators import detectors as d

    rows = [(s, i, "patch" if (s + i) % 4 == 0 else "read_file", f'{{"path":"{i % (s + 2)}"}}', (s + i) % 4 == 0, i * s, i % 3, i % 5 == 0) for s in range(9) for i in range(30)]
    log = spark.createDataFrame(rows, "session long, seq long, tool string, arguments string, mutating boolean, output_bytes long, errors long, blank boolean")
    outcomes = spark.createDataFrame([(s, f"m{s % 2}", "complete" if s % 3 else "hard_fail") for s in range(9)], "session long, model string, outcome string")
    at, seen, real = str(tmp_path / "counts"), [], d.samples
    monkeypatch.setattr(d, "samples", lambda log, **k: seen.append(log.select("session").distinct().count()) or real(log, **k))
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    d.calibrate_on(at, log, outcomes.where("session < 4"))
    d.calibrate_on(at, log, outcomes.where("session < 8"))
    got = rows_of(d.calibrate_on(at, log, outcomes, min_runs=2))
    assert seen == [4, 4, 1] and rows_of(d.calibrate_on(at, log, outcomes, min_runs=2)) == got
    assert got == rows_of(d.calibrate(log, outcomes, min_runs=2)) and got
