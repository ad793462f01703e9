"""Spans, pseudonyms, secrets, commands, tool calls, documents and session logs on rows made for their edges."""

import pytest
from pyspark.sql import functions as F

from tracelake.functions import commands, present, rates
from tracelake.functions import text as t
from tracelake.operators import context, costs, detectors, diagnostics, documents, harvest, privacy, sessions, toolcalls
from tracelake.sources import session_log


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_detected_spans():
    kinds = lambda x: [(s["kind"], s["text"]) for s in privacy.detected(x)]
    assert kinds("mail a@b.com, ssn 123-45-6789, call (212) 555-0199 or 212-555-0199") == [("email", "a@b.com"), ("ssn", "123-45-6789"), ("phone", "(212) 555-0199"), ("phone", "212-555-0199")]
    assert kinds("4111 1111 1111 1111, 4111 1111 1111 1112 10.0.0.1 aa:bb:cc:dd:ee:ff 999.1.1.1") == [("card", "4111 1111 1111 1111"), ("ipv4", "10.0.0.1"), ("mac", "aa:bb:cc:dd:ee:ff")]
    a = {"start": 0, "end": 5, "kind": "x", "text": ""}
    assert privacy.merged([a | {"start": 2, "end": 9}, a, a | {"end": 7, "kind": "y"}, a | {"start": 7, "end": 8}]) == [a | {"end": 7, "kind": "y"}, a | {"start": 7, "end": 8}]


def test_pseudonyms_are_stable_and_read_back(spark):
    texts = spark.createDataFrame([(1, "a@b.com and c@d.com, 10.0.0.1"), (2, "c@d.com, x@y.org"), (3, None)], "doc long, text string")
    found = privacy.spans(texts)
    vault = privacy.numbered(found)
    assert {r["original"]: r["token"] for r in vault.collect()} == {"c@d.com": "Email_1", "a@b.com": "Email_2", "x@y.org": "Email_3", "10.0.0.1": "Ip_1"}
    masked = privacy.pseudonymised(found, vault)
    assert {r["doc"]: r["text"] for r in masked.collect()} == {1: "Email_2 and Email_1, Ip_1", 2: "Email_1, Email_3", 3: None}
    assert {r["doc"]: r["text"] for r in privacy.reconstituted(masked, vault).collect()} == {r["doc"]: r["text"] for r in texts.collect()}
    more = privacy.numbered(privacy.spans(spark.createDataFrame([(9, "c@d.com new@z.net")], "doc long, text string")), vault)
    assert {r["original"]: r["token"] for r in more.collect()}["new@z.net"] == "Email_4" and more.count() == 5
    odd = spark.createDataFrame([(1, "Email_12 Email_1x Email_1")], "doc long, text string")
    assert privacy.reconstituted(odd, vault).first()["text"] == "Email_12 Email_1x c@d.com"


def test_redaction_terms_and_index(spark):
    files = spark.createDataFrame([("a", "Ann Lee wrote a@b.com"), ("b", "nothing"), ("c", "Ann")], "key string, text string")
    registry = files.select("key", F.sha2(F.col("text").cast("binary"), 256).alias("sha256")).where("key <> 'a'")
    prior = spark.createDataFrame([("b", [("old", "org")]), ("a", [])], "path string, pii array<struct<text:string,kind:string>>")
    index = {r["path"]: [tuple(p) for p in r["pii"]] for r in privacy.index(files, registry, prior).collect()}
    assert index == {"a": [("a@b.com", "email")], "b": [("old", "org")], "c": []}
    frame = spark.createDataFrame([("b", [("é", "org"), ("Ann Lee", "person_name")]), ("a", [("Ann Lee", "org"), ("bb", "org")])], "path string, pii array<struct<text:string,kind:string>>")
    assert [tuple(r) for r in privacy.redaction_terms(frame).collect()] == [("Ann Lee", "org"), ("bb", "org"), ("é", "org")]
    done = {r["key"]: r["redacted"] for r in privacy.redacted(files, [("Ann Lee", "person_name"), ("Ann", "person_name"), ("", "org")]).collect()}
    assert done == {"a": "[REDACTED:name] wrote [REDACTED:email]", "b": "nothing", "c": "[REDACTED:name]"}
    assert [r["path"] for r in privacy.refused(spark.createDataFrame([("a",), ("x",)], "path string"), frame).collect()] == ["a"]
    named = spark.createDataFrame([("Al met Al at al@x.com", [("Al", "person_name"), ("al", "person_name")])], "text string, items array<struct<text:string,kind:string>>")
    assert [(s["start"], s["kind"]) for s in privacy.with_named(named).first()["spans"]] == [(0, "person_name"), (7, "person_name"), (13, "email")]
    assert [one(spark, privacy.kind_of_label(F.lit(x)))[0] for x in ("E-Mail address", "EMAIL", "org name", "??")] == ["street_address", "email", "org", "person_name"]


def test_secrets(spark):
    redact = lambda x, **k: one(spark, t.redact_secrets(F.lit(x), **k))[0]
    assert redact("a ghp_" + "a" * 36 + " b") == "a [REDACTED:github_token] b" and redact("plain") == "plain"
    assert redact("postgres://u:p@h/db AKIA" + "A" * 16) == "[REDACTED:db_url] [REDACTED:aws_access_key]"
    assert redact("Bearer abc") == "[REDACTED:tagged_value]" and redact("API-KEY : x y") == "[REDACTED:tagged_value] y"
    rare, dull = "aB3dE5gH7jK9mN1pQ3sT5vX7", "a" * 30
    assert redact(f"x {rare} {dull}", high_entropy=True) == f"x [REDACTED:high_entropy] {dull}" and redact(rare) == rare
    assert abs(one(spark, t.entropy(F.lit("aabb")))[0] - 1) < 1e-9


@pytest.mark.parametrize("url, local", [("http://localhost:1/x", True), ("https://u:p@10.1.2.3/", True), ("http://172.32.0.1", False), ("172.16.0.1:80", True), ("http://[::1]:8080/v", True), ("http://[2001:db8::1]/", False), ("http://a.LAN", True), ("https://api.example.com", False), ("http://127.0.0.300", False), ("", False)])
def test_local_hosts(spark, url, local):
    assert one(spark, commands.is_local(F.lit(url)))[0] is local


def test_commands(spark):
    c = lambda f, x: one(spark, f(F.lit(x)))[0]
    assert [c(commands.severity, x) for x in ("rm  -r -f x", "RM -FR /", "rm x", "sed -n p; perl -i x", "sudo", "xsudo", "git checkout .")] == ["block", "block", "allow", "refuse_in_place_edit", "block", "allow", "block"]
    assert [c(commands.stashes, x) for x in ("git stash", "a; git stash -u", "git stash pop", "git stash push -m x", "git status", "echo stash")] == [True, True, False, True, False, False]
    assert c(commands.restored_paths, "cd x && git checkout -- a b | git restore -s H c; git log d") == ["a", "b", "H", "c"]
    assert [c(commands.is_commit, x) for x in ("git commit -m x", "git commit -n", "git commit; ls", " git  commit ")] == [True, False, False, True]
    assert [c(commands.is_short_status, x) for x in ("git status -s", "git status", "git status --porcelain=v2")] == [True, False, True]
    clean = lambda x: one(spark, commands.is_clean(F.lit(x), ".own/"))[0]
    assert clean("exit 0\n\n?? .own/x\n") and not clean("exit 0\n M src/a") and clean("")
    cap = lambda x, n: one(spark, commands.capped(F.lit(x), n))[0]
    assert cap("abc", 3) == "abc" and cap("abécd", 3) == "abé\n\n[truncated: 3 bytes elided]" and cap("🙂🙂", 5) == "🙂🙂\n\n[truncated: 3 bytes elided]"
    parts = lambda x: [tuple(s) for s in one(spark, commands.segments(F.lit(x)))[0]]
    assert parts("a<think>b</think>c") == [("a", False), ("b", True), ("c", False)] and parts("b</think>c<think>d") == [("b", True), ("c", False), ("d", True)] and parts("") == []
    assert one(spark, t.head_tail(F.sequence(F.lit(1), F.lit(101)).cast("array<string>")))[0][19:22] == ["20", "[… 1 lines omitted; full output not retained …]", "22"]
    assert one(spark, t.quiet(F.array(*map(F.lit, ["", "Compiling x", "test a ... ok", "error", " ", "", "warn", "running 2 tests", ""]))))[0] == ["error", "", "warn"]


REGISTRY = {"read_file": {"properties": {"path": {"type": "string"}, "start_line": {"type": "integer"}}, "required": ["path"]}, "write_file": {"properties": {"path": {"type": "string"}, "content": {"type": "string"}}, "required": ["path", "content"]}, "bash": {"properties": {"command": {"type": "string"}, "timeout": {"type": "number", "default": 5}}, "required": ["command"]}}


@pytest.mark.parametrize("text, status, name, arguments, repairs", [
    ('<tool_call>{"name":"read_file","arguments":{"path":"</tool_call>}"}}</tool_call>', "found", "read_file", '{"path":"</tool_call>}"}', []),
    ('<function=bash>{"command":"a"}</function>', "found", "bash", '{"command":"a","timeout":5}', ["default"]),
    ('```json\n{"name":"read_fil","arguments":{"file_path":"x"}}\n```', "found", "read_file", '{"path":"x"}', ["name", "alias"]),
    ("name: read_file\narguments:\n  path: src/a.rs\n  start_line: 3\n", "found", "read_file", '{"path":"src/a.rs","start_line":3}', []),
    ("```yaml\nname: bash\narguments:\n  command: 'ls -l'\n  timeout: 2\n```", "found", "bash", '{"command":"ls -l","timeout":2}', []),
    ('read_file(path="a", start_line="4")', "found", "read_file", '{"path":"a","start_line":4}', ["coerce"]),
    ("<tool_call>{'name': 'read_file', arguments: {path: 'x',}}</tool_call>", "found", "read_file", '{"path":"x"}', ["json"]),
    ('<tool_call>{"name":"write_file","arguments":{"path":"x","content":"a\nb"}}', "found", "write_file", '{"content":"a\\nb","path":"x"}', ["newline"]),
    ('{"name":"nothing_like","arguments":{}}', "failed", "nothing_like", "{}", []),
    ('{"name":"read_file","arguments":{"start_line":"x"}}', "failed", "read_file", '{"start_line":"x"}', []),
    ("just words", "none", None, None, []),
    ("", "none", None, None, []),
])
def test_tool_calls(text, status, name, arguments, repairs):
    p = toolcalls.parse(text, REGISTRY)
    assert (p["status"], p["name"], p["arguments"], p["repairs"]) == (status, name, arguments, repairs)
    assert bool(toolcalls.feedback(p, REGISTRY)) == (status == "failed")


def test_tool_call_parts(spark):
    assert toolcalls.distance("kitten", "sitting") == 3 and toolcalls.closest("baxh", REGISTRY) == "bash" and toolcalls.closest("baxxh", {"baxxb": {}, "baxxa": {}}) == "baxxa"
    assert toolcalls.score({"name": "bash", "arguments": {"command": "x", "odd": 1}}, REGISTRY) == 7 and toolcalls.score({"name": "read_file", "arguments": {}}, REGISTRY) == 3
    many = {"format": "hermes", "name": "bsh", "arguments": {"cmd": "x", "timeout": "1"}, "body": "", "repairs": []}
    assert toolcalls.repaired(many, REGISTRY)["repairs"] == ["name", "alias", "coerce"]
    rows = spark.createDataFrame([(None,), ('read_file(path=x)',)], "text string")
    assert [r["call"]["status"] for r in toolcalls.parsed(rows, REGISTRY).collect()] == ["none", "found"]


def test_documents(spark):
    doc = "# T\n## Goal\nDo it.\n\n## Spec\n1. **First** x\n2. no title\n### 3. Third\n### Task 4: Fourth\n### §5 — Fifth\n### 1.5x\n### 3. Again\n6. **First** same\n## Notes\n7. **Late** z"
    d = spark.createDataFrame([(1, doc), (2, "none"), (3, None)], "doc long, text string")
    assert [(r["id"], r["title"]) for r in documents.seeded_tasks(d).orderBy("place").collect()] == [("1", "First"), ("3", "Third"), ("4", "Fourth"), ("5", "Fifth")]
    assert one(spark, documents.section(F.lit(doc), "Goal"), documents.section(F.lit(doc), "Odd")) == ("Do it.", None)
    ids = lambda p: one(spark, documents.phase_id(F.lit(p)), documents.milestone_id(F.lit(p)))
    assert ids("x/M17-dash/phase-06c-iii-b-per-skill.md") == ("phase-06c-iii-b", "M17-dash") and ids("notes/phase-words.md") == ("phase-words", None) and ids("a.md") == ("a", None)
    assert [one(spark, documents.line_range(F.lit("a\nb\nc"), *r))[0] for r in ((2,), (1, 2), (4,), (3, 9))] == ["b\nc", "a\nb", None, "c"]
    files = spark.createDataFrame([(p,) for p in ("a.rs", "src/b.rs", "src/x/c.rs", "src/x/d.py", "t.md")], "path string")
    found = lambda g, **k: [r["path"] for r in documents.found_files(files, g, **k).collect()]
    assert found("*.rs") == ["a.rs", "src/b.rs", "src/x/c.rs"] and found("src/*.rs") == ["src/b.rs"] and found("**/*.{py,md}") == ["src/x/d.py", "t.md"] and found("src/**/[!d].rs", most=1) == ["src/b.rs"] and found("*", depth=1) == ["a.rs", "t.md"]
    hits = documents.searched(spark.createDataFrame([(1, "x\néab ab\ny"), (2, "AB")], "key long, text string"), "ab", context=1)
    assert [tuple(r) for r in hits.orderBy("key", "line", "col").collect()] == [(1, 2, 3, "ab", ["x"], ["y"]), (1, 2, 6, "ab", ["x"], ["y"])]
    assert documents.searched(spark.createDataFrame([(2, "AB ab")], "key long, text string"), "ab", ignore_case=True, most=1).count() == 1


def test_session_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "logs")
    lines = [
        '{"ts":5,"turn":0,"event":{"event_type":"session_start","session_id":"s","model":"m","phase":"p"}}', "", "{broken", '{"ts":1,"turn":1,"event":{"event_type":"odd"}}', '{"ts":"x","turn":1,"event":{"event_type":"prompt","rendered":"r"}}',
        '{"ts":6,"turn":1,"event":{"event_type":"parsed","tool_call":{"name":"bash","arguments":{"b":1,"a":"password=x y"}}}}', '{"ts":6,"turn":1,"event":{"event_type":"tool_result","name":"bash","succeeded":true,"output_preview":"token=abc"}}',
        '{"ts":9,"turn":2,"event":{"event_type":"progress","turn":2,"stage":"s","files_changed":[],"message":"m"}}', '{"ts":8,"turn":2,"event":{"event_type":"session_end","status":"complete","turns":7}}',
    ]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "session-b.jsonl").write_text("\n".join(lines))
    (tmp_path / "logs" / "session-a.jsonl").write_text(lines[0].replace('"ts":5', '"ts":50'))
    (tmp_path / "logs" / "other.txt").write_text("x")
    log = session_log.corpus(spark, path)
    assert log.where("session = 'session-b.jsonl'").count() == 5
    s = {r["session"]: r for r in sessions.status(log).collect()}["session-b.jsonl"]
    assert (s["started_at"], s["last_ts"], s["latest_turn"], s["ended"], s["gaps"], s["gap_min"], s["last_tool_ok"]) == (5, 9, 7, "complete", 2, 1, True)
    assert log.where("arguments is not null").first()["arguments"] == '{"a":"password=x y","b":1}'
    masked = [r[0] for r in log.where("session = 'session-b.jsonl'").orderBy("seq").select(session_log.redacted(F.col("event")).alias("e")).select(F.to_json("e")).collect()]
    assert "abc" not in masked[2] and "password=x" not in masked[1] and all('"event_type"' in m for m in masked)
    session_log.append(log.where("session = 'session-b.jsonl'"), str(tmp_path / "out" / "x.jsonl"))
    import os

    os.utime(tmp_path / "logs" / "session-a.jsonl", (1, 1))
    names = session_log.logs(spark, path)
    assert session_log.latest(names) == "session-b.jsonl" and session_log.resolved(names, "a") == "session-a.jsonl" and session_log.resolved(names, "zz") is None
    assert not sessions.truncated(80, 50) and sessions.truncated(45, 20)


def test_harvest_layouts(spark, tmp_path):
    use = '{"type":"assistant","timestamp":"2024-01-02T03:04:05.678Z","message":{"id":"%s","usage":{"input_tokens":%s,"cache_creation":%s,"cache_creation_input_tokens":7}}}'
    (tmp_path / "s1" / "subagents").mkdir(parents=True)
    (tmp_path / "s1" / "tool-results").mkdir()
    (tmp_path / "s1.jsonl").write_text("\n".join([use % ("a", 1, "null"), use % ("b", -2, '{"ephemeral_1h_input_tokens":3}'), "", "{x", '{"type":"user"}', '{"type":"assistant","message":{"usage":{}}}']))
    (tmp_path / "s1" / "subagents" / "x.jsonl").write_text(use % ("a", 5, 4))
    (tmp_path / "s1" / "tool-results" / "y.jsonl").write_text(use % ("z", 5, 4))
    u = harvest.usage(harvest.transcripts(spark, str(tmp_path)))
    rows = {r["message_id"]: r for r in harvest.kept(u).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["input"] == 5 and rows["a"]["session"] == "s1" and (rows["a"]["cache_creation"], rows["a"]["cache_creation_5m"]) == (7, 7)
    assert (rows["b"]["input"], rows["b"]["cache_creation_1h"], rows["b"]["model"], rows["b"]["skill"], rows["b"]["ts"]) == (0, 3, "unknown", "other", 1704164645678)
    assert harvest.transcripts(spark, str(tmp_path / "none")).count() == 0


def test_rates():
    assert rates.rates_for("claude-opus-4-6", {"claude-opus-4-6": (1.0, 2.0)}) == (1.0, 2.0) and rates.rates_for("odd", {}) is None
    assert rates.effective_rates("claude-opus-4-6", (1.0, 2.0)) == (5.0, 25.0) and rates.effective_rates(None, (1.0, 2.0)) == (1.0, 2.0)
    assert rates.architect_rates("claude-haiku-4-5", {"cache_read": 9.0}) == {"input": 1.0, "output": 5.0, "cache_read": 0.1, "cache_creation": 1.25}
    assert rates.architect_rates("odd", {"input": 2.0, "cache_read": 9.0}) == {"input": 2.0, "output": 0.0, "cache_read": 9.0, "cache_creation": 0.0}
    assert rates.executor_rates({"m": {"input": 1.0, "output": None}}, "m") == {"input": 1.0, "output": 0.0, "cache_read": 0.0, "cache_creation": 0.0}


def test_live_detectors_at_and_below_their_limits(spark):
    def log(rows):
        full = [(1, i * 2, *r) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, "session long, seq long, tool string, arguments string, mutating boolean, output_bytes long, errors long, blank boolean, feedback string")

    read, write = ("read_file", '{"path":"a"}', False, 0, 0, False, None), ("patch", '{"path":"a"}', True, 0, 0, False, None)
    hits = lambda rows, **k: [(r["seq"] // 2, r["detector"]) for r in detectors.live(log(rows), **k).orderBy("seq").collect()]
    assert hits([read] * 59) == [] and hits([read] * 60) == [(59, "stall")] and hits([write] + [read] * 60) == [(7, "oscillation"), (60, "stall")]
    assert hits([write] * 5) == [] and hits([write] * 6) == [(5, "identical")] and hits([read] * 8) == []
    assert hits([read] * 24, terminate_on_novelty=True) == [(23, "novelty")] and hits([read] * 24) == []
    err = lambda *n: [write[:1] + (f'{{"n":{i}}}',) + write[2:4] + (e, False, None) for i, e in enumerate(n)]
    assert hits(err(1, 1, 2, 2, 3, 3)) == [(5, "persistence")] and hits(err(1, 1, 2, 1, 3, 3, 3, 3)) == [] and hits(err(1, 1, 2, 1, 3, 3, 3, 3, 4)) == [(8, "persistence")]
    assert hits(err(1, None, 1, None, 2, 2, None, 3, 3)) == [(8, "persistence")]
    assert hits([read[:5] + (True, None)] * 3) == [(2, "empty")] and hits([read[:6] + ("g",)] * 5) == [(4, "feedback")]
    assert hits([read[:3] + (102_400, 0, False, None)]) == [] and hits([read[:3] + (102_401, 0, False, None)]) == [(0, "runaway")]
    with pytest.raises(ValueError):
        detectors.live(log([read]), odd=1)
    other = ("patch", '{"path":"b"}', True, 0, 0, False, None)
    assert hits([write, other] * 4) == [(7, "oscillation")]


def test_spend_and_scope_without_runs(spark):
    empty = spark.createDataFrame([], "project_id string, milestone_id string, tokens struct<input_tokens:long,output_tokens:long,cache_read_tokens:long,cache_write_tokens:long>")
    ledger = spark.createDataFrame([(1, "p", "s", "m", "k", (1, 1, 1, 1), 0, 0, 1)], "seq long, project_id string, session_id string, model string, skill string, tokens struct<input:long,cache_creation:long,cache_read:long,output:long>, cache_creation_5m long, cache_creation_1h long, messages long")
    r = costs.scope_costs(empty, ledger, rates.rate_table(spark, {}), "p", (0.0, 0.0), {}).first()
    assert (r["scope"], r["executor_tokens"], r["saved"], r["net"], r["architect"]) == ("project", 0, None, None, 0.0)
    assert present.CATEGORIES and context.TARGET == 0.75


def test_verifier_outputs(spark):
    import json

    say = lambda level, primary: json.dumps({"reason": "compiler-message", "message": {"level": level, "message": "bad", "code": {"code": "E1"}, "spans": [{"file_name": "src/x", "line_start": 3, "column_start": 4, "is_primary": primary}], "children": [{"message": "try", "spans": [{"file_name": "src/x", "line_start": 3, "is_primary": True, "suggested_replacement": "y", "suggestion_applicability": "MachineApplicable"}]}]}})
    rows = spark.createDataFrame([(1, say("error", True)), (2, say("warning", True)), (3, say("error", False)), (4, "{x"), (5, '{"reason":"other"}')], "seq long, value string")
    assert [tuple(r) for r in diagnostics.from_compiler(rows, "/r/").collect()] == [(1, "/r/src/x", 3, 4, "error", "bad\n  try: y", "E1")]
    lint = spark.createDataFrame([(1, '[{"code":"F1","message":"m","filename":"a.py","location":{"row":2,"column":5}},{}]'), (2, "no")], "seq long, value string")
    assert [tuple(r)[1:] for r in diagnostics.from_linter(lint).collect()] == [("a.py", 2, 5, "error", "m", "F1"), ("", 0, None, "error", "", None)]
    out = ["running", "---- a::b stdout ----", "", "thread 'x' panicked at src/l.rs:1:2:", "assertion failed", "  left: 1", "note: run", "---- c stdout ----", "thread panicked at z:1:", "boom", "failures:", "    a::b", "test result: no"]
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate(out)], "run long, i long, line string")
    assert [(r["name"], r["location"], r["detail"]) for r in diagnostics.test_failures(t).orderBy("place").collect()] == [("a::b", "src/l.rs:1:2", "assertion failed, left: 1"), ("c", "z:1", "boom")]
    files = spark.createDataFrame([("b", "x\ny\n", "x\nz\nw\n"), ("a", None, "n\n"), ("c", "s", "s")], "path string, before string, after string")
    changes = diagnostics.changed_lines(files)
    assert {r["path"]: (r["added"], r["removed"]) for r in changes.collect()} == {"b": (2, 1), "a": (1, 0)}
    assert diagnostics.progress_line(changes, 3, "s", 1).first()["line"] == "turn=3 stage=s +3/-1 files=2 a:+1/-0  …+1"


def test_lookup_and_cells(spark):
    runs = spark.createDataFrame([(1, 10, "m", "a"), (2, 11, "m", "b")], "seq long, ts long, model string, phase_id string")
    from tracelake.functions import metrics
    from tracelake.operators import scorecard

    ids = [r[0] for r in runs.orderBy("seq").select(metrics.run_id(F.col("ts"), F.col("model"), F.col("phase_id"))).collect()]
    assert scorecard.by_id(runs, ids[1]).first()["seq"] == 2
    for bad in ("", "zz"):
        with pytest.raises(LookupError):
            scorecard.by_id(runs, bad)
    shown = lambda c: one(spark, c)[0]
    assert [shown(metrics.compact_count(F.lit(n))) for n in (0, 7, 1250, 999_950, 2_100_000)] == ["—", "7", "1.2k", "1000.0k", "2.1M"]
    assert shown(present.cost_cell(F.lit(1234.5))) == "$1234.5000" and shown(present.speed_cell(F.lit(None).cast("double"))) == "—" and shown(present.gate_cell(F.lit(None).cast("boolean"))) == "✗"
    assert shown(present.phase_label(F.lit("a/b.md"), F.lit("x"))) == "b" and shown(present.utc_time(F.lit(86_399_999))) == "23:59:59" and shown(present.utc_date(F.lit(-1))) == "1969-12-31"
    body = spark.createDataFrame([('{"data":[{"id":"m","max_model_len":9},{"object":"x"}]}',), ("{",)], "value string")
    from tracelake.sources import backends

    assert [tuple(r) for r in backends.models(body).collect()] == [("m", 9)]
    s, o = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, value string"), spark.createDataFrame([("m", "a", "7"), ("m", "b", None), ("x", "b", "9")], "model string, name string, value string")
    assert {r["name"]: r["value"] for r in backends.resolved(s, o, "m").collect()} == {"a": "7", "b": "2"}


def test_sweep_watermark(spark, tmp_path):
    import os

    from tracelake.streaming import sweep

    folder, seen = tmp_path / "t", []
    folder.mkdir()
    assert sweep.sweep_once(spark, str(folder), None, seen.append) is None
    (folder / "a.jsonl").write_text('{"type":"assistant","message":{"id":"a","usage":{}}}')
    os.utime(folder / "a.jsonl", (5, 5))
    assert sweep.sweep_once(spark, str(folder), None, lambda u: seen.append(u.count())) == 5000 and seen == [1]
    assert sweep.sweep_once(spark, str(folder), 5000, lambda u: seen.append(u.count())) == 5000 and seen == [1]

    def fail(_):
        raise RuntimeError("x")

    assert sweep.sweep_once(spark, str(folder), 4000, fail) == 4000
    names = spark.createDataFrame([(f"cmd-output-{i}.log",) for i in range(25)] + [("other.log",)], "name string")
    assert {r["name"] for r in sweep.newest_files(names).collect()} == {f"cmd-output-{i}.log" for i in range(5, 25)}


def test_repository_scan_symbols_and_vault(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / ".hidden").mkdir()
    for name, data in (("a.txt", b"x"), ("src/b.py", "é".encode()), ("src/c.bin", b"\xff\xfe"), ("src/zero", b"a\0b"), (".hidden/d.txt", b"x"), ("big.txt", b"x" * 2000)):
        (root / name).write_bytes(data)
    paths = lambda *g: sorted(r["path"] for r in documents.repository_texts(spark, str(root), g, 1000).collect())
    assert paths() == ["a.txt", "src/b.py"] and paths("*.py", "*.bin") == ["src/b.py"] and paths("src/**") == ["src/b.py"]
    code = "import os\nX = 1\nclass A:\n    def f(self):\n        y = X\n        return os.path\ndef g(): pass\n"
    rows = documents.symbols(spark.createDataFrame([(code,), ("def (",), (None,)], "text string")).collect()
    assert [(s["name"], s["kind"], s["line"]) for s in rows[0]["symbols"] if s["definition"]] == [("X", "variable", 2), ("A", "class", 3), ("f", "method", 4), ("g", "function", 7)]
    assert ("X", 5) in [(s["name"], s["line"]) for s in rows[0]["symbols"] if not s["definition"]] and rows[1]["symbols"] == rows[2]["symbols"] == []
    vault, key, schema = spark.createDataFrame([("Email_1", "a@b.com", "email")], "token string, original string, kind string"), "k" * 16, "token string, original string, kind string"
    folder = str(tmp_path / "vault")
    assert privacy.load(spark, folder, key, schema).count() == 0
    privacy.save(vault, folder, key)
    path = privacy.save(vault.unionByName(vault.selectExpr("'Email_2' as token", "'c@d.com' as original", "kind")), folder, key)
    assert privacy.load(spark, folder, key, schema).count() == 2 and "a@b.com" not in "".join(r["value"] for r in spark.read.text(path).collect())


def test_detectors_left_out_would_have_found_nothing():
    import random

    r = random.Random(5)
    parts = ["a@b.co", "123-45-6789", "(123) 456-7890", "123.456.7890", "10.0.0.1", "aa:bb:cc:dd:ee:ff", "00-11-22-33-44-55", "4111 1111 1111 1111", "٣٤٥-٦٧٨-٩٠١٢", "12", "-", ".", ":", "@", " x "]
    texts = ["".join(r.choices(parts, k=r.randrange(4))) for _ in range(3000)]
    for t in texts:
        assert {k for k in privacy.ORDER if privacy._PATTERNS[k].search(t)} <= set(privacy._possible(t))
    assert privacy._possible("no such data, at all; see p. 12") == []
