"""Context compaction against a fold that changes messages one after the other."""

import random
import string

import pytest

from tracelake.operators import context

MESSAGE = "conv long, idx long, role string, turn long, content string, calls array<string>, results array<struct<tool:string,content:string>>"


def count(text):
    n = run = 0
    for c in text or "":
        mark = c in string.punctuation or any(a <= ord(c) <= b for a, b in ((0x3000, 0x303F), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xAC00, 0xD7AF)))
        if c.isspace() or mark:
            n, run = n + -(-run // 4) + mark, 0
        else:
            run += 1
    return n + -(-run // 4)


def size(m):
    return count(m["content"]) + sum(map(count, m["calls"] or [])) + sum(count(r["content"]) for r in m["results"] or [])


def folded(messages, ceiling, prompt):
    """(messages that stay, before, after, shortened, evicted) by the rules taken one at a time."""
    messages = [m | {"results": m["results"] and [dict(r) for r in m["results"]]} for m in messages]
    before = total = count(prompt) + sum(map(size, messages))
    target, shortened, evicted = int(ceiling * 0.75), 0, 0
    note = lambda body, what: f"[compacted: {len(body.encode())} bytes / {count(body)} tokens — {what} compacted for budget]"
    for m in messages:
        if total <= target:
            break
        c = m["content"] or ""
        if m["role"] != "user" or not c.startswith("<tool_result>") or not c.endswith("</tool_result>") or "[compacted:" in c:
            continue
        m["content"] = f"<tool_result>{note(c[13:-14], 'original content')}</tool_result>"
        total += count(m["content"]) - count(c)
        shortened += 1
    newest = max((m["turn"] for m in messages if m["turn"] is not None), default=None)
    ranked = []
    for i, m in enumerate(messages):
        if m["role"] == "tool" and m["results"]:
            c = m["results"][0]["content"] or ""
            recent = m["turn"] is not None and max(newest - m["turn"], 0) < 3
            if "[compacted:" not in c and not c.startswith(("[superseded:", "[already-read:")) and not recent:
                ranked.append((m["results"][0]["tool"] == "read_file", m["turn"] or 0, i))
    for _, _, i in sorted(ranked):
        if total <= target:
            break
        was, r = size(messages[i]), messages[i]["results"][0]
        r["content"] = note(r["content"] or "", "tool result")
        total -= max(was - size(messages[i]), 0)
        shortened += 1
    while total > target and any(m["role"] != "system" for m in messages):
        gone = messages.pop(next(i for i, m in enumerate(messages) if m["role"] != "system"))
        total = max(total - size(gone), 0)
        evicted += 1
    return messages, before, total, shortened, evicted


def conversation(r, conv):
    out = []
    body = lambda: " ".join(r.choice(["word", "longer-words", "x.y", "漢字", "é", "a\nb"]) for _ in range(r.choice([0, 1, 3, 20, 60])))
    for i in range(r.randrange(1, 25)):
        kind = r.choice(["system", "user", "wrapped", "assistant", "tool", "tool"])
        m = {"conv": conv, "idx": i, "role": "user" if kind == "wrapped" else kind, "turn": r.choice([None, i // 3, i // 3]), "content": body(), "calls": None, "results": None}
        if kind == "wrapped":
            m["content"] = f"<tool_result>{r.choice(['', '', '[compacted: '])}{body()}</tool_result>"
        if kind == "assistant":
            m["calls"] = [body() for _ in range(r.randrange(3))]
        if kind == "tool":
            m["content"] = r.choice([None, ""])
            m["results"] = [{"tool": r.choice(["read_file", "bash"]), "content": r.choice(["", "", "", "[superseded: ", "[already-read:", "see [compacted: "]) + body()} for _ in range(r.choice([0, 1, 1, 2]))]
        out.append(m)
    return out


@pytest.mark.parametrize("ceiling", [10, 120, 400])
def test_compaction_equals_the_fold(spark, ceiling):
    r, prompt = random.Random(ceiling), "you are, so to speak, an agent"
    talks = {c: conversation(r, c) for c in range(60)}
    df = spark.createDataFrame([tuple(m.values()) for t in talks.values() for m in t], MESSAGE).repartition(3)
    actions = context.compacted(df, ceiling, prompt).cache()
    reports = {x["conv"]: tuple(x)[1:] for x in context.compaction_report(actions).collect()}
    left: dict = {}
    for x in context.rewritten(df, actions).collect():
        left.setdefault(x["conv"], []).append((x["idx"], x["content"], [tuple(y) for y in x["results"] or []]))
    seen = [0, 0]
    for c, t in talks.items():
        stay, *report = folded(t, ceiling, prompt)
        assert reports[c] == tuple(report)
        assert sorted(left.get(c, []), key=lambda m: m[0]) == [(m["idx"], m["content"], [tuple(y.values()) for y in m["results"] or []]) for m in stay]
        seen = [seen[0] + report[2], seen[1] + report[3]]
    assert seen[0] > 20 and (seen[1] > 20 or ceiling == 400)
    assert context.compacted(df.limit(0), 10).count() == 0


def test_paths_meet_however_they_are_written(spark):
    import posixpath

    from pyspark.sql import functions as F

    paths = ["a/b", "./a/b", "/r/a/b", "/r/./a//b", "a/c/../b", "../a", "/r/../a", "/../x", "a/../../b", "", ".", "/r", "/rest/a", "a/b/", None]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", context.one_path(F.col("p"), None).alias("n"), context.one_path(F.col("p"), "/r").alias("o")).collect()
    for r in got:
        if r["p"] is None:
            assert r["n"] is None
            continue
        want = posixpath.normpath(r["p"])
        assert r["n"] == ("" if want == "." else want), r["p"]
        assert r["o"] == (want[3:] if want.startswith("/r/") else r["n"])
    m = "conv long, idx long, role string, turn long, tool string, path string, ranged boolean, tokens long"
    call = lambda i, p: [(1, i, "assistant", i, "read_file", p, False, 1), (1, i + 1, "tool", i, "read_file", None, None, 100)]
    messages = spark.createDataFrame(call(1, "a/b") + call(3, "/r/a/b") + call(7, "./a/b"), m)
    edits = spark.createDataFrame([(1, 5, 5, "/r/a/../a/b")], "conv long, idx long, turn long, path string")
    assert sorted(tuple(x) for x in context.superseded(messages, edits, root="/r").collect()) == [(1, 2, "a/b", 5, 76), (1, 4, "a/b", 5, 76)]
    assert [tuple(x) for x in context.repeated(messages, edits, root="/r").collect()] == [(1, 4, "a/b", 1, 64)]
