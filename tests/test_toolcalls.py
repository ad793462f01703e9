"""Replies that are deep, long or unbalanced: no crash, time in proportion to their length, the results of a plain reading."""

import random
import re
import time

import pytest

from tracelake.operators import documents, toolcalls

REGISTRY = {"read_file": {"properties": {"path": {"type": "string"}, "n": {"type": "integer"}}, "required": ["path"]}}


def plain_end(text, start):
    depth = 0
    for m in re.compile(r'"(?:[^"\\]|\\.)*"?|[{}]', re.S).finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if m[0] == "}" and not depth:
            return m.end()
    return None


def test_braces_equal_one_reading_each():
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice('{}{}""\\a') for _ in range(r.randrange(30)))
        braces = toolcalls.Braces(text)
        for start in sorted((m.start() for m in re.finditer(r"\{", text)), key=lambda _: r.random()):
            assert braces.end(start) == plain_end(text, start)


def test_name_blocks_equal_their_pattern():
    block = re.compile(r"^(?P<pad>[^\n]*?)(?P<body>name:[^\n]*\n(?:(?!\s*\n)[^\n]*\n)*?(?P<again>[^\n]*?)arguments:[^\n]*(?:\n(?!\s*\n)[^\n]+)*)", re.M)
    r = random.Random(2)
    for _ in range(4000):
        text = "".join(r.choice(["name: x", "arguments:", "  a: 1", " ", "  ", "\n", "\n", "\n", "name:", "y arguments: z"]) for _ in range(r.randrange(16)))
        assert toolcalls._name_blocks(text) == [m["body"] for m in block.finditer(text) if len(m["again"]) == len(m["pad"])]


@pytest.mark.parametrize(
    "text",
    [
        "[" * 100_000, '{"a":' * 100_000, "<tool_call>" + '{"name":"read_file","arguments":' * 50_000, "}" * 40_000 + "{" * 40_000, '{"{' * 40_000, "<tool_call>{" * 20_000, "<tool_call>{}" * 20_000, "<function=" * 40_000, "<function=f>{" * 20_000,
        "f(" * 100_000, "a" * 300_000, "a(b" * 60_000, "name: x" + "\n" * 100_000, "name: x\n" * 30_000, "```json {" * 20_000, '"' * 100_001 + "{}", '{"name":"' + "r" * 200_000 + '"}', "f(x=" + "[" * 100_000 + ")",
        '<tool_call>{"name":"read_file","arguments":{"path":"p","n":"' + "7" * 5000 + '"}}</tool_call>', '{"name":"read_file","arguments":' + "[" * 3000 + "]" * 3000 + "}", "{a" * 30_000 + "}" * 30_000,
    ],
    ids=range(21),
)
def test_hard_replies(text):
    began = time.process_time()
    assert toolcalls.parse(text, REGISTRY)["status"] in ("none", "found", "failed")
    assert time.process_time() - began < 6


def test_deep_and_long_modules(spark):
    total = "X = " + "+".join(["y"] * 5000)
    rows = documents.symbols(spark.createDataFrame([(total,), ("(" * 5000,), ("x = " + "-" * 20_000 + "1",), ("def f():\n  pass",)], "text string")).collect()
    assert sum(s["name"] == "y" for s in rows[0]["symbols"]) in (0, 5000)  # 0 where the tree is too deep for the parser itself
    assert rows[1]["symbols"] == [] and [s["name"] for s in rows[3]["symbols"]] == ["f"]


def test_a_repeated_reply_is_read_once_a_batch(spark, tmp_path):
    """Nulls and repeats each keep their row; what is the same is computed once."""
    from tracelake.operators.privacy import _by_text

    rows = [(i, [None, "a", "b", "a"][i % 4]) for i in range(400)]
    log = str(tmp_path / "log")

    def f(text):
        with open(log, "a") as out:
            out.write("x")
        return None if text is None else text * 2

    got = _by_text(spark.createDataFrame(rows, "i long, text string").coalesce(1), f, "text", out="twice", kind="string").collect()
    assert sorted((r["i"], r["twice"]) for r in got) == [(i, None if t is None else t * 2) for i, t in rows]
    assert len(open(log).read()) <= 3 * 8
