"""Tool calls in the free text of a response: six formats, scored against a registry of tools, repaired and validated.

A response is read on its own, so this is one Arrow function; the registry (name -> schema) travels with the task. Scanners
work on Python's JSON decoder rather than on hand-written state machines, wherever a body is valid JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

from tracelake.operators.privacy import _by_text

# Other names of parameters, the most repairs of one call, the greatest distance of a misspelt name.
ALIASES = [("cmd", "command"), ("file_path", "path"), ("filename", "path"), ("query", "pattern")]
REPAIRS, DISTANCE = 4, 2
_STRING = r'"(?:[^"\\]|\\.)*"?'
_TOKEN = re.compile(rf"{_STRING}|[{{}}]", re.S)
_BRACE = re.compile(r"[ \t\n\f\r]*(?=\{)")


class Braces:
    """Where the braces of a text end. Braces inside strings do not count, and where strings lie depends on where reading began;
    what one reading has found is used by all later ones that come to the same brace, so all braces cost one or two passes."""

    def __init__(self, text: str):
        self.text, self.ends = text, {}

    def end(self, start: int) -> int | None:
        """The end of the braces that open at start, None if they stay open."""
        if start in self.ends:
            return self.ends[start]
        opened, at = [start], start + 1
        while opened:
            m = _TOKEN.search(self.text, at)
            if m is None:
                break
            at = m.end()
            if m[0] == "}":
                self.ends[opened.pop()] = at
            elif m[0] == "{":
                if m.start() not in self.ends:
                    opened.append(m.start())
                elif self.ends[m.start()] is None:
                    break
                else:
                    at = self.ends[m.start()]
        for i in opened:
            self.ends[i] = None
        return self.ends[start]


def balanced(text: str, start: int) -> int | None:
    return Braces(text).end(start)


def _loads(body: str):
    try:
        return json.loads(body)
    except (ValueError, RecursionError):  # what is nested too deeply to be read is no call
        return None


def _named(body: str, kind: str) -> dict:
    """A candidate of a body that holds name and arguments."""
    v = _loads(body)
    v = v if isinstance(v, dict) else {}
    name = v.get("name")
    return {"format": kind, "name": name if isinstance(name, str) else None, "arguments": v.get("arguments"), "body": body, "repairs": []}


def _tagged(text: str, opening: str, closing: str, kind: str) -> list[dict]:
    """Bodies in braces after an opening mark; the closing mark is a hint only."""
    out, at, braces, closed = [], text.find(opening), Braces(text), re.compile(r"\s*" + re.escape(closing))
    while at >= 0:
        begin = at + len(opening)
        m = _BRACE.match(text, begin)
        end = braces.end(m.end()) if m else None
        if end is not None:
            out.append(_named(text[m.end() : end], kind))
            begin = end
            if after := closed.match(text, end):
                begin = after.end()
        at = text.find(opening, begin)
    return out


def hermes(text: str) -> list[dict]:
    return _tagged(text, "<tool_call>", "</tool_call>", "hermes")


def fenced(text: str) -> list[dict]:
    return _tagged(text, "```json", "```", "fenced")


def xml(text: str) -> list[dict]:
    """<function=name>{arguments}."""
    out, at, braces, last = [], 0, Braces(text), text.rfind(">") + 1
    head = re.compile(r"<function=([^>]*)>")
    while m := head.search(text, at, last):
        at, name = m.end(), m[1].strip()
        brace = _BRACE.match(text, at)
        end = braces.end(brace.end()) if brace and re.fullmatch(r"\w+", name) else None
        if end is not None:
            body = text[brace.end() : end]
            v = _loads(body)
            out.append({"format": "xml", "name": name, "arguments": v if isinstance(v, dict) else None, "body": body, "repairs": []})
            at = end
    return out


def loose_json(text: str) -> list[dict]:
    """Any braces whose JSON has a name."""
    out, at, braces = [], text.find("{"), Braces(text)
    while at >= 0:
        end = braces.end(at)
        if end is not None and (c := _named(text[at:end], "loose_json"))["name"] is not None:
            out.append(c)
        at = text.find("{", at + 1 if end is None else end)
    return out


def _plain_yaml(body: str) -> dict:
    """Mappings of scalars, indented by blanks: what calls are made of."""
    root: dict = {}
    stack = [(-1, root)]
    for line in body.splitlines():
        m = re.match(r"( *)([\w.-]+):(?:\s+(.*?))?\s*$", line)
        if not m:
            if line.strip():
                raise ValueError("not a plain mapping")
            continue
        indent, key, value = len(m[1]), m[2], m[3]
        while stack[-1][0] >= indent:
            stack.pop()
        if value:
            quoted = value[:1] in "'\"" and value[-1:] == value[:1] and len(value) > 1
            v = value[1:-1] if quoted else _loads(value)
            stack[-1][1][key] = v if quoted or v is not None or value in ("null", "~") else value
        else:
            stack[-1][1][key] = {}
            stack.append((indent, stack[-1][1][key]))
    return root


def _name_blocks(text: str) -> list[str]:
    """From `name:` to the next line with `arguments:` and what follows it, where both stand in the same column. A blank line
    between them ends the search."""
    lines, starts = text.split("\n"), [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    blank = [not line.strip() for line in lines]
    following, found = [0] * (len(lines) + 1), None  # the next line with arguments before a blank one
    for i in range(len(lines) - 1, -1, -1):
        found = i if "arguments:" in lines[i] else None if blank[i] else found
        following[i] = -1 if found is None else found
    following[len(lines)] = -1
    out, i = [], 0
    while i < len(lines):
        pad, j = lines[i].find("name:"), following[i + 1]
        if pad < 0 or j < 0:
            i += 1
            continue
        end = j + 1
        while end < len(lines) and lines[end] and not (blank[end] and end + 1 < len(lines)):
            end += 1
        if lines[j].index("arguments:") == pad:
            out.append(text[starts[i] + pad : starts[end] - 1])
        i = end
    return out


def yaml(text: str) -> list[dict]:
    """Fenced YAML blocks, else `name:` lines followed, before a blank line, by `arguments:` in the same column."""
    bodies = [m[1] for m in re.finditer(r"```yaml(.*?)(?:```|\Z)", text, re.S)] or _name_blocks(text)
    out = []
    for b in bodies:
        try:
            v = _plain_yaml(b)
        except ValueError:
            v = {}
        out.append({"format": "yaml", "name": v.get("name") if isinstance(v.get("name"), str) else None, "arguments": v.get("arguments"), "body": b, "repairs": []})
    return out


def calls(text: str) -> list[dict]:
    """name(key=value, ...) in plain text."""
    out = []
    for m in re.compile(r"(?<!\w)(\w++)\s*+\(([^)]*+)\)").finditer(text, 0, text.rfind(")") + 1):
        args = {}
        for part in m[2].split(","):
            key, eq, value = part.partition("=")
            if eq:
                v = _loads(value.strip())
                args[key.strip()] = v if v is not None or value.strip() == "null" else value.strip()
        out.append({"format": "text", "name": m[1], "arguments": args, "body": m[2], "repairs": []})
    return out


EXTRACTORS = {"hermes": hermes, "xml": xml, "fenced": fenced, "yaml": yaml, "loose_json": loose_json, "text": calls}


def formats(text: str) -> list[str]:
    """Those whose marks the text holds, in the order in which they are tried; plain text only if no other."""
    yes = {
        "hermes": "<tool_call>" in text, "xml": "<function=" in text, "fenced": "```json" in text, "yaml": "```yaml" in text or any("\n" in m[2] for m in re.finditer(r"(^|\n)name:\s++\S++(\s++)arguments:", text)),
        "loose_json": 0 < text.count("{") == text.count("}"),
    }
    return [k for k, v in yes.items() if v] or (["text"] if re.search(r"(?<!\w)\w++\(\w++\s*+=", text) else [])


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def closest(name: str, registry: dict) -> str | None:
    """The tool whose name is nearest, at most DISTANCE away; of equal ones the first by name."""
    near = min(((distance(name, t), t) for t in registry if abs(len(name) - len(t)) <= DISTANCE), default=(DISTANCE + 1, ""))
    return near[1] if near[0] <= DISTANCE else None


def fits(kind: str | None, v) -> bool:
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    return {"string": isinstance(v, str), "integer": isinstance(v, int) and not isinstance(v, bool), "number": number, "boolean": isinstance(v, bool), "object": isinstance(v, dict), "array": isinstance(v, list)}.get(kind, False)


def _parts(schema: dict) -> tuple[dict, list]:
    return schema.get("properties") or {}, [x for x in schema.get("required") or [] if isinstance(x, str)]


def score(c: dict, registry: dict) -> int:
    """5 for the exact name, 3 for a near one; 1 for each required parameter, -2 if it is missing; -1 for an unknown one; 2 for
    each of the right type."""
    name = c["name"]
    if name is None:
        return 0
    tool = name if name in registry else closest(name, registry)
    if tool is None:
        return 0
    total = 5 if tool == name else 3
    if isinstance(c["arguments"], dict):
        known, required = _parts(registry[tool])
        total += sum(1 if r in c["arguments"] else -2 for r in required)
        total += sum((2 if fits((known[k] or {}).get("type"), v) else 0) if k in known else -1 for k, v in c["arguments"].items())
    return total


def coerced(kind: str | None, s: str):
    """A text as a value of the type, or None."""
    if kind == "integer":
        try:
            return int(s) if re.fullmatch(r"[+-]?[0-9]+", s) else None
        except ValueError:  # more digits than a number may have
            return None
    if kind == "number":
        try:
            v = float(s)
        except ValueError:
            return None
        return v if v - v == 0 and s == s.strip() and "_" not in s else None
    if kind == "boolean":
        return {"true": True, "false": False}.get(s)
    v = _loads(s)
    return v if (kind, type(v)) in (("object", dict), ("array", list)) else None


def _outside(text: str, pattern: str, put) -> str:
    """put(match) for matches of a pattern outside of strings."""
    return re.sub(rf"({_STRING})|{pattern}", lambda m: m[0] if m[1] is not None else put(m), text, flags=re.S)


def mended(body: str) -> str:
    """Trailing commas dropped, bare keys and single quotes made double, brackets closed."""
    s = _outside(body, r",[ \t\n\f\r]*([}\]])", lambda m: m[2])
    s = _outside(s, r"([{,\[])[ \t\n\f\r]*([A-Za-z0-9_-]+)[ \t\n\f\r]*:", lambda m: f'{m[2]}"{m[3]}":')
    s = _outside(s, "'", lambda m: '"')
    depth = {"{": 0, "[": 0}
    for m in re.finditer(rf"{_STRING}|[{{}}\[\]]", s, re.S):
        if m[0] in "{}[]":
            depth["{" if m[0] in "{}" else "["] += 1 if m[0] in "{[" else -1
    return s if min(depth.values()) < 0 else s + "]" * depth["["] + "}" * depth["{"]


def escaped(body: str) -> str:
    """Line ends and tabs inside strings escaped."""
    return re.sub(_STRING, lambda m: m[0].replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t"), body, flags=re.S)


def repaired(c: dict, registry: dict) -> dict:
    """Names, aliases, types, defaults, JSON syntax and raw line ends, in this order, at most REPAIRS in all."""
    c = c | {"repairs": [*c["repairs"]], "arguments": dict(c["arguments"]) if isinstance(c["arguments"], dict) else c["arguments"]}
    left = lambda: REPAIRS - len(c["repairs"])
    if c["name"] and c["name"] not in registry and (near := closest(c["name"], registry)):
        c["name"] = near
        c["repairs"].append("name")
    args = c["arguments"]
    if c["name"] in registry and isinstance(args, dict):
        known, required = _parts(registry[c["name"]])
        for other, own in ALIASES:
            if left() > 0 and own in known and other in args and own not in args:
                args[own] = args.pop(other)
                c["repairs"].append("alias")
        for k, v in sorted(args.items()):
            if left() > 0 and k in known and isinstance(v, str) and (new := coerced((known[k] or {}).get("type"), v)) is not None:
                args[k] = new
                c["repairs"].append("coerce")
        for k in sorted(known):
            if left() > 0 and k not in required and k not in args and "default" in (known[k] or {}):
                args[k] = known[k]["default"]
                c["repairs"].append("default")
    for fix, mark in ((mended, "json"), (escaped, "newline")):
        if left() > 0 and c["arguments"] is None and c["format"] != "text" and (v := _loads(fix(c["body"]))) is not None:
            if isinstance(v, dict) and c["format"] == "xml":
                c["arguments"] = v
            elif isinstance(v, dict):
                c["name"] = v["name"] if isinstance(v.get("name"), str) else c["name"]
                c["arguments"] = v.get("arguments", c["arguments"])
            c["repairs"].append(mark)
    return c


def problems(c: dict, registry: dict) -> list[str]:
    """What keeps a call from being run; none if it is valid."""
    if c["name"] not in registry:
        return [f"unknown tool: {c['name']}"]
    known, required = _parts(registry[c["name"]])
    args = c["arguments"] if isinstance(c["arguments"], dict) else {}
    return (
        [f"missing: {r}" for r in required if r not in args] + [f"unknown: {k}" for k in sorted(args) if k not in known]
        + [f"type: {k} should be {known[k]['type']}" for k, v in sorted(args.items()) if k in known and isinstance((known[k] or {}).get("type"), str) and not fits(known[k]["type"], v)]
    )


def parse(text: str | None, registry: dict) -> dict:
    """status none (no call was tried), found or failed, with the best candidate: its name, arguments, format and repairs, and of a
    failure the problems of the last candidate tried."""
    tried = formats(text or "")
    candidates = [c for f in tried for c in EXTRACTORS[f](text)]
    ranked = sorted(candidates, key=lambda c: -score(c, registry))
    last = {"status": "none", "name": None, "arguments": None, "format": tried[0] if tried else None, "repairs": [], "problems": []}
    for c in ranked:
        r = repaired(c, registry)
        wrong = problems(r, registry)
        args = r["arguments"] if isinstance(r["arguments"], dict) else {}
        shown = json.dumps(args, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        last = {"status": "failed" if wrong else "found", "name": r["name"], "arguments": shown, "format": tried[0] if wrong else r["format"], "repairs": r["repairs"], "problems": wrong}
        if not wrong:
            break
    return last


def feedback(p: dict, registry: dict) -> str:
    """What a model is told of a failed call."""
    if p["status"] != "failed":
        return ""
    lines = [f"The call could not be run: {x}" for x in p["problems"]]
    if p["name"] in registry:
        lines.append(f"{p['name']} takes {json.dumps(registry[p['name']], sort_keys=True)}")
    else:
        lines.append(f"Tools: {', '.join(sorted(registry))}")
    return "\n".join(lines)


CALL = "struct<status:string,name:string,arguments:string,format:string,repairs:array<string>,problems:array<string>>"


def parsed(responses: DataFrame, registry: dict[str, dict]) -> DataFrame:
    """responses (text, ...) with call. A null text holds no call."""
    return _by_text(responses, lambda t: parse(t, registry), "text", out="call", kind=CALL)
