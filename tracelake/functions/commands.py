"""Shell commands, hosts and capped fields as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts and patterns of commands that are blocked, and the pattern of edits in place.
BLOCKED_PARTS = ["mkfs", "git push", "git checkout .", "git restore .", "npm publish", "cargo publish", "twine upload", "gh release create"]
BLOCKED = [
    r"rm\s+(?:-[a-zA-Z]*r[a-zA-Z]*f[a-zA-Z]*|-[a-zA-Z]*f[a-zA-Z]*r[a-zA-Z]*|-[a-zA-Z]*r[a-zA-Z]*(?:\s+-[a-zA-Z]*)*f[a-zA-Z]*|-[a-zA-Z]*f[a-zA-Z]*(?:\s+-[a-zA-Z]*)*r[a-zA-Z]*)\b",
    r"dd\s.*\bof=/dev/",
    r"(curl|wget)\b.*\|\s*(sh|bash|zsh)\b",
    r">\s*/dev/sd",
    r">\s*/dev/nvme",
    r":\(\)\s*\{\s*:\|:",
    r"git\s+clean\s+(-[a-zA-Z]*f[a-zA-Z]*)",
    r"git\s+push\b.*\b(--force|-f)\b",
    r"chmod\s+-r\s+777\s+/",
    r"chown\s+-r\s+",
    r"eval\s+\"\$\(curl",
    r"eval\s+\"\$\(wget",
    r"git\s+reset\s+--hard",
    r"pip[0-9]*\s+.*\bupload\b",
    r"(?:^|[;&|(\n])\s*(?:shutdown\b|reboot\b|halt\b|poweroff\b|sudo\b|su\s+-|su\s+root\b|kill\s+-9\b|pkill\b|killall\b|init\s+[06]\b)",
]
IN_PLACE = r"\b(?:sed|perl)\b[^|;&]*\s-[a-z]*i"
# Shapes of personal data that a prompt is held back for.
GUARDED = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    r"(\+?1[-. ])?(\([0-9]{3}\)|[0-9]{3})[-. ][0-9]{3}[-. ][0-9]{4}",
    r"[0-9]{4}([ -]?[0-9]{4}){3}",
]
# The greatest length of a field in bytes, of a preview and of a line's preview in characters.
FIELD_BYTES, PREVIEW, LINE_PREVIEW = 50_000, 500, 100


def severity(command: Column) -> Column:
    """block, refuse_in_place_edit or allow. Blocked shapes are looked for in lower case with single blanks, edits in place in
    the command as it is."""
    low = F.regexp_replace(F.lower(command), r"(?U)\s+", " ")
    bad = F.lit(False)
    for part in BLOCKED_PARTS:
        bad = bad | F.contains(low, F.lit(part))
    return F.when(bad | low.rlike("|".join(f"(?:{p})" for p in BLOCKED)), "block").when(command.rlike(IN_PLACE), "refuse_in_place_edit").otherwise("allow")


def host(url: Column) -> Column:
    """Of a URL, with or without a scheme, user and port; of an IPv6 literal what is in the brackets."""
    authority = F.regexp_replace(F.split(F.regexp_replace(url, r"^(?:(?!://)[\s\S])*://", ""), "/")[0], r"^[\s\S]*@", "")
    return F.when(authority.startswith("["), F.split(F.substr(authority, F.lit(2)), "]")[0]).otherwise(F.split(authority, ":")[0])


def is_local(url: Column) -> Column:
    """Whether a host is surely of this machine or network: localhost, loopback and private addresses, .local, .lan, .internal."""
    h = F.lower(host(url))
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = h.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    private = v4 & h.rlike(r"^(?:127\.|10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)")
    return (h == "localhost") | private | h.rlike(r"^(?:0*:){2,7}0*1$") | h.rlike(r"\.(?:local|lan|internal)$")


def redacts_egress(enabled: Column, forced: Column, url: Column) -> Column:
    """Never where privacy is off; else as forced, and where nothing is, for every host that is not local."""
    return F.when(~enabled, F.lit(False)).otherwise(F.coalesce(forced, ~is_local(url)))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def _after_git(command: Column) -> Column:
    """Of each part of a command line that runs git, the words after it."""
    parts = F.transform(F.split(command, r"[&;|]"), _tokens)
    return F.transform(F.filter(parts, lambda p: F.array_contains(p, "git")), lambda p: F.slice(p, F.array_position(p, "git").cast("int") + 1, F.greatest(F.size(p), F.lit(1))))


def stashes(command: Column) -> Column:
    """Whether changes of the working tree are stashed away: `git stash`, alone or with push or save."""
    def pushing(words: Column) -> Column:
        sub = F.get(F.filter(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda x: ~x.startswith("-")), F.lit(0))
        return (F.get(words, F.lit(0)) == "stash") & (sub.isNull() | sub.isin("push", "save"))

    return F.coalesce(F.exists(_after_git(command), lambda w: F.coalesce(pushing(w), F.lit(False))), F.lit(False))


def restored_paths(command: Column) -> Column:
    """What `git checkout` and `git restore` may put back: their words that are no flags."""
    runs = F.filter(_after_git(command), lambda w: F.coalesce(F.get(w, F.lit(0)).isin("checkout", "restore"), F.lit(False)))
    return F.flatten(F.transform(runs, lambda w: F.filter(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x: ~x.startswith("-"))))


def _single_git(command: Column, sub: str) -> Column:
    words = _tokens(command)
    return ~command.rlike("[&;|]") & F.coalesce((F.get(words, F.lit(0)) == "git") & (F.get(words, F.lit(1)) == sub), F.lit(False))


def is_commit(command: Column) -> Column:
    """One command, `git commit`, that is no dry run."""
    return _single_git(command, "commit") & ~F.exists(_tokens(command), lambda x: x.isin("--dry-run", "-n"))


def is_short_status(command: Column) -> Column:
    """One command, `git status` in a short form."""
    return _single_git(command, "status") & F.exists(_tokens(command), lambda x: x.isin("--short", "-s", "--porcelain") | x.startswith("--porcelain="))


def is_clean(output: Column, own_folder: str) -> Column:
    """Whether the output of a short status, after its first line, names nothing but files in the folder of the tool itself."""
    body = F.when(F.contains(output, F.lit("\n")), F.regexp_replace(output, r"^[^\n]*\n", "")).otherwise(output)
    return F.forall(F.split(body, "\n"), lambda x: (F.trim(x) == "") | F.ltrim(F.substr(F.trim(x), F.lit(3))).startswith(own_folder))


def capped(text: Column, most: int = FIELD_BYTES) -> Column:
    """Characters that begin within the first `most` bytes, and a note of how many bytes more the text has."""
    data = text.cast("binary")
    inside = lambda i: F.coalesce(F.conv(F.hex(F.substring(data, most + 1 + i, 1)), 16, 10).cast("int").between(128, 191), F.lit(False))
    more = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    kept = F.decode(F.substr(data, F.lit(1), F.lit(most) + more), "UTF-8")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(kept, F.lit("\n\n[truncated: "), (F.octet_length(text) - most).cast("string"), F.lit(" bytes elided]")))


def preview(text: Column) -> Column:
    return F.left(text, F.lit(PREVIEW))


def line_preview(text: Column) -> Column:
    """On one line, cut with an ellipsis."""
    flat = F.translate(F.left(text, F.lit(LINE_PREVIEW + 1)), "\n\t", "  ")  # what is cut off is not looked at
    return F.when(F.length(flat) > LINE_PREVIEW, F.concat(F.left(flat, F.lit(LINE_PREVIEW)), F.lit("…"))).otherwise(flat)


def prompt_guarded(text: Column) -> Column:
    """Whether a prompt holds what looks like an e-mail address, a social security number, a phone or a card number."""
    out = F.lit(False)
    for pattern in GUARDED:
        out = out | text.rlike(pattern)
    return out


def segments(raw: Column) -> Column:
    """Array of (text, thinking): the parts between think marks, without empty ones. A closing mark before any opening one means
    that the text begins inside thinking."""
    marks = F.regexp_extract_all(raw, F.lit("</?think>"), F.lit(0))
    parts = F.split(raw, "</?think>")
    inside = lambda i: F.when(i == 0, F.coalesce(F.get(marks, F.lit(0)) == "</think>", F.lit(False))).otherwise(F.get(marks, i - 1) == "<think>")
    return F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("text"), inside(i).alias("thinking"))), lambda s: s["text"] != "")
