"""Text expressions: token estimates, line folding, redaction, personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered secret patterns and their markers; later ones see the text that earlier ones left.
SECRETS = [
    (r"-----BEGIN [A-Z ]+PRIVATE KEY-----[\s\S]*?-----END [A-Z ]+PRIVATE KEY-----", "private_key"),
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "jwt"),
    (r"sk-(?:ant-)?[A-Za-z0-9_-]{20,}", "openai_key"),
    (r"gh[psohr]_[A-Za-z0-9]{36}", "github_token"),
    (r"github_pat_[A-Za-z0-9_]{22,}", "github_token"),
    (r"AKIA[0-9A-Z]{16}", "aws_access_key"),
    (r"xox[baprs]-[A-Za-z0-9-]{10,}", "slack_token"),
    (r"ya29\.[A-Za-z0-9_-]+", "google_token"),
    (r"[sr]k_live_[A-Za-z0-9]{16,}", "stripe_key"),
    (r"(?i)(postgresql|postgres|mysql|mongodb(\+srv)?|redis|amqps?|rabbitmq)://[^:@\s]+:[^@\s]+@\S+", "db_url"),
    (r"(?i)(password|passwd|secret|token|api[_-]?key|apikey)\s*[=:]\s*\S+", "tagged_value"),
    (r"(?i)[?&](password|passwd|secret|token|api[_-]?key|apikey)=[^\s&]+", "tagged_value"),
    (r"(?i)bearer\s+\S+", "tagged_value"),
]
# Patterns of personal data.
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"(?:\+?1[-.\s])?(?:\(\d{3}\)\s?|\d{3}[-.\s])\d{3}[-.\s]\d{4}",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "mac": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "card": r"\b\d{4}(?:[ -]?\d{4}){2,4}\b",
}
ANSI = r"\x1b\[[0-9;]*[A-Za-z]"
_PUNCT = r"!-/:-@\[-`{-~"
_CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"


#: What a text must hold, in lower case, for a pattern to match: looked for first, as most texts hold no secret.
_HINTS = ["private key", "eyj", "sk-", "gh", "github_pat_", "akia", "xox", "ya29", "k_live_", "://", None, None, "bearer"]
_NAMES = "(?i)passw|secret|token|key"
ENTROPY_BITS, _CANDIDATE = 4.0, r"[A-Za-z0-9+/=_]{24,}"


def entropy(text: Column) -> Column:
    """Shannon entropy of the bytes, in bits."""
    pairs = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit("(..)"), F.lit(1))
    share = lambda b: F.size(F.filter(pairs, lambda x: x == b)) / F.size(pairs)
    return F.aggregate(F.array_distinct(pairs), F.lit(0.0), lambda a, b: a - share(b) * F.log2(share(b)))


def _masked(pattern: str, marker: str, hint: str | None):
    def done(t: Column) -> Column:
        maybe = t.rlike(_NAMES) if hint is None else F.contains(F.lower(t), F.lit(hint))
        return F.when(maybe, F.regexp_replace(t, F.lit(pattern), F.lit(marker))).otherwise(t)

    return done


def redact_secrets(text: Column, unicode: bool = True, high_entropy: bool = False) -> Column:
    """Known shapes of secrets as markers; with high_entropy also long words whose bytes look random."""
    for (pattern, kind), hint in zip(SECRETS, _HINTS):
        text = bound(text, _masked(("(?U)" if unicode else "") + pattern, f"[REDACTED:{kind}]", hint))
    if high_entropy:
        words = F.regexp_extract_all(text, F.lit(_CANDIDATE), F.lit(0))
        parts = F.split(text, _CANDIDATE)
        shown = F.transform(words, lambda w: F.when(entropy(w) >= ENTROPY_BITS, "[REDACTED:high_entropy]").otherwise(w))
        text = F.array_join(F.flatten(F.zip_with(parts, shown, lambda p, w: F.array(p, F.coalesce(w, F.lit(""))))), "")
    return text


def found(text: Column, kind: str, unicode: bool = True) -> Column:
    return F.regexp_extract_all(text, F.lit(("(?U)" if unicode else "") + PERSONAL[kind]), F.lit(0))


def luhn(digits: Column) -> Column:
    """Of a string of ASCII digits."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return (digits != "") & (F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0)


def cards(text: Column, unicode: bool = True) -> Column:
    """Card numbers of 13 to 19 digits with a valid checksum."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    return F.filter(found(text, "card", unicode), lambda c: F.length(digits(c)).between(13, 19) & luhn(digits(c)))


def token_estimate(text: Column) -> Column:
    """Marks and East Asian characters count one each, any other run a quarter of its characters, rounded up."""
    runs = F.regexp_extract_all(text, F.lit(rf"(?U)[^\s{_PUNCT}{_CJK}]+"), F.lit(0))
    single = F.regexp_count(text, F.lit(rf"[{_PUNCT}{_CJK}]"))
    return (F.aggregate(runs, F.lit(0).cast("long"), lambda a, w: a + F.ceil(F.length(w) / 4)) + single).cast("long")


def head_tail(lines: Column, head: int = 20, last: int = 80, over: int = 100, kept_in: str | None = None) -> Column:
    """Lines beyond `over`: the first and last ones around a marker with the number left out and, if they are, where all are kept."""
    n = F.size(lines)
    where = " lines omitted; full output not retained …]" if kept_in is None else f" lines omitted — full output: {kept_in} …]"
    mark = F.array(F.concat(F.lit("[… "), (n - head - last).cast("string"), F.lit(where)))
    return F.when(n > over, F.concat(F.slice(lines, 1, head), mark, F.slice(lines, -last, last))).otherwise(lines)


def bound(value: Column, then) -> Column:
    """then(value), with value computed once even where lambdas use it per element."""
    return F.get(F.transform(F.array(value), then), 0)


def collapse_lines(text: Column) -> Column:
    """ANSI codes stripped; a line repeated n times in a row becomes `line (xn)`; each line ends with a line feed."""
    body = F.regexp_replace(text, ANSI, "")

    def folded(lines):
        first = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | ~F.get(lines, i).eqNullSafe(F.get(lines, i - 1)))

        def joined(starts):
            def shown(i, k):
                n = F.coalesce(F.get(starts, k + 1), F.size(lines)) - i
                return F.concat(F.get(lines, i), F.when(n > 1, F.concat(F.lit(" (x"), n.cast("string"), F.lit(")"))).otherwise(""), F.lit("\n"))

            return F.array_join(F.transform(starts, shown), "")

        return bound(first, joined)

    return F.when(body == "", "").otherwise(bound(F.split(F.regexp_replace(body, r"\n\z", ""), "\n"), folded))


def detected_formats(text: Column) -> Column:
    """All formats of a tool call that a response may hold, in the order in which they are tried; plain text only if no other."""
    braces = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    found = F.array_compact(F.array(
        F.when(F.contains(text, F.lit("<tool_call>")), F.lit("hermes")), F.when(F.contains(text, F.lit("<function=")), F.lit("xml")), F.when(F.contains(text, F.lit("```json")), F.lit("fenced")),
        F.when(F.contains(text, F.lit("```yaml")) | text.rlike(r"(?mU)(^|\n)name:\s+\S+\s*\n\s*arguments:"), F.lit("yaml")), F.when((braces("{") > 0) & (braces("{") == braces("}")), F.lit("loose_json")),
    ))
    return F.when(F.size(found) > 0, found).when(text.rlike(r"(?U)\w+\(\w+\s*="), F.array(F.lit("text"))).otherwise(found)


def strip_thinking(text: Column) -> Column:
    closed = F.regexp_replace(text, r"(?s)<think>.*?</think>\n?", "")
    return F.regexp_replace(closed, r"(?s)<think>.*\z", "")


# How lines of build and test progress begin.
NOISE = ["Compiling ", "Checking ", "Finished ", "Running ", "Downloaded ", "Downloading ", "Blocking ", "Updating ", "Locking ", "Fresh ", "Dirty ", "Replaced ", "Unpacking "]


def is_noise(line: Column) -> Column:
    """Whether a line of test output tells of progress or a test that passed."""
    t = F.ltrim(line)
    out = (t.startswith("test ") & t.endswith(" ... ok")) | (t.startswith("running ") & F.contains(t, F.lit(" test")))
    for p in NOISE:
        out = out | t.startswith(p)
    return out


def quiet(lines: Column) -> Column:
    """Lines of test output without noise; of blank lines in a row one stays, none at the ends."""
    kept = F.filter(lines, lambda x: ~is_noise(x))
    blank = lambda x: F.trim(x) == ""

    def thinned(rows):
        last = F.aggregate(F.transform(rows, lambda x, i: F.when(~blank(x), i)), F.lit(-1), lambda a, i: F.greatest(a, F.coalesce(i, F.lit(-1))))
        return F.filter(F.transform(rows, lambda x, i: F.when(~blank(x), x).when((i > 0) & (i < last) & ~blank(F.get(rows, i - 1)), F.lit(""))), lambda x: x.isNotNull())

    return bound(kept, thinned)


def name_distance(name: Column, target: str, most: int) -> Column:
    """Edits between two names, null beyond `most`."""
    d = F.levenshtein(name, F.lit(target), most)
    return F.when(d >= 0, d.cast("long"))
