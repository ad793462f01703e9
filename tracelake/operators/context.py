"""Context of a conversation: stale and repeated reads, compaction to a budget.

Messages: conv, idx, role, turn, content, tokens, tool (name of the call or of the result), path, ranged. A call is followed by
its result at idx + 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import token_estimate

# The share of the ceiling that compaction aims at, and how many of the last turns it does not shorten.
TARGET, PROTECTED = 0.75, 3


def one_path(path: Column, root: str | None) -> Column:
    """A path as one name, however it is written: below root relative to it, without `.`, doubled slashes and what `..` takes
    back. Without a root absolute paths stay absolute."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    back = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    climbs = lambda a: (F.size(a) == 0) | (F.element_at(a, -1) == "..")
    absolute = path.startswith("/")
    step = lambda a, x: F.when(x != "..", F.concat(a, F.array(x))).when(~climbs(a), back(a)).when(absolute, a).otherwise(F.concat(a, F.array(x)))
    flat = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return flat if root is None else F.when(flat.startswith(root.rstrip("/") + "/"), F.substr(flat, F.lit(len(root.rstrip("/")) + 2))).otherwise(flat)


def reads(messages: DataFrame) -> DataFrame:
    """Whole-file reads: conv, idx (of the result), turn, path, tokens."""
    w = Window.partitionBy("conv").orderBy("idx")
    m = messages.select("conv", "idx", "turn", "tool", "path", "ranged", "role", F.lead("tool").over(w).alias("next_tool"), F.lead("role").over(w).alias("next_role"), F.lead("tokens").over(w).alias("next_tokens"), F.lead("idx").over(w).alias("next_idx"))
    own = m.where("role = 'assistant' and tool = 'read_file' and next_role = 'tool' and next_tool = 'read_file'")
    return own.select("conv", F.col("next_idx").alias("idx"), "turn", "path", F.coalesce("ranged", F.lit(False)).alias("ranged"), F.col("next_tokens").alias("tokens"))


def superseded(messages: DataFrame, edits: DataFrame, note_tokens: int = 24, root: str | None = None) -> DataFrame:
    """Reads (ranged ones too) that a later edit of their path makes stale: conv, idx, path, turn of the first such edit and the
    tokens that a note of note_tokens in their place frees. edits: conv, idx, turn, path. Paths meet as one_path() has them."""
    e = edits.select(F.col("conv").alias("__c"), one_path(F.col("path"), root).alias("__p"), F.col("idx").alias("__i"), F.col("turn").alias("__t"))
    r = reads(messages).withColumn("path", one_path(F.col("path"), root))
    j = r.join(e, (F.col("conv") == F.col("__c")) & (F.col("path") == F.col("__p")) & (F.col("__i") > F.col("idx")))
    g = j.groupBy("conv", "idx", "path", "tokens").agg(F.min_by("__t", "__i").alias("turn"))
    return g.select("conv", "idx", "path", "turn", F.greatest(F.col("tokens") - note_tokens, F.lit(0)).alias("reclaimed"))


def repeated(messages: DataFrame, edits: DataFrame, note_tokens: int = 36, root: str | None = None) -> DataFrame:
    """Whole-file reads of a path that was read whole before and not edited since: conv, idx, path, prior_turn and the tokens of
    the prior read that a note in place of this one saves."""
    w = Window.partitionBy("conv", "path").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    one = one_path(F.col("path"), root).alias("path")
    r = reads(messages).where("not ranged").select("conv", one, "idx", "turn", "tokens", F.lit(True).alias("read"))
    e = edits.select("conv", one, "idx", "turn", F.lit(0).cast("bigint").alias("tokens"), F.lit(False).alias("read"))
    last = F.last(F.struct("read", "turn", "tokens")).over(w)
    d = r.unionByName(e).select("*", last.alias("before")).where(F.col("read") & F.col("before.read"))
    return d.select("conv", "idx", "path", F.col("before.turn").alias("prior_turn"), F.greatest(F.col("before.tokens") - note_tokens, F.lit(0)).alias("saved"))


_OPEN, _CLOSE = "<tool_result>", "</tool_result>"


def _note(body: Column, what: str) -> Column:
    """What stands in the place of a result."""
    sizes = [F.octet_length(body).cast("string"), F.lit(" bytes / "), token_estimate(body).cast("string")]
    return F.concat(F.lit("[compacted: "), *sizes, F.lit(f" tokens — {what} compacted for budget]"))


def _text_body() -> Column:
    return F.substring("content", len(_OPEN) + 1, F.length("content") - len(_OPEN) - len(_CLOSE))


def _first_result() -> Column:
    return F.get("results", F.lit(0))


def message_tokens() -> Column:
    """Of a message's content, the arguments of its calls and its results."""
    each = lambda of, f: F.aggregate(F.coalesce(F.transform(of, f), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.coalesce(token_estimate(F.col("content")), F.lit(0)) + each("calls", token_estimate) + each("results", lambda r: token_estimate(r["content"]))


def compacted(messages: DataFrame, ceiling: int, prompt: str = "") -> DataFrame:
    """conv, idx, action (keep, shorten or evict), tokens of each message afterwards, and of its conversation before and
    after_all, the estimates with the prompt. A conversation is to fit TARGET of the ceiling. messages: conv, idx, role, turn,
    content, calls (array of arguments), results (array of tool, content); null arrays and texts are empty.

    Three passes, each until the conversation fits: results in texts of the user are shortened, the oldest first; then structured
    results by value (first of other tools than read_file, then by turn and place), those of the last PROTECTED turns and those
    that are notes already not; then messages that are not of the system go, the oldest first. What was freed before a message
    is a running sum in the order of the pass. A note may be longer than what it replaces: in the first pass the total may rise
    again, so the pass ends at the first message before which it fits."""
    m = messages.withColumns({"content": F.coalesce("content", F.lit("")), "__first": F.coalesce(_first_result()["content"], F.lit(""))})
    wrapped = (F.col("role") == "user") & F.col("content").startswith(_OPEN) & F.col("content").endswith(_CLOSE) & ~F.col("content").contains("[compacted:")
    noted = F.col("__first").contains("[compacted:") | F.col("__first").startswith("[superseded:") | F.col("__first").startswith("[already-read:")
    structured = (F.col("role") == "tool") & (F.coalesce(F.size("results"), F.lit(0)) > 0) & ~noted
    rank = F.when(structured, F.when(_first_result()["tool"] == "read_file", 1).otherwise(0))
    fresh = F.when(wrapped, token_estimate(F.concat(F.lit(_OPEN), _note(_text_body(), "original content"), F.lit(_CLOSE))) - token_estimate(F.col("content")))
    less = F.when(rank.isNotNull(), token_estimate(_note(F.col("__first"), "tool result")) - token_estimate(F.col("__first")))
    d = m.select("conv", "idx", "role", "turn", message_tokens().alias("t"), fresh.alias("d1"), rank.alias("rank"), less.alias("d2"))

    w, target = Window.partitionBy("conv"), int(ceiling * TARGET)
    in_order, upto = w.orderBy("idx"), (Window.unboundedPreceding, -1)
    before = lambda c, order: F.coalesce(F.sum(c).over(order.rowsBetween(*upto)), F.lit(0))
    d = d.select("*", (F.sum("t").over(w) + token_estimate(F.lit(prompt))).alias("before"), F.max("turn").over(w).alias("newest"))
    d = d.withColumn("run", F.col("before") + before("d1", in_order))
    d = d.withColumn("did1", F.col("d1").isNotNull() & (F.min("run").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) > target))
    d = d.withColumn("left", F.col("before") + F.coalesce(F.sum(F.when(F.col("did1"), F.col("d1"))).over(w), F.lit(0)))
    d = d.withColumn("can", F.col("rank").isNotNull() & ~F.coalesce(F.col("newest") - F.col("turn") < PROTECTED, F.lit(False)))
    gain = F.when(F.col("can"), F.greatest(-F.col("d2"), F.lit(0)))
    d = d.withColumn("gain", gain)
    d = d.withColumn("did2", F.col("can") & (F.col("left") - before("gain", w.orderBy(F.when(F.col("can"), F.col("rank")), F.coalesce("turn", F.lit(0)), "idx")) > target))
    d = d.withColumn("left", F.col("left") - F.coalesce(F.sum(F.when(F.col("did2"), F.col("gain"))).over(w), F.lit(0)))
    d = d.withColumn("now", F.col("t") + F.when(F.col("did1"), F.col("d1")).when(F.col("did2"), F.col("d2")).otherwise(0))
    goes = F.when(F.col("role") != "system", F.col("now"))
    d = d.withColumn("out", (F.col("role") != "system") & (F.col("left") - before(goes, in_order) > target))
    d = d.withColumn("after_all", F.greatest(F.col("left") - F.coalesce(F.sum(F.when(F.col("out"), F.col("now"))).over(w), F.lit(0)), F.lit(0)))
    action = F.when(F.col("out"), "evict").when(F.col("did1") | F.col("did2"), "shorten").otherwise("keep")
    shortened = F.col("did1") | F.col("did2")
    return d.select("conv", "idx", action.alias("action"), F.when(F.col("out"), 0).otherwise(F.col("now")).cast("bigint").alias("tokens"), F.col("before").cast("bigint").alias("before"), F.col("after_all").cast("bigint").alias("after_all"), shortened.alias("shortened"))


def compaction_report(actions: DataFrame) -> DataFrame:
    """Per conversation the tokens before and after, and how many messages were shortened (some of them evicted later) and
    evicted."""
    return actions.groupBy("conv").agg(F.first("before").alias("tokens_before"), F.first("after_all").alias("tokens_after"), F.count_if("shortened").alias("shortened"), F.count_if(F.col("action") == "evict").alias("evicted"))


def rewritten(messages: DataFrame, actions: DataFrame) -> DataFrame:
    """The messages that stay, with notes in the place of results that were shortened."""
    j = messages.join(actions.where("action <> 'evict'").select("conv", "idx", F.col("shortened").alias("__s")), ["conv", "idx"])
    text = F.when(F.col("__s") & (F.col("role") == "user"), F.concat(F.lit(_OPEN), _note(_text_body(), "original content"), F.lit(_CLOSE))).otherwise(F.col("content"))
    noted = F.transform("results", lambda r, i: F.when(i == 0, F.struct(r["tool"].alias("tool"), _note(F.coalesce(r["content"], F.lit("")), "tool result").alias("content"))).otherwise(F.struct(r["tool"].alias("tool"), r["content"].alias("content"))))
    results = F.when(F.col("__s") & (F.col("role") == "tool"), noted).otherwise(F.col("results"))
    return j.withColumns({"content": text, "results": results}).drop("__s")
