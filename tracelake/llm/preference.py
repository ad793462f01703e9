"""Preference formatting: pairs of conversations into prompt, chosen and rejected completions with loss masks.

The longest common prefix of turns (role and text) of both conversations is found by comparing turns position by position;
it is rendered once as the prompt. What follows it in each conversation is a completion; completions come with character
spans of what is trained on: the texts of assistant turns, with their end marks.

A conversation is one row of the result, so its turns meet in one row; nothing else is gathered.
Markers that texts or roles hold themselves are escaped by a bar more (`<|` as `<||`, in roles `|>` as `||>`), so that no text can
forge a turn.

Defined cases: null roles are `user`, null texts empty; turns order by (turn, role, text), nulls first, so repeated turns
are kept; a conversation that is a prefix of the other has an empty completion; equal conversations have two; a pair whose
conversation has no turns is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.llm.common import table

OPEN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
TURN = "array<struct<role:string,text:string>>"


def gathered(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (role, text) in order."""
    t = F.struct(F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    g = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(t)).alias("t"))
    return g.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def marked(turn: dict) -> tuple[str, str]:
    """Role and text of a turn, without markers in them."""
    return turn["role"].replace(OPEN, OPEN + "|").replace("|>", "||>"), turn["text"].replace(OPEN, OPEN + "|")


def rendered(turns: list[dict]) -> tuple[str, list[dict]]:
    """The text of the turns, and the character spans [start, end) of the assistant's words and end marks in it."""
    parts, spans, at = [], [], 0
    for turn in turns:
        role, text = marked(turn)
        parts.append(f"{OPEN}{role}{MIDDLE}{text}{END}")
        begin, at = at + len(OPEN) + len(role) + len(MIDDLE), at + len(parts[-1])
        if turn["role"] == "assistant":
            spans.append({"start": begin, "end": at})
    return "".join(parts), spans


_SPANS = "array<struct<start:bigint,end:bigint>>"


def paired(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen, rejected (arrays of turns). Result: pair_id, n_common, prompt, and each completion with its spans.
    Linear in the turns, however long a conversation is."""
    p = pairs.where("size(chosen) > 0 and size(rejected) > 0").select("pair_id", F.col("chosen").cast(TURN).alias("chosen"), F.col("rejected").cast(TURN).alias("rejected"))
    schema = StructType([p.schema["pair_id"], *StructType.fromDDL(f"n_common int, prompt string, chosen string, chosen_spans {_SPANS}, rejected string, rejected_spans {_SPANS}").fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for b in batches:
            for at in range(b.num_rows):  # a row at a time: a conversation may be long
                a, r = b.column(1)[at].as_py(), b.column(2)[at].as_py()
                n = next((i for i, (x, y) in enumerate(zip(a, r)) if x != y), min(len(a), len(r)))
                made = [n, rendered(a[:n])[0], *rendered(a[n:]), *rendered(r[n:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 1), *[pa.array([v], k.type) for v, k in zip(made, list(kinds)[1:])]], names=schema.names)

    return p.mapInArrow(run, schema)


def echo_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs where none are given, one of every conversation: in the rejected form one of the assistant's answers,
    the (conv_id modulo their number)th, is replaced by the turn before it (or by nothing). So the forms part anywhere, and
    what follows is in both completions. Without an answer, or where it equals the turn before, both forms are equal."""
    g = gathered(conversations)
    answers = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("turns", i)["role"] == "assistant")
    once = lambda df, **cols: df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))  # noqa: E731  not per element of a lambda
    g = once(g.select("conv_id", F.col("turns").cast(TURN).alias("turns")), answers=answers)
    g = once(g, spot=F.when(F.size("answers") > 0, F.get("answers", F.pmod(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)), F.size("answers")).cast("int"))))
    said = F.coalesce(F.get("turns", F.col("spot") - 1)["text"], F.lit(""))
    echo = F.array(F.struct(F.lit("assistant").alias("role"), said.alias("text"))).cast(TURN)
    rest = F.slice("turns", F.col("spot") + 2, F.greatest(F.size("turns") - F.col("spot") - 1, F.lit(0)))
    swapped = F.when(F.col("spot").isNull(), F.col("turns")).otherwise(F.concat(F.slice("turns", 1, F.col("spot")), echo, rest))
    return g.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), swapped.alias("rejected"))



def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paired(echo_pairs(table(spark, sf_dir, "conversations")))
    trained = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return p.select(F.col("pair_id").alias("conv_id"), F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen", "rejected", trained("chosen_spans").alias("chosen_trained"), trained("rejected_spans").alias("rejected_trained"))


_SHOWN = "coalesce(list_aggregate(list_transform({0}, lambda x: '<|' || replace(replace(x.r, '<|', '<||'), '|>', '||>') || '|>' || chr(10) || replace(x.t, '<|', '<||') || '<|end|>' || chr(10)), 'string_agg', ''), '')"
_TRAINED = "cast(coalesce(list_sum(list_transform(list_filter({0}, lambda x: x.r = 'assistant'), lambda x: length(replace(x.t, '<|', '<||')) + 8)), 0) as bigint)"
ORACLE = f"""
with t as (select conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations),
g as (select conv_id, list({{'r': role, 't': text}} order by turn nulls first, role, text) as u from t group by conv_id),
a as (select *, list_filter(range(1, len(u) + 1), lambda i: u[i].r = 'assistant') as p from g),
k as (select *, case when len(p) > 0 then p[(coalesce(conv_id, 0) % len(p) + len(p)) % len(p) + 1] end as spot from a),
r as (select *, list_transform(u, lambda x, i: case when i = spot then {{'r': 'assistant', 't': coalesce(u[spot - 1].t, '')}} else x end) as v from k),
c as (select *, coalesce(nullif(list_position(list_transform(range(1, len(u) + 1), lambda i: u[i] = v[i]), false), 0) - 1, len(u)) as n_common from r)
select conv_id, cast(n_common as bigint) as n_common, {_SHOWN.format("u[1:n_common]")} as prompt,
 {_SHOWN.format("u[n_common + 1:]")} as chosen, {_SHOWN.format("v[n_common + 1:]")} as rejected,
 {_TRAINED.format("u[n_common + 1:]")} as chosen_trained, {_TRAINED.format("v[n_common + 1:]")} as rejected_trained
from c
"""
