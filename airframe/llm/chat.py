"""Preference pairs for training, in DataFrame and SQL functions only.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once as the prompt; what
follows is rendered for each side, with the spans of characters that training may learn from: the words of the
assistant and the mark that ends them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airframe.llm.common import pick, query, table

#: Fixed values of the chat format.
START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def conversations(turns: DataFrame, id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """``(conv_id, turns)``: the turns of a conversation in order, as ``array<struct<role, text>>``.

    NULL roles and texts are empty strings, NULL turns come first, equal turn numbers are ordered by role and text.
    Turns with a NULL id are one conversation. A conversation is one row because its rendering is one text.
    """
    rows = pick(turns, conv_id=id, turn=turn, role=role, text=text).na.fill("", ["role", "text"])
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return listed.select("conv_id", F.expr("transform(turns, t -> named_struct('role', t.role, 'text', t.text))").alias("turns"))


def rendered(turns: str) -> Column:
    return F.expr(f"array_join(transform({turns}, t -> concat('{START}', t.role, '\\n', t.text, '{END}\\n')), '')")


def learned_spans(turns: str) -> Column:
    """Spans ``[start, stop)`` of the rendered text that count in training, as ``array<struct<start, stop>>``."""
    head = f"(s.at + {len(START) + 1} + length(t.role))"
    return F.expr(
        f"""aggregate({turns}, named_struct('at', 0, 'spans', CAST(array() AS array<struct<start:int,stop:int>>)),
        (s, t) -> named_struct('at', {head} + length(t.text) + {len(END) + 1},
            'spans', IF(t.role = '{LEARNED}', array_append(s.spans, named_struct('start', {head}, 'stop', {head} + length(t.text) + {len(END)})), s.spans)),
        s -> s.spans)"""
    )


def preferences(pairs: DataFrame) -> DataFrame:
    """``pairs`` has ``pair_id``, ``chosen`` and ``rejected`` (arrays of turns); one row comes out for each.

    ``n_prompt_turns`` turns are common and rendered in ``prompt``; ``chosen`` and ``rejected`` hold the rest,
    ``chosen_spans`` and ``rejected_spans`` the characters to learn from. Equal conversations have empty completions, a
    side that is a prefix of the other has an empty one, NULL sides count as empty. Other columns are left out.
    """
    rows = pick(pairs, pair_id="pair_id", chosen="chosen", rejected="rejected")
    empty = "CAST(array() AS array<struct<role:string,text:string>>)"
    rows = rows.selectExpr("pair_id", f"coalesce(chosen, {empty}) AS c", f"coalesce(rejected, {empty}) AS r")
    apart = "filter(sequence(0, least(size(c), size(r))), i -> i = least(size(c), size(r)) OR NOT (get(c, i) <=> get(r, i)))"
    rows = rows.withColumn("n", F.expr(f"array_min({apart})"))
    rows = rows.selectExpr("pair_id", "n", "slice(c, 1, n) AS p", "slice(c, n + 1, size(c)) AS c", "slice(r, n + 1, size(r)) AS r")
    return rows.select(
        "pair_id",
        F.col("n").alias("n_prompt_turns"),
        rendered("p").alias("prompt"),
        rendered("c").alias("chosen"),
        learned_spans("c").alias("chosen_spans"),
        rendered("r").alias("rejected"),
        learned_spans("r").alias("rejected_spans"),
    )


def repeating(turns: DataFrame) -> DataFrame:
    """Pairs from single conversations: rejected is the conversation whose last answer repeats the turn that the
    assistant had before (without one: the turn just before). Conversations without an answer have no pair."""
    last = "array_max(filter(sequence(0, size(turns) - 1), i -> turns[i].role = 'assistant'))"
    rows = turns.withColumn("last", F.expr(last)).where("last IS NOT NULL")
    before = "array_max(filter(sequence(0, last), i -> i < last AND turns[i].role = 'assistant'))"
    rows = rows.withColumn("source", F.expr(f"coalesce({before}, last - 1)"))
    said = "IF(source < 0, '', get(turns, source).text)"
    rejected = f"transform(turns, (t, i) -> IF(i = last, named_struct('role', t.role, 'text', {said}), t))"
    return rows.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.expr(rejected).alias("rejected"))


def spans_text(name: str) -> Column:
    return F.expr(f"array_join(transform({name}, s -> concat(s.start, '-', s.stop)), ',')").alias(name)


def _sql_side(a: str) -> str:
    return f"""list_transform({a}, lambda t: '{START}' || t.role || chr(10) || t.text || '{END}' || chr(10))"""


def _sql_spans(a: str) -> str:
    sizes = f"list_transform({a}, lambda t: {len(START) + 1 + len(END) + 1} + length(t.role) + length(t.text))"
    start = f"coalesce(list_sum({sizes}[:i - 1]), 0)::BIGINT + {len(START) + 1} + length(t.role)"
    return f"""array_to_string(list_filter(list_transform({a}, lambda t, i: CASE WHEN t.role = 'assistant'
        THEN ({start}) || '-' || ({start} + length(t.text) + {len(END)}) END), lambda s: s IS NOT NULL), ',')"""


SQL = f"""
WITH l AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS turns
           FROM conversations GROUP BY conv_id),
a AS (SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS last FROM l),
b AS (SELECT *, coalesce(list_max(list_filter(range(1, last), lambda i: turns[i].role = 'assistant')), last - 1) AS src FROM a WHERE last IS NOT NULL),
p AS (SELECT conv_id, turns AS c, list_transform(turns, lambda t, i: CASE WHEN i = last
        THEN struct_pack(role := t.role, text := CASE WHEN src < 1 THEN '' ELSE turns[src].text END) ELSE t END) AS r FROM b),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, len(c) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1, len(c)) AS n FROM p),
s AS (SELECT conv_id, n, c[:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM n)
SELECT conv_id, n::INTEGER AS n_prompt_turns, array_to_string({_sql_side('p')}, '') AS prompt,
  array_to_string({_sql_side('c')}, '') AS chosen, {_sql_spans('c')} AS chosen_spans,
  array_to_string({_sql_side('r')}, '') AS rejected, {_sql_spans('r')} AS rejected_spans
FROM s
"""


@query("op2_preferences", SQL)
def op2_preferences(spark, sf):
    pairs = repeating(conversations(table(spark, sf, "conversations")))
    found = preferences(pairs)
    return found.select(F.col("pair_id").alias("conv_id"), "n_prompt_turns", "prompt", "chosen", spans_text("chosen_spans"), "rejected", spans_text("rejected_spans"))
