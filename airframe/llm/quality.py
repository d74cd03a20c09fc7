"""Quality rules: a table of thresholds compiled into one Spark projection.

A measure is SQL text over the words and lines of a text, which are parted once for each row. A rule compares two
measures as whole numbers, so that nothing depends on rounding. Everything is built-in functions in a single
``select``: no user function, no shuffle, and a row needs memory in proportion to its own text only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airframe.llm.common import pick, query, table

#: Frequent function words of the four languages of the corpus, lower case.
STOP_WORDS = (
    "the of and to in is that it was for on are as with be this by at from have not or an but "  # English
    "der die das und ist nicht ein eine mit von den dem des zu auf sich im als "  # German
    "le la les de et un une du des en que qui est dans pour pas par au aux "  # French
    "el los las del que y en una por con para se su al lo como es"  # Spanish
).split()
SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """A text passes when ``low * whole <= per * part <= high * whole``; a side that is None is not looked at.

    ``whole`` None stands for 1, so that the rule bounds a count.
    """

    name: str
    part: str
    whole: str | None
    low: int | None
    high: int | None
    per: int = 1


#: What every text has to meet.
BASE = (
    Rule("few_words", "n_words", None, 50, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 50, per=100),
)
#: What the method asks for besides.
RULES = (
    Rule("word_length", "word_chars", "n_words", 25, 120, per=10),
    Rule("symbols", "n_symbols", "n_words", None, 10, per=100),
    Rule("stop_words", "n_stop_words", None, 2, None),
    Rule("stop_word_share", "n_stop_words", "n_words", 2, None, per=100),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 30, per=100),
    Rule("letters", "n_letter_words", "n_words", 80, None, per=100),
)


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


SPACE = "[\\\\x20\\\\x09-\\\\x0D]"
WORDS = f"filter(split(body, '{SPACE}+', -1), x -> x <> '')"
LINES = "filter(split(body, '\\n', -1), x -> rlike(x, '[^\\\\x20\\\\x09-\\\\x0D]'))"

#: Windows of three words: their hashes with the place in the lowest ``s`` bits, sorted, so that equal windows are neighbours;
#: the places whose hash agrees with a neighbour's, few in most texts; these windows themselves, sorted, so that the
#: texts decide and not the hashes; the places that have an equal window; the words these cover, each counted up to
#: the next such place.
PLACE_BITS = "length(bin(size(w)))"
HASHES = "sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft(shiftright(xxhash64(w[i], w[i + 1], w[i + 2]), s), s) | i))"
ALIKE = "transform(filter(h, (x, k) -> coalesce(shiftright(x ^ get(h, k - 1), s) = 0, false) OR coalesce(shiftright(x ^ get(h, k + 1), s) = 0, false)), x -> int(x & (shiftleft(1L, s) - 1)))"
WINDOWS = "sort_array(transform(c, i -> struct(concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) AS g, i AS i)))"
TWICE = "filter(g, (x, k) -> coalesce(x.g = get(g, k - 1).g, false) OR coalesce(x.g = get(g, k + 1).g, false))"
PLACES = f"sort_array(transform({TWICE}, x -> x.i))"
COVERED = "aggregate(transform(p, (x, k) -> coalesce(least(get(p, k + 1) - x, 3), 3)), 0L, (n, x) -> n + x)"


def let(*steps: str) -> str:
    """The last step with each name before it standing for its value, ``name, value, name, value, ..., body``; a value is
    computed once for each row."""
    body = steps[-1]
    for name, value in reversed(list(zip(steps[:-1:2], steps[1:-1:2], strict=True))):
        body = f"transform(array({value}), {name} -> {body})[0]"
    return body


REPEATED = f"if(size(w) < 4, 0L, {let('s', PLACE_BITS, 'h', HASHES, 'c', ALIKE, 'g', WINDOWS, 'p', PLACES, COVERED)})"


def measures(stop_words: Sequence[str] = STOP_WORDS) -> dict[str, str]:
    """SQL text of each measure over ``w`` (words), ``l`` (lines with a word) and ``body``."""
    stops = ", ".join(quoted(x) for x in dict.fromkeys(stop_words)) or "NULL"
    return {
        "n_words": "size(w)",
        "word_chars": "aggregate(w, 0L, (n, x) -> n + length(x))",
        "n_symbols": f"length(body) - length(regexp_replace(body, '[{SYMBOLS}]+', ''))",
        "n_lines": "size(l)",
        "n_dup_lines": "size(l) - size(array_distinct(l))",
        "n_repeat_words": REPEATED,
        "n_stop_words": f"size(filter(w, x -> coalesce(lower(x) IN ({stops}), false)))",
        "n_letter_words": "size(filter(w, x -> rlike(x, '\\\\p{L}')))",
    }


def meets(rule: Rule) -> str:
    whole = rule.whole or "1"
    sides = [f"{rule.low} * {whole} <= {rule.per} * {rule.part}"] if rule.low is not None else []
    sides += [f"{rule.per} * {rule.part} <= {rule.high} * {whole}"] if rule.high is not None else []
    return " AND ".join(sides) or "true"


def judged(docs: DataFrame, id: str = "doc_id", text: str = "text", base: Sequence[Rule] = BASE, rules: Sequence[Rule] = RULES, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``(doc_id, <measures>, base_failed, kept, failed)`` per row; ``failed`` lists the names of the rules not met.

    Words are parted by ASCII white space, lines by ``\\n``. A NULL text counts as an empty one: all measures are 0
    and it fails the bound on words. Rows are judged one by one, so repeated rows, ties and NULL ids stay as they
    are; an empty table gives no rows; other columns, whatever their names, are left out. A text of any length is
    measured whole.
    """
    named = measures(stop_words)
    fields = ", ".join(f"CAST({sql} AS BIGINT) AS {name}" for name, sql in named.items())
    rows = pick(docs, doc_id=id, text=text).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    measured = rows.select("doc_id", F.expr(let("w", WORDS, "l", LINES, f"struct({fields})")).alias("m")).select("doc_id", "m.*")
    tried = [F.when(~F.expr(meets(r)), F.lit(r.name)) for r in (*base, *rules)]
    failed = F.array_compact(F.array(*tried)) if tried else F.array().cast("array<string>")
    fails = [f"NOT ({meets(r)})" for r in base]
    keeps = [f"({meets(r)})" for r in (*base, *rules)]
    return measured.select("*", F.expr(" OR ".join(fails) or "false").alias("base_failed"), F.expr(" AND ".join(keeps) or "true").alias("kept"), failed.alias("failed"))


def sql_twin() -> str:
    """The same measures for DuckDB: repeated windows by joining and counting rows instead of sorting arrays."""
    word = r"'[^\x20\x09-\x0D]+'"
    stops = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
    fails = " OR ".join(f"NOT ({meets(r)})" for r in BASE)
    keeps = " AND ".join(f"({meets(r)})" for r in (*BASE, *RULES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
t AS (SELECT *, regexp_extract_all(body, {word}) AS w, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, {word})) AS l FROM d),
u AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
g AS (SELECT r, i, x || ' ' || lead(x) OVER s || ' ' || lead(x, 2) OVER s AS g FROM u WINDOW s AS (PARTITION BY r ORDER BY i)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM p, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(body) - length(regexp_replace(body, '[{SYMBOLS}]', '', 'g')) AS n_symbols, len(l) AS n_lines,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
        len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
        len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_letter_words
      FROM t LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {fails} AS base_failed, {keeps} AS kept FROM m
"""


@query("op12_quality", sql_twin())
def op12_quality(spark, sf):
    return judged(table(spark, sf, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
