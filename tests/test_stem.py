"""Stems by published examples, and stemmed ROUGE-L on every row next to a plain table."""

import re

import pytest

from airframe.functions.stem import stem, stems
from airframe.operators import scoring
from airframe.plans import base as B

# Examples printed with the published rules.
PAIRS = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor
sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file
happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform
radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form
formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin
gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat
rate rate cease ceas controll control roll roll dies die died die dying die news news""".split()


def test_published_pairs():
    assert [(a, stem(a)) for a in PAIRS[::2]] == list(zip(PAIRS[::2], PAIRS[1::2], strict=True))


def test_lists_of_words(spark):
    rows = spark.createDataFrame([(1, ["running", "was", "ties", "ies"]), (2, []), (3, None)], "i int, w array<string>")
    assert [r[1] for r in rows.select("i", stems("w")).orderBy("i").collect()] == [["run", "was", "tie", "ies"], [], None]


def plain(generated, expected, stemmed):
    g, e = ([stem(w) if stemmed and len(w) > 3 else w for w in re.findall("[a-z0-9]+", (t or "").lower())] for t in (generated, expected))
    line = [0] * (len(e) + 1)
    for w in g:
        new = [0]
        for j, x in enumerate(e):
            new.append(line[j] + 1 if w == x else max(line[j + 1], new[j]))
        line = new
    return 2 * line[-1] / (len(g) + len(e)) if line[-1] else 0.0


@pytest.mark.parametrize("stemmed", [True, False])
def test_every_row_next_to_a_plain_table(spark, sf, stemmed):
    rows = B.answers(spark, sf).select("conv_id", "turn", "raw_answer", "raw_question")
    got = scoring.rouge_l(rows, "raw_answer", "raw_question", stemmed=stemmed).collect()
    assert got and all(r.rouge_l == pytest.approx(plain(r.raw_answer, r.raw_question, stemmed)) for r in got)


def test_inflected_words_are_equal_when_stemmed(spark):
    df = spark.createDataFrame([("Sensitive groups limited outdoor activities", "sensitive group limits outdoor activity")], "g string, r string")
    assert scoring.rouge_l(df, "g", "r").first().rouge_l == 1.0 and scoring.rouge_l(df, "g", "r", stemmed=False).first().rouge_l == pytest.approx(0.4)
