"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

Subwords are byte n-grams inside the words of the lower-cased text, word marks included, hashed into buckets.
The model is trained by stochastic gradient descent in numpy on a bounded sample of labelled rows; a temperature
and a rejection threshold are then set on rows of the sample that were not trained on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airframe.llm.common import arrow_of, by_row, pick, query, table

UNKNOWN = "und"
BUCKET_BITS, SIZES, DIM = 15, (2, 3, 4), 16
#: Bounds of the sample: languages (the most frequent ones) and labelled rows of each.
MAX_LANGS, ROWS_PER_LANG = 200, 600
#: How many times the wanted rows the bound on hashes lets through.
SPARE_DRAW = 4
EPOCHS, RATE, CALIBRATE_EVERY = 6, 0.5, 4
#: Share of calibration rows that the threshold may reject.
REJECT = 0.001
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets of a whole text and how often each occurs; ``None`` without any letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    body = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS).split()) + b" "
    codes = np.frombuffer(body, np.uint8).astype(np.uint32)
    space, parts = codes == 32, []
    code, inner = codes, np.zeros(len(codes), bool)
    for size in range(2, max(SIZES) + 1):
        if len(code) < 2:
            break
        code = (code[:-1] << np.uint32(8)) | codes[size - 1 :]
        inner = inner[:-1] | (space[size - 2 : -1] if size > 2 else False)
        if size in SIZES:
            hashed = (code[~inner] + np.uint32(size)) * np.uint32(0x9E3779B1)
            parts.append(hashed >> np.uint32(32 - BUCKET_BITS))
    counts = np.bincount(np.concatenate(parts), minlength=1 << BUCKET_BITS)
    buckets = np.flatnonzero(counts)
    return (buckets, counts[buckets]) if len(buckets) else None


@dataclass
class Model:
    """Per bucket the logits it adds (embedding times output weights), bias, temperature, threshold."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def score(self, bag_: tuple | None) -> tuple[str, float]:
        if bag_ is None or not self.langs:
            return UNKNOWN, 0.0
        p = softmax(self.logits(bag_) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, p[best]))

    def logits(self, bag_: tuple) -> np.ndarray:
        buckets, counts = bag_
        return counts @ self.weights[buckets] / counts.sum() + self.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 0) -> Model:
    """Train on three rows of four, calibrate on the fourth. No samples give a model without languages."""
    langs = sorted({lang for lang, _, _ in samples})
    if not langs:
        return Model([], np.zeros((0, 0)), np.zeros(0), 1.0, 0.0)
    spare = [s for i, s in enumerate(samples) if i % CALIBRATE_EVERY == CALIBRATE_EVERY - 1]
    train = [s for i, s in enumerate(samples) if i % CALIBRATE_EVERY != CALIBRATE_EVERY - 1]
    rng, index = np.random.default_rng(seed), {lang: i for i, lang in enumerate(langs)}
    embed = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM))
    out, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    steps, total = 0, EPOCHS * len(train)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            lang, buckets, counts = train[i]
            share = counts / counts.sum()
            rate = RATE * (1 - steps / total)
            hidden = share @ embed[buckets]
            error = softmax(hidden @ out + bias)
            error[index[lang]] -= 1
            back = out @ error
            out -= rate * np.outer(hidden, error)
            bias -= rate * error
            embed[buckets] -= (rate * len(buckets) ** 0.5) * share[:, None] * back
            steps += 1
    model = Model(langs, embed @ out, bias, 1.0, 0.0)
    if spare:
        logits = np.array([model.logits((b, c)) for _, b, c in spare])
        truth = np.array([index[lang] for lang, _, _ in spare])
        logits -= logits.max(axis=1, keepdims=True)

        def loss(t: float) -> float:
            z = logits / t
            return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

        model.temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))
        scores = [model.score((b, c))[1] for _, b, c in spare]
        model.threshold = float(min(0.5, np.quantile(scores, REJECT)))
    return model


def hash_bound(rows: int) -> int:
    """Largest hash to look at for the smallest hashes of so many rows; every hash when the rows are few."""
    share = min(1.0, SPARE_DRAW * ROWS_PER_LANG / rows)
    return min(int(share * 2.0**64) - (1 << 63), (1 << 63) - 1)


def train(docs: DataFrame, id="doc_id", text="text", lang="lang") -> Model:
    """Fit on a sample of ``docs``: the rows of each language with the smallest hashes of their id.

    A language's count bounds the hashes that are looked at, so that the task which orders them gets a few thousand rows
    however large the table is. Where repeats of few ids make up a language, it may learn from fewer rows.

    Rows with a NULL id, text or language are not learned from. The bags of at most
    ``MAX_LANGS * ROWS_PER_LANG`` rows reach the driver, each of no more than ``2 ** BUCKET_BITS`` buckets.
    """
    rows = pick(docs, doc_id=id, text=text, lang=lang).where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("lang", F.col("lang").cast("string")).withColumn("h", F.xxhash64("doc_id"))
    common = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}
    # No hash above the bound can be among the smallest: of c rows about SPARE_DRAW * ROWS_PER_LANG lie below it.
    bounds = [F.when(F.col("lang") == name, F.lit(hash_bound(c))) for name, c in common.items()]
    near = rows.select("doc_id", "lang", "h").where(F.col("h") <= F.coalesce(*bounds, F.lit(None).cast("long")))
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= ROWS_PER_LANG).select("doc_id", "lang").distinct()
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").limit(MAX_LANGS * ROWS_PER_LANG)
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())])

    def row(lang, h, text):
        found = bag(text)
        return (lang, h, *(x.astype(np.int32).tobytes() for x in found)) if found else None

    bags = sample.select("lang", "h", "text").mapInArrow(by_row(row, schema), "lang string, h long, buckets binary, counts binary")
    got = sorted(bags.collect(), key=lambda r: (r.h, r.lang, r.buckets))
    return fit([(r.lang, np.frombuffer(r.buckets, np.int32), np.frombuffer(r.counts, np.int32)) for r in got])


def identify(docs: DataFrame, model: Model, id="doc_id", text="text") -> DataFrame:
    """``(doc_id, lang_pred, score, accepted)`` for every row of ``docs``, from its whole text alone.

    A text that is NULL or has no letter, and any text when no language was learned, is ``und`` with score 0 and
    is not accepted; other texts are accepted from the calibrated threshold on. Repeated rows get equal
    answers, an empty table gives no rows.
    """
    rows = pick(docs, doc_id=id, text=text).select("doc_id", F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", arrow_of(rows, "doc_id")), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    def row(key, text):
        lang, score = sent.value.score(bag(text))
        return key, lang, score, lang != UNKNOWN and score >= sent.value.threshold

    return rows.mapInArrow(by_row(row, schema), f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame, model: Model, text="text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is accepted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = [c.lower() for c in docs.columns].index(text.lower()) if text not in docs.columns else docs.columns.index(text)

    def run(batches):
        for batch in batches:
            answers = (sent.value.score(bag(v.as_py())) for v in batch.column(place))
            kept = pa.array([lang != UNKNOWN and score >= sent.value.threshold for lang, score in answers], pa.bool_())
            yield batch.filter(kept)

    return docs.mapInArrow(run, docs.schema)


def held_out(id: str) -> Column:
    """Rows kept for the test of accuracy; a NULL id is not held out, and not learned from either."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 4 == 2, F.lit(False))


@query("op5_language")
def op5_language(spark, sf):
    docs = table(spark, sf, "documents")
    model = train(docs.where(~held_out("doc_id")))
    return identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")
