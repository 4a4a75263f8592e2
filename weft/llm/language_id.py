"""Language identification by sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters, letters lower-cased and all else as one space, are hashed to `BINS`
features. A document's features are log(1 + count) times the inverse document frequency, of length 1.
The languages and the document frequencies come from all documents that may be learnt from. The weights
are learnt from a sample, of each language as many, the first by a hash of the id, by
follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties, which leaves most weights at
zero. A fifth of the sample is kept back to set the temperature that calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import held_out, table

BINS = 1 << 15
#: Documents to learn weights from, shared by the languages, but LEAST of each if it has them; of one text no more distinct n-grams than BINS are sent.
SAMPLE, LEAST = 3000, 100
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.02, 3
UNKNOWN = "und"

_LETTER = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x10000)])
_MULTIPLY = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)


def bins(text: str | None) -> np.ndarray | None:
    """The bins of all n-grams of a text, or None if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _LETTER[np.minimum(c, 0xFFFF)]
    for i in np.flatnonzero(c > 0xFFFF):
        letter[i] = chr(int(c[i])).isalpha()
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each run of letters
    c = np.concatenate([[np.uint32(32)], np.where(letter, c, np.uint32(32))[keep], [np.uint32(32)]]).astype(np.uint32)
    one = c * _MULTIPLY[0]
    two = one[:-1] ^ (c[1:] * _MULTIPLY[1] + np.uint32(0x9E3779B9))
    three = two[:-1] ^ (c[2:] * _MULTIPLY[2] + np.uint32(0x85EBCA6B))
    shift = np.uint32(32 - BINS.bit_length() + 1)
    return np.concatenate([(x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift for x in (one, two, three)])


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    found = bins(text)
    if found is None:
        return None
    if len(found) < BINS // 4:
        return np.unique(found, return_counts=True)
    count = np.bincount(found, minlength=BINS)
    return (nz := np.flatnonzero(count)), count[nz]


def _vector(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


class Model:
    """Sparse weights of each language, with the temperature of its probabilities."""

    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float) -> None:
        self.langs, self.weights, self.idf, self.temperature = langs, weights, idf, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        found = _counts(text)
        if found is None or not self.langs:
            return UNKNOWN, 0.0
        p = _softmax(self.weights[:, found[0]] @ _vector(*found, self.idf) / self.temperature)
        return self.langs[best := int(p.argmax())], float(min(1.0, p[best]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (k x BINS) by FTRL-proximal with L1 and L2, one example at a time in a fixed order."""
    z, n = np.zeros((k, BINS)), np.zeros((k, BINS))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    random = np.random.default_rng(0)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(z[:, at], n[:, at])
            p = _softmax(w @ x)
            p[y] -= 1
            g = p[:, None] * x
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA
            z[:, at] += g - sigma * w
            n[:, at] += g * g
    return weights(z, n)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many documents each bin is, and how many documents there are: BINS + 1 numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (found := bins(text)) is not None:
                    has = np.zeros(BINS, dtype=bool)
                    has[found] = True
                    total[:-1] += has
                    total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bin", "n"])

    got = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BINS + 1, dtype=np.int64)
    total[got["bin"]] = got["n"]
    return total[:-1], int(total[-1])


def _frame(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, least: int = LEAST) -> Model:
    """A model learnt from rows whose lang is not null; an id has the least lang of its rows.

    Languages and frequencies cover all of them. Weights come from max(least, sample / languages) ids of
    each language at most, of each id the least row; four times as many ids, and 64, of each language
    come to the driver to be chosen from. Without a row that has a letter the model knows no
    language. With fewer than 25 ids none is kept back, and the temperature is that of the ids learnt from.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    frequency, n = document_frequencies(rows, "text")
    # the sample is found by ids alone, so that no texts are moved; an id counts once, however often it repeats
    ids = rows.where("id is not null").groupBy("id").agg(F.min("lang").alias("lang")).withColumn("h", F.xxhash64("id", F.lit(1)))
    per = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toPandas()  # a row for each language
    quota = max(least, sample // max(1, len(per)))
    # low hashes that surely hold the first `quota` of a language, and not many more, whatever its size
    bar = [(x, int(min(2.0**63 - 1025, 2.0**64 * (4 * quota + 64) / k - 2.0**63))) for x, k in zip(per["lang"], per["n"])]
    bars = F.broadcast(_frame(labelled, bar, "lang string, bar long"))
    low = ids.join(bars, "lang").where("h <= bar").select("lang", "h", "id").toPandas().sort_values(["lang", "h", "id"])
    first = _frame(labelled, [(x,) for x in low.groupby("lang").head(quota)["id"]], "id string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, lang, *found) for i, lang, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), map(_counts, batch.column(2).to_pylist())) if found]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2].astype(np.uint16).tobytes() for x in out], pa.binary()), pa.array([x[3].astype(np.uint32).tobytes() for x in out], pa.binary())], ["id", "lang", "at", "n"])

    got = rows.join(F.broadcast(first), "id", "left_semi").mapInArrow(run, "id string, lang string, at binary, n binary").groupBy("id").agg(F.min(F.struct("lang", "at", "n")).alias("row")).select("id", "row.*").orderBy("id").toPandas()
    idf = np.log((1 + n) / (1 + frequency)) + 1
    langs = sorted(set(got["lang"]))
    every = [(at := np.frombuffer(a, dtype=np.uint16).astype(np.int64), _vector(at, np.frombuffer(c, dtype=np.uint32), idf), langs.index(y)) for a, c, y in zip(got["at"], got["n"], got["lang"])]
    if not every:
        return Model([], np.zeros((0, BINS)), idf, 1.0)
    kept_back = every[::5] if len(every) >= 25 else every
    weights = ftrl([x for i, x in enumerate(every) if len(every) < 25 or i % 5], len(langs))
    logits, truth = np.array([weights[:, at] @ x for at, x, _ in kept_back]), np.array([y for *_, y in kept_back])
    grid = np.geomspace(0.05, 10, 60)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    return Model(langs, weights.astype(np.float32), idf.astype(np.float32), float(grid[int(np.argmin(loss))]))


def language_id(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, lang_pred, score (the calibrated probability of lang_pred).

    A null text, or one without a letter, is `und` with score 0. Equal probabilities go to the language
    first by code point. Rows may repeat; other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x BINS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def learnable(id_: Column) -> Column:
    return ~held_out(id_)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id(docs, fit(docs.where(learnable(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
