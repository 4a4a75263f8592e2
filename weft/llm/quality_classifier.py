"""A quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; all documents that may be learnt from are unlabelled text, the
trusted ones among them. A linear model on what a text looks like minimises the non-negative unbiased
risk: pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)), where a step that would push the
second term below zero is taken back instead. The class prior pi is estimated first: no region can hold
less than pi times the positives' share of it, so pi is the least ratio of the unlabelled share to the
positive share over the regions of high scores of a plain model, scored out of sample.

Weights are learnt from a bounded sample. Means and spreads of the features, and the unlabelled shares
that give the prior, are sums over all documents that may be learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import held_out, table

#: Positives and unlabelled documents to learn weights from, at most: the first by a hash of the id.
POSITIVES, UNLABELLED = 2000, 4000
#: Sums of features are of whole numbers, units of one part in so many, so that their order doesn't matter.
UNIT = float(1 << 20)
#: Regions of high scores that the prior is looked for in: those above a quantile of the positives'.
REGIONS = np.linspace(0, 0.8, 41)
THRESHOLD = 0.7
_SPECIAL = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _classes() -> np.ndarray:
    """A class for each byte: a mark of its own for ASCII punctuation; else upper, lower, digit, space, line end, control, other."""
    out = np.full(256, 0, dtype=np.int64)
    for b in range(128):
        c = chr(b)
        out[b] = 1 if c.isupper() else 2 if c.islower() else 3 if c.isdigit() else 4 if c in " \t" else 5 if c == "\n" else 7 + _SPECIAL.index(c) if c in _SPECIAL else 6
    return out


_CLASS = _classes()
_N = 7 + len(_SPECIAL)
#: Pairs of classes, then eight figures of the whole text.
FEATURES = _N * _N + 8


def features(text: bytes | None) -> np.ndarray:
    """What a whole text looks like: square roots of the shares of pairs of classes, and figures of words and lines."""
    out = np.zeros(FEATURES, dtype=np.float32)
    text = text or b""
    c = _CLASS[np.frombuffer(text, dtype=np.uint8)]
    if len(c) > 1:
        out[: _N * _N] = np.sqrt(np.bincount(c[:-1] * _N + c[1:], minlength=_N * _N) / (len(c) - 1))
    found = text.lower().split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, m = len(found), len(lines)
    length = np.fromiter(map(len, found), dtype=np.float64, count=n) if n else np.zeros(1)
    out[_N * _N :] = (np.log1p(n) / 10, len(set(found)) / max(n, 1), len(set(lines)) / max(m, 1), np.log1p(n / max(m, 1)) / 5, length.mean() / 20, length.std() / 10, n < 10, n == 0)
    return out


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (x @ w[:-1].astype(x.dtype)).astype(np.float64) + w[-1]


def _pull(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The mean of x's rows, and of 1 for the intercept, each times its a."""
    return np.append((a.astype(x.dtype) @ x).astype(np.float64), a.sum()) / len(x)


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of the logistic loss pi * R+(p), R-(u) - pi * R-(p), and their gradients. The last weight is the intercept."""
    sp, su = _logits(p, w), _logits(u, w)
    up, uu = _sigmoid(sp), _sigmoid(su)
    of_positive = prior * np.logaddexp(0, -sp).mean()
    of_negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
    return of_positive, of_negative, prior * _pull(up - 1, p), _pull(uu, u) - prior * _pull(up, p)


def _descend(gradient, width: int, steps: int, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights and intercept from zero by steps of adaptive moments."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        g = gradient(w)
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_weights(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 600) -> np.ndarray:
    """Weights, the last of them the intercept, that minimise the non-negative risk."""

    def gradient(w: np.ndarray) -> np.ndarray:
        _, negative, of_p, of_n = risk(w, p, u, prior)
        return of_p + of_n if negative >= 0 else -of_n

    return _descend(gradient, p.shape[1], steps)


def fit_plain(p: np.ndarray, u: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights of a logistic model that tells positives from unlabelled rows."""

    def gradient(w: np.ndarray) -> np.ndarray:
        return _pull(_sigmoid(_logits(p, w)) - 1, p) + _pull(_sigmoid(_logits(u, w)), u)

    return _descend(gradient, p.shape[1], steps)


def prior_of(share_p: np.ndarray, n_p: int, share_u: np.ndarray, n_u: int) -> float:
    """The prior from the shares of positives and of unlabelled rows in the regions. Each is taken one standard error towards a higher prior, so that the least ratio isn't a matter of chance."""
    upper = share_u + np.sqrt(share_u * (1 - share_u) / n_u)
    lower = share_p - np.sqrt(share_p * (1 - share_p) / n_p)
    return float(np.clip((upper / np.maximum(lower, 1e-9)).min(), 0.05, 0.98))


class Model:
    """Means and spreads of the features, weights and intercept; the estimated prior."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, prior: float) -> None:
        self.mean, self.spread, self.weights, self.prior = mean, spread, weights, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_logits(_scaled(x, self.mean, self.spread), self.weights))


def _scaled(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / spread, -8, 8)


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Up to 1024 rows at a time with their features."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            yield part, np.stack([features(t) for t in part.column(column).cast(pa.binary()).to_pylist()])


def moments(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each feature over all rows of texts (text); one row per feature comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((2, FEATURES), dtype=np.int64)
        for _, x in _blocks(batches, 0):
            n += len(x)
            x = x.astype(np.float64)
            total += np.stack([np.rint(x * UNIT).astype(np.int64).sum(axis=0), np.rint(x * x * UNIT).astype(np.int64).sum(axis=0)])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES), pa.int32()), pa.array(np.full(FEATURES, n)), pa.array(total[0]), pa.array(total[1])], ["k", "n", "s", "q"])

    got = texts.select("text").mapInArrow(run, "k int, n long, s long, q long").groupBy("k").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q"))).orderBy("k").toPandas()
    if not len(got):
        return np.zeros(FEATURES, dtype=np.float32), np.ones(FEATURES, dtype=np.float32)
    mean = got["s"].to_numpy() / got["n"].to_numpy() / UNIT
    square = got["q"].to_numpy() / got["n"].to_numpy() / UNIT
    return mean.astype(np.float32), (np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-3).astype(np.float32)


def shares(texts: DataFrame, models: list[Model], at: np.ndarray) -> tuple[np.ndarray, int]:
    """The share of rows of texts (fold, text) whose logit by the model of their fold is at least each of `at`, and their number."""
    sent = texts.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, above = 0, np.zeros(len(at), dtype=np.int64)
        for part, x in _blocks(batches, 1):
            fold = part.column(0).to_numpy()
            for k, model in enumerate(sent.value):
                if (here := fold == k).any():
                    z = _logits(_scaled(x[here], model.mean, model.spread), model.weights)
                    above += (z[:, None] >= at).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at)), pa.int32()), pa.array(np.full(len(at), n)), pa.array(above)], ["k", "n", "above"])

    got = texts.select("fold", "text").mapInArrow(run, "k int, n long, above long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("above").alias("above")).orderBy("k").toPandas()
    n = int(got["n"].iloc[0]) if len(got) else 0
    return (got["above"].to_numpy() / max(n, 1) if n else np.ones(len(at))), n


def _fold(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_, F.lit(5)), F.lit(2)).cast("int")


def _sampled(texts: DataFrame, first: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and folds of the ids of first, of each its least text, in an order of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["fold", "x"])

    # an id is learnt from once, however often it repeats
    one = texts.join(F.broadcast(first), "id").groupBy("id", "fold").agg(F.min("text").alias("text"))
    got = one.select("fold", "text").mapInArrow(run, "fold int, x binary").toPandas()
    x, fold = np.frombuffer(b"".join(got["x"]), dtype=np.float32).reshape(-1, FEATURES), got["fold"].to_numpy(dtype=np.int64)
    order = np.lexsort((*x[:, -8:].T, x[:, : _N * _N].sum(axis=1), fold)) if len(x) else np.arange(0)
    return x[order], fold[order]


def fit(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_positive: int = POSITIVES, n_unlabelled: int = UNLABELLED) -> Model:
    """A model learnt from docs, of which positives (one column, the id) are trusted; all of docs are unlabelled text.

    Weights come from at most n_positive and n_unlabelled ids; means, spreads and the prior from every row
    of docs, where an id that repeats counts as often. With fewer than two positives or documents in
    either half of a sample the model gives every text the prior of 0.5.
    """
    texts = docs.select(F.col(id_col).alias("id"), _fold(F.col(id_col)).alias("fold"), F.col(text_col).cast("string").alias("text"))
    mean, spread = moments(texts)
    hashed = lambda ids: ids.where("id is not null").distinct().orderBy(F.xxhash64("id", F.lit(9)), "id")
    ids = texts.select("id")
    p, fold_p = _sampled(texts, hashed(ids.join(positives.toDF("id"), "id", "left_semi")).limit(n_positive))
    u, fold_u = _sampled(texts, hashed(ids).limit(n_unlabelled))
    if min(*(np.bincount(f, minlength=2).min() for f in (fold_p, fold_u))) < 2:
        return Model(mean, spread, np.zeros(FEATURES + 1), 0.5)
    zp, zu = _scaled(p, mean, spread), _scaled(u, mean, spread)
    # the model of a fold has seen the other fold only
    plain = [Model(mean, spread, fit_plain(zp[fold_p != k], zu[fold_u != k]), 0.5) for k in (0, 1)]
    score = np.zeros(len(zp))
    for k, model in enumerate(plain):
        score[fold_p == k] = _logits(zp[fold_p == k], model.weights)
    at = np.quantile(score, REGIONS)
    share_u, n_u = shares(texts, plain, at)
    share_p = 1 - np.searchsorted(np.sort(score), at) / len(score)
    prior = prior_of(share_p, len(score), share_u, n_u)
    return Model(mean, spread, fit_weights(zp, zu, prior), prior)


def quality_classifier(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, score, the estimated probability of label 1.

    A null text is an empty one and scored like any other. Rows may repeat; other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.scores(x), pa.float64())], ["id", "score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    open_ = docs.where(~held_out(F.col("doc_id")))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    out = quality_classifier(docs, fit(open_, trusted))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
