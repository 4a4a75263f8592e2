"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. The spans of its tokens are then joined with those of its
sections, both of them sorted, and a token that crosses a boundary goes by an explicit rule:

- start: to the section in which it starts;
- majority: to the section that has most of it, of several the first;
- split: to each section in proportion to its share.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.byte_bpe import Codec, _codec, _sent, _uncollected
from weft.llm.common import table

RULES = ("start", "majority", "split")


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str, starts: np.ndarray | None = None) -> tuple[np.ndarray, int, float]:
    """Tokens of each section, the number of tokens that cross a boundary, and tokens of no section.

    ends: where each token ends; starts, bounds: where each section starts and ends, in order; by default
    a section starts where the one before ends. What lies between sections, and after the last, is of no
    section and takes part in the rule as one of its own. Empty sections get none.
    """
    if not len(ends):
        return np.zeros(len(bounds)), 0, 0.0
    starts = np.concatenate([[0], bounds[:-1]]) if starts is None else starts
    # gap, section, gap, section, ..., gap: where each ends
    cuts = np.append(np.stack([starts, bounds], axis=1).ravel(), max([ends[-1], *bounds[-1:]])).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first = np.searchsorted(cuts, begins, side="right")
    last = np.searchsorted(cuts, ends, side="left")
    crossing = np.flatnonzero(last > first)
    to, out = first, np.zeros(len(cuts))
    if rule != "start" and len(crossing):
        to = first.copy()
        edges = np.concatenate([[0], cuts])
        for i in crossing:  # few
            k = np.arange(first[i], last[i] + 1)
            share = np.minimum(edges[k + 1], ends[i]) - np.maximum(edges[k], begins[i])
            if rule == "majority":
                to[i] = k[share.argmax()]
            else:
                out[k] += share / share.sum()
        if rule == "split":
            to = np.delete(first, crossing)
    out += np.bincount(to, minlength=len(cuts))
    return out[1::2], len(crossing), float(out[0::2].sum())


def token_attribution(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", section: bytes = rb"[^\n]*\n|[^\n]+$", rule: str = "majority", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of docs: the id, n_tokens, n_sections, n_crossing, section_tokens (an array of doubles, in the order of sections), outside_tokens.

    section: a pattern over bytes whose matches are the sections; by default the lines, each with its line
    end. What no match covers is of no section, and its tokens are outside_tokens. A null or empty text has no tokens and no sections. Rows may repeat, an empty
    table gives no rows, and other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    sent, pattern = _sent(docs.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, spans = _codec(sent.value, pattern), re.compile(section).finditer
        length = np.array([len(b or b"") for b in codec.bytes_of], dtype=np.int64)
        with _uncollected():
            for batch in batches:
                yield counted(codec, spans, length, batch)

    def counted(codec: Codec, spans: Callable[[bytes], Iterable[re.Match]], length: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        n, crossing, tokens, outside = [], [], [], []
        for text, ids in zip(texts, codec.encode(texts)):
            at = np.array([m.span() for m in spans((text or "").encode())], dtype=np.int64).reshape(-1, 2)
            count, across, rest = attribute(np.cumsum(length[np.array(ids, dtype=np.int64)]), at[:, 1], rule, at[:, 0])
            n.append(len(ids))
            crossing.append(across)
            tokens.append(count)
            outside.append(rest)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(list(map(len, tokens)), pa.int64()), pa.array(crossing, pa.int64()), pa.array(tokens, pa.list_(pa.float64())), pa.array(outside, pa.float64())], ["id", "n_tokens", "n_sections", "n_crossing", "section_tokens", "outside_tokens"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>, outside_tokens double").withColumnRenamed("id", id_col)


def op7_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_attribution(table(spark, sf_dir, "documents"))
