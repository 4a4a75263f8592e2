"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte positions. Each pair of neighbours that the vocabulary can merge
waits in the bucket of its merge rank. Three levels of 64-bit words say which buckets have entries, so
that find-first-set at each level gives the next rank; a bucket gives its positions from the left.
Entries whose pair has changed meanwhile are stale and skipped. So a pre-token of n bytes takes O(n log n)
steps whatever it holds, and memory in proportion to n. Many short pre-tokens share one queue.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters up to which a pre-token's ids are kept, how many pre-tokens a worker keeps, and characters that wait to be merged together.
SHORT, KEPT, PENDING = 48, 600_000, 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file; a few MB at most, so that it can be sent to all workers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merger:
    """Merges pre-tokens, many at a time, in one queue."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        #: One object for each id, which all results share.
        self.ints = list(range(max(ranks.values()) + 1))
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.first = np.array([[ranks.get(bytes([i, j]), -1) for j in range(256)] for i in range(256)], dtype=np.int32)
        self.shift = max(ranks.values()).bit_length()
        #: The rank of each pair of tokens that the vocabulary has as one, by both ids.
        self.pairs = {ranks[t[:i]] << self.shift | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Each piece's ids: its pair of the lowest rank merges first, of equal ones the leftmost."""
        whole, shift, find, ints = np.frombuffer(b"".join(pieces), dtype=np.uint8), self.shift, self.pairs.get, self.ints
        n = len(whole)
        ids, nxt, prv, pair = (array("i", bytes(4 * (n + 2))) for _ in range(4))
        first = np.cumsum([0, *map(len, pieces)])[:-1]
        np.frombuffer(ids, dtype=np.int32)[:n] = self.single[whole]
        after, before, rank_at = (np.frombuffer(x, dtype=np.int32) for x in (nxt, prv, pair))
        after[:n], before[:n], rank_at[:] = np.arange(1, n + 1), np.arange(-1, n - 1), -1
        after[first[1:] - 1] = n  # a piece's last token has none after it, its first none before
        before[first] = -1
        rank_at[: n - 1] = np.where(after[: n - 1] < n, self.first[whole[:-1], whole[1:]], -1)
        # the buckets of all ranks, each from the left
        live = np.flatnonzero(rank_at >= 0)
        live = live[np.argsort(rank_at[live], kind="stable")]
        ranks, at = np.unique(rank_at[live], return_index=True)
        live, at = live.tolist(), [*at.tolist(), len(live)]
        buckets = {r: live[i:j] for r, i, j in zip(ranks.tolist(), at, at[1:])}
        low: dict[int, int] = {}
        mid: dict[int, int] = {}
        top = 0
        for rank in buckets:
            low[rank >> 6] = low.get(rank >> 6, 0) | 1 << (rank & 63)
        for i in low:
            mid[i >> 6] = mid.get(i >> 6, 0) | 1 << (i & 63)
        for j in mid:
            top |= 1 << j
        while top:
            # the first set bit at each level leads to the lowest rank that has entries
            j = (top & -top).bit_length() - 1
            i = j << 6 | ((mid[j] & -mid[j]).bit_length() - 1)
            now = i << 6 | ((low[i] & -low[i]).bit_length() - 1)
            low[i] &= low[i] - 1
            if not low[i]:
                mid[j] &= mid[j] - 1
                if not mid[j]:
                    top &= top - 1
            bucket = buckets.pop(now)
            bucket.sort()
            for k, at in enumerate(bucket):
                if pair[at] != now:
                    continue  # stale
                gone = nxt[at]
                end = nxt[at] = nxt[gone]
                pair[gone] = -1
                ids[at] = now
                least = now + 1
                if end < n:
                    prv[end] = at
                    rank = pair[at] = find(now << shift | ids[end], -1)
                    if rank >= 0:
                        least = rank if rank < least else least
                        if (bucket_ := buckets.get(rank)) is not None:
                            bucket_.append(at)
                        else:
                            buckets[rank] = [at]
                            low[rank >> 6] = low.get(rank >> 6, 0) | 1 << (rank & 63)
                            mid[rank >> 12] = mid.get(rank >> 12, 0) | 1 << (rank >> 6 & 63)
                            top |= 1 << (rank >> 12)
                else:
                    pair[at] = -1
                left = prv[at]
                if left >= 0:
                    rank = pair[left] = find(ids[left] << shift | now, -1)
                    if rank >= 0:
                        least = rank if rank < least else least
                        if (bucket_ := buckets.get(rank)) is not None:
                            bucket_.append(left)
                        else:
                            buckets[rank] = [left]
                            low[rank >> 6] = low.get(rank >> 6, 0) | 1 << (rank & 63)
                            mid[rank >> 12] = mid.get(rank >> 12, 0) | 1 << (rank >> 6 & 63)
                            top |= 1 << (rank >> 12)
                if least <= now:  # the rest of this bucket waits for what now comes before it
                    buckets.setdefault(now, []).extend(bucket[k + 1 :])
                    low[i] = low.get(i, 0) | 1 << (now & 63)
                    mid[j] = mid.get(j, 0) | 1 << (i & 63)
                    top |= 1 << j
                    break
        out = []
        for start, piece in zip(first.tolist(), pieces):
            at, got, end = start, [], start + len(piece)
            while at < end:
                got.append(ints[ids[at]])
                at = nxt[at]
            out.append(tuple(got))
        return out


class Codec:
    """Encodes texts by a vocabulary and a pattern that splits them first, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.merger = Merger(ranks)
        self.bytes_of: list[bytes | None] = [None] * len(self.merger.ints)
        for data, i in ranks.items():
            self.bytes_of[i] = data
        self.split = regex.compile(pattern).findall
        self.kept: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text. Texts go side by side until they have PENDING characters that aren't known yet."""
        start = 0
        while start < len(texts):
            if len(self.kept) > KEPT:
                self.kept.clear()
            parts, new, pending = [], set(), 0
            while start < len(texts) and pending < PENDING:
                parts.append(found := self.split(texts[start] or ""))
                more = set(found).difference(self.kept, new)
                pending += sum(map(len, more))
                new |= more
                start += 1
            self.learn(new)
            for found in parts:
                yield list(chain.from_iterable(map(self.kept.__getitem__, found)))
            for x in new:
                if len(x) > SHORT:
                    del self.kept[x]

    def learn(self, new: set[str]) -> None:
        ranks, pieces = self.merger.ranks, [x.encode() for x in new]
        merged = iter(self.merger.merge(rest) if (rest := [p for p in pieces if p not in ranks]) else ())
        self.kept.update((x, (self.merger.ints[ranks[p]],) if p in ranks else next(merged)) for x, p in zip(new, pieces))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


#: A worker's codecs, by vocabulary and pattern: what one task has learnt serves the next.
_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(sent: tuple[str, dict[bytes, int]], pattern: str) -> Codec:
    digest, ranks = sent
    if (digest, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[digest, pattern] = Codec(ranks, pattern)
    return _CODECS[digest, pattern]


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without the cycle collector for as long as a task encodes: it makes millions of tuples, and no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _sent(spark: SparkSession, vocabulary: str | None, pattern: str | None):
    """The vocabulary, with a digest of it, as a broadcast, and the pattern."""
    import public_tokenizers

    ranks = read_ranks(vocabulary or public_tokenizers.path(VOCABULARY))
    digest = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return spark.sparkContext.broadcast((digest, ranks)), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row of docs: the id and ids, the array of token ids of its whole text.

    vocabulary: path of a rank file; pattern: splits texts first; by default those of the public
    tokenizers that are installed. A null text is an empty one, with no ids. Rows may repeat, an empty
    table gives no rows, and other columns are ignored. Strings of special tokens are ordinary text.
    """
    sent, pattern = _sent(docs.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, pattern)
        with _uncollected():
            for batch in batches:
                ids = pa.array(list(codec.encode(batch.column(1).to_pylist())), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Per row: the id and data, the bytes of its ids. Null ids give empty bytes; an unknown id is an error."""
    sent, _ = _sent(encoded.sparkSession, vocabulary, "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {i: b for b, i in sent.value[1].items()}
        for batch in batches:
            data = [b"".join(map(bytes_of.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["id", "data"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, data binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row of docs: the id, n_tokens, ids_sha256 of the decimal ids joined by spaces, decoded_sha256 of the bytes decoded from them.

    As encode() and decode(), in one pass and without the ids leaving the workers.
    """
    sent, pattern = _sent(docs.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, pattern)
        decimal = list(map(str, range(len(codec.bytes_of)))).__getitem__
        with _uncollected():
            for batch in batches:
                yield digests(codec, decimal, batch)

    def digests(codec: Codec, decimal: Callable[[int], str], batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids_sha, decoded_sha = [], [], []
        for ids in codec.encode(batch.column(1).to_pylist()):
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
