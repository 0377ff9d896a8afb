"""Encoding of a corpus with a byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; the bytes of each word are merged in a
contiguous rank array: the part boundaries and, for each boundary, the rank of the pair
that begins there. The smallest rank is found by scanning, its inner boundary deleted and
the two neighbouring ranks refreshed, until no pair has a rank. Words above ``LONG_WORD``
bytes, for which repeated scanning would be quadratic, keep the same parts in a linked
list with a heap of candidate pairs; both give the same parts.

Defined cases: a null or empty text gives an empty list; the strings of special tokens are
ordinary text; every other text gives the ids of all its bytes, however long it is; rows
that repeat are encoded each on its own (from a cache of words).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files of public tokenizers lie; a parameter of every call.
VOCABULARIES = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

# The pattern that splits text before the merges of this vocabulary. The white
# space is spelt out, as the regex module counts U+001C to U+001F as white space and the
# vocabulary's own pattern doesn't.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

LONG_WORD = 256
#: Most bytes of a vocabulary file that is broadcast.
VOCABULARY_BYTES = 32 << 20
_NONE = 1 << 30
_CACHE_WORDS = 200_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """token bytes -> rank, of a file with one base64 token and its rank in each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def _short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    get = ranks.get
    bounds = list(range(len(word) + 1))
    pairs = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) != _NONE:
        i = pairs.index(least)
        del bounds[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(word[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            pairs[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def _long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end = list(range(1, n + 1))  # of the part that begins here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of its parts has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts; words that came before are looked up."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.split = regex.compile(PATTERN).findall
        self.words: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        if whole is not None:
            ids = [whole]
        else:
            ids = _short(data, self.ranks) if len(data) <= LONG_WORD else _long(data, self.ranks)
        if len(self.words) >= _CACHE_WORDS:
            self.words.clear()
        if len(data) <= LONG_WORD:
            self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            known, extend = self.words.get, out.extend
            for w in self.split(text):
                extend(known(w) or self.word(w))
        return out

    def count(self, text: str | None) -> int:
        known = self.words.get
        return sum(len(known(w) or self.word(w)) for w in self.split(text)) if text else 0


_encoders: dict[int, Encoder] = {}


def encoder_of(vocabulary) -> Encoder:  # noqa: ANN001 - a Broadcast of the file's bytes
    """The encoder of a broadcast vocabulary file, made once in each Python worker."""
    data = vocabulary.value
    key = hash(data)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(read_ranks(data))
    return _encoders[key]


def vocabulary(spark: SparkSession, name: str = BYTE_BPE_50K, folder: str = VOCABULARIES):  # noqa: ANN201
    """The vocabulary file, broadcast; its size does not depend on the corpus, and a file above ``VOCABULARY_BYTES`` is refused."""
    file = Path(folder, name)
    if file.stat().st_size > VOCABULARY_BYTES:
        raise ValueError(f"{file} has more than {VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(file.read_bytes())


def encode(df: DataFrame, vocab, doc_id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: ANN001
    """(doc_id, ids): the token ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(vocab)
        for batch in batches:
            ids = pa.array([e.encode(x) for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")
