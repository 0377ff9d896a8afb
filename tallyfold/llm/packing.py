"""Filling fixed-capacity containers with texts measured in tokens.

A text longer than the capacity is cut into pieces of exactly the capacity and a rest; no
other text is split. Items are dealt at random (by hash) to groups of bounded size, each
packed on its own by best fit in order of falling size: open containers are kept in the order
of their residuals, and the search starts at the tightest one that has room and goes on from
successor to successor until one is compatible, which is one that holds no text of the same
source and none of the same cluster of copies (each container carries a bitmap of its sources
and one of its clusters). A cluster is of texts that are equal but for case, white space and
punctuation, and of texts whose sets of five-word shingles are similar by 0.8 or more, as
estimated from 32 minima of hashes (two texts at 0.8 meet in one of eight bands in 98 of 100
cases; texts of fewer than five words have no shingles). Only copies that are dealt to one
group can meet in a container, so clusters are formed within groups. Where no compatible container has room, and as many containers are open as the items need at least, the
constraint on the source and then that on copies gives way, so that a source or a text
that makes up a third of a corpus does not leave the containers half empty.

Defined cases: null and empty texts take no room and are one piece of 0 tokens each, placed
like any other; a piece that fills a container needs no search; equal sizes are taken in order of doc_id and piece;
rows with the same doc_id are items of their own; an empty table gives no container.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.bpe import encoder_of

CAPACITY = 2048
#: Items of one group at most about this many; what a group leaves unused is at most some one container.
GROUP_ITEMS = 16_384

PLACED = (
    "container_id string, place int, doc_id bigint, piece int, token_start int, n_tokens int, "
    "container_start int, container_tokens int, same_source boolean, same_text boolean"
)


class Bins:
    """Open containers in the order of their residuals, each with a bitmap of its sources and one of its clusters.

    The order is kept in blocks; what the bitmaps of a whole block have in common is kept as
    well, so that a search for a compatible container passes over a block in which none is.
    """

    BLOCK = 64

    def __init__(self) -> None:
        self.blocks: list[list[tuple[int, int]]] = []  # (residual, container), ascending
        self.last: list[tuple[int, int]] = []  # greatest entry of each block
        self.common: list[tuple[int, int] | None] = []  # bits that all containers of a block have; None when not up to date
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def find(self, size: int, source: int, cluster: int) -> tuple[int, int] | None:
        """Block and place in it of the tightest container with room for ``size`` that has none of the given bits."""
        b = bisect_left(self.last, (size, -1))
        at = bisect_left(self.blocks[b], (size, -1)) if b < len(self.blocks) else 0
        while b < len(self.blocks):
            block = self.blocks[b]
            if self.common[b] is None:
                both_s = both_c = -1
                for _, k in block:
                    both_s &= self.sources[k]
                    both_c &= self.clusters[k]
                self.common[b] = both_s, both_c
            if not (self.common[b][0] & source or self.common[b][1] & cluster):
                for i in range(at, len(block)):
                    k = block[i][1]
                    if not (self.sources[k] & source or self.clusters[k] & cluster):
                        return b, i
            b, at = b + 1, 0
        return None

    def take(self, place: tuple[int, int]) -> tuple[int, int]:
        """Take a container out of the order: (residual, container)."""
        b, i = place
        entry = self.blocks[b].pop(i)
        if self.blocks[b]:
            self.last[b], self.common[b] = self.blocks[b][-1], None
        else:
            del self.blocks[b], self.last[b], self.common[b]
        return entry

    def put(self, room: int, k: int) -> None:
        """Set a container where its residual belongs."""
        entry = (room, k)
        if not self.blocks:
            self.blocks, self.last, self.common = [[entry]], [entry], [None]
            return
        b = min(bisect_left(self.last, entry), len(self.blocks) - 1)
        block = self.blocks[b]
        insort(block, entry)
        if len(block) > 2 * self.BLOCK:
            self.blocks[b : b + 1] = [block[: self.BLOCK], block[self.BLOCK :]]
            self.last[b : b + 1] = [block[self.BLOCK - 1], block[-1]]
            self.common[b : b + 1] = [None, None]
        else:
            self.last[b], self.common[b] = block[-1], None


def _bits(groups: np.ndarray) -> list[int]:
    """One bit for each number that stands more than once; what stands once can meet nothing equal."""
    counts = np.bincount(groups, minlength=1)
    bit = {int(g): 1 << n for n, g in enumerate(np.flatnonzero(counts > 1))}
    return [bit.get(g, 0) for g in groups.tolist()]


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(container, same_source, same_text) of each item, in the given order.

    sources, clusters: small integers; equal numbers must not meet in a container as long
    as that costs no container.
    """
    where, bent = np.zeros(len(sizes), np.int64), np.zeros((2, len(sizes)), bool)
    least = int(-(-int(sizes.sum()) // capacity))
    bins = Bins()
    for n, (size, s, c) in enumerate(zip(sizes.tolist(), _bits(sources), _bits(clusters))):
        place = bins.find(size, s, c)
        if place is None and len(bins.sources) >= least:
            place = bins.find(size, 0, c) or bins.find(size, 0, 0)
        if place is None:
            room, k = capacity, len(bins.sources)
            bins.sources.append(0)
            bins.clusters.append(0)
        else:
            room, k = bins.take(place)
        bent[0, n], bent[1, n] = bins.sources[k] & s, bins.clusters[k] & c
        bins.sources[k] |= s
        bins.clusters[k] |= c
        bins.put(room - size, k)
        where[n] = k
    return where, bent[0], bent[1]


def copies(text: Column) -> Column:
    """Hash of what copies have in common: letters and figures in the same order; a text without any stands for itself."""
    text = F.coalesce(text, F.lit(""))
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    return F.xxhash64(F.when(kept == "", text).otherwise(kept))


#: Minima of hashes that describe a text, in bands of four, and the share of equal ones from which two texts are near copies.
MINIMA, BAND, WORDS, SIMILAR = 32, 4, 5, 0.8
_random = np.random.default_rng(20_000)
_FACTORS = _random.integers(1, 1 << 63, MINIMA, np.uint64) | np.uint64(1)
_PLACES = _random.integers(1, 1 << 63, WORDS, np.uint64) | np.uint64(1)


def signature(text: str | None) -> bytes | None:
    """The least hashes of the shingles of a text under ``MINIMA`` orders; None for a text of fewer than five words."""
    words = text.split() if text else []
    if len(words) < WORDS:
        return None
    w = np.fromiter(map(zlib.crc32, [x.encode("utf-8", "surrogatepass") for x in words]), np.uint64, len(words))
    n = len(words) - WORDS + 1
    with np.errstate(over="ignore"):
        shingles = w[:n] * _PLACES[0]
        for k in range(1, WORDS):
            shingles = (shingles ^ (shingles >> np.uint64(29))) * _PLACES[k] + w[k : k + n]
        shingles ^= shingles >> np.uint64(32)
        least = np.full(MINIMA, (1 << 32) - 1, np.uint64)
        for at in range(0, n, 4_096):  # a very long text in parts
            least = np.minimum(least, ((shingles[at : at + 4_096, None] * _FACTORS) >> np.uint64(32)).min(axis=0))
    return least.astype(np.uint32).tobytes()


def clusters(hashes: np.ndarray, signatures: list[bytes | None]) -> np.ndarray:
    """Number of the cluster of each text of a group: equal hashes, and near copies by their signatures, directly or through others."""
    _, first, cluster = np.unique(hashes, return_index=True, return_inverse=True)
    up = np.arange(len(first))

    def top(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    known = np.array([k for k, i in enumerate(first) if signatures[i] is not None], int)
    if len(known):
        matrix = np.frombuffer(b"".join(signatures[first[k]] for k in known), np.uint32).reshape(-1, MINIMA)
        for b in range(0, MINIMA, BAND):
            band = np.ascontiguousarray(matrix[:, b : b + BAND]).view(f"V{4 * BAND}").ravel()
            order = np.argsort(band, kind="stable")
            same = np.flatnonzero(np.r_[True, band[order][1:] != band[order][:-1], True])
            for lo, hi in zip(same[:-1], same[1:]):
                rest = order[lo:hi]
                while len(rest) > 1:  # those near to the first one, then those near to the first of the others
                    near = (matrix[rest] == matrix[rest[0]]).mean(axis=1) >= SIMILAR
                    for k in rest[near]:
                        up[top(known[k])] = top(known[rest[0]])
                    rest = rest[~near]
    return np.array([top(c) for c in range(len(first))], int)[cluster] if len(first) else cluster


def pieces(df: DataFrame, vocab, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:  # noqa: ANN001
    """(doc_id, piece, token_start, n_tokens, source, text_hash, signature): what is to be placed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(vocab)
        for batch in batches:
            rows = []
            for doc, x, src, h in zip(*(batch.column(i).to_pylist() for i in range(4))):
                total, sig = e.count(x), signature(x)
                for piece, start in enumerate(range(0, max(total, 1), capacity)):
                    rows.append((doc, piece, start, min(capacity, total - start), src, h, sig))
            columns = list(zip(*rows)) if rows else [[]] * 7
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "token_start", "n_tokens", "source", "text_hash", "signature"])

    picked = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"), copies(F.col(text)).alias("text_hash"))
    return picked.mapInArrow(run, "doc_id bigint, piece int, token_start int, n_tokens int, source string, text_hash bigint, signature binary")


def pack(items: DataFrame, rows: int, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Containers of the pieces; ``rows``, about how many there are, sets the number of groups."""
    groups = max(1, -(-rows // group_items))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece", "token_start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        sizes = pdf["n_tokens"].to_numpy(np.int64)
        full = int((sizes == capacity).sum())  # they come first, each its own container
        where, same_source, same_text = np.arange(len(sizes)), np.zeros(len(sizes), bool), np.zeros(len(sizes), bool)
        rest = pdf.iloc[full:]
        found = best_fit(sizes[full:], pd.factorize(rest["source"], use_na_sentinel=False)[0], pd.factorize(clusters(rest["text_hash"].to_numpy(), rest["signature"].tolist()))[0], capacity)
        where[full:], same_source[full:], same_text[full:] = found[0] + full, found[1], found[2]
        order = np.argsort(where, kind="stable")
        out = pdf.loc[order, ["doc_id", "piece", "token_start", "n_tokens"]]
        w = where[order]
        out["same_source"], out["same_text"] = same_source[order], same_text[order]
        by = out.groupby(w, sort=False)["n_tokens"]
        out["place"] = by.cumcount().to_numpy(np.int32) + 1
        out["container_start"] = (by.cumsum() - out["n_tokens"]).to_numpy(np.int32)
        out["container_tokens"] = by.transform("sum").to_numpy(np.int32)
        out["container_id"] = [f"{pdf['grp'].iat[0]}-{x}" for x in w]
        return out[[c.split()[0] for c in PLACED.split(", ")]]

    grouped = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "text_hash"), F.lit(groups)).cast("int"))
    return grouped.groupBy("grp").applyInPandas(run, PLACED)


def summary(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused share, and how often the constraints gave way."""
    tokens = F.sum("n_tokens")
    containers = F.count_distinct("container_id")
    return placed.agg(
        containers.alias("containers"), F.count(F.lit(1)).alias("pieces"), tokens.alias("tokens"), F.round(1 - tokens / (containers * capacity), 6).alias("unused"),
        F.count_if("same_source").alias("same_source"), F.count_if("same_text").alias("same_text"),
    )
