import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.llm import bpe, packing

FILE = Path(bpe.VOCABULARIES, bpe.BYTE_BPE_50K)
pytestmark = pytest.mark.skipif(not FILE.exists(), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(FILE.read_bytes()))


@pytest.fixture(scope="module")
def library(encoder):
    import tiktoken

    public = pytest.importorskip("public_tokenizers")
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs", "Cn"], max_codepoint=0x2FFF), st.sampled_from(" \n\t'’\x1c\x85\xa0​é中👍0a")), max_size=60))
def test_equals_library(encoder, library, text):
    assert encoder.encode(text) == library.encode_ordinary(text)


def test_long_words_and_special_strings(encoder, library):
    r = random.Random(2)
    for n in (1, 255, 256, 257, 3000):
        word = "".join(r.choice("etaoinshr") for _ in range(n))
        assert encoder.encode(word) == library.encode_ordinary(word)
        assert bpe._long(word.encode(), encoder.ranks) == bpe._short(word.encode(), encoder.ranks) or word.encode() in encoder.ranks
    assert encoder.encode("<|endoftext|>") == library.encode_ordinary("<|endoftext|>") != [50256]
    assert encoder.encode(None) == encoder.encode("") == [] and encoder.count(None) == 0


def test_query_over_nulls_and_repeats(spark, encoder):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "a  b", 9), (3, "a  b", 9)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode(df, bpe.vocabulary(spark)).collect())
    assert got == [(1, []), (2, []), (3, encoder.encode("a  b")), (3, encoder.encode("a  b"))]
    assert bpe.encode(df.limit(0), bpe.vocabulary(spark)).count() == 0


def check(sizes, where, capacity):
    loads = np.bincount(where, weights=sizes)
    assert (loads <= capacity).all()
    return len(loads)


def plain_best_fit(sizes, sources, clusters, capacity):
    """The definition: of all open containers with room, the tightest compatible one, by a scan of them all."""
    room, held, where = [], [], []
    least = -(-sum(sizes) // capacity)
    for size, s, c in zip(sizes, sources, clusters):
        fits = sorted((r, k) for k, r in enumerate(room) if r >= size)
        free = [k for _, k in fits if all(s != x and c != y for x, y in held[k])]
        apart = [k for _, k in fits if all(c != y for _, y in held[k])]
        if not free and len(room) >= least:
            free = apart or [k for _, k in fits]
        if not free:
            room.append(capacity), held.append([])
            free = [len(room) - 1]
        k = free[0]
        room[k] -= size
        held[k].append((s, c))
        where.append(k)
    return where


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 6), st.integers(0, 9)), min_size=1, max_size=80), st.integers(1, 3))
def test_best_fit_takes_the_tightest_compatible_container(items, block):
    items.sort(key=lambda x: -x[0])
    sizes, sources, clusters = (np.array(c) for c in zip(*items))
    packing.Bins.BLOCK, was = block, packing.Bins.BLOCK
    try:
        where, same_source, same_text = packing.best_fit(sizes, sources, clusters, 100)
    finally:
        packing.Bins.BLOCK = was
    assert where.tolist() == plain_best_fit(sizes.tolist(), sources.tolist(), clusters.tolist(), 100)
    check(sizes, where, 100)
    for groups, same in ((sources, same_source), (clusters, same_text)):
        for g in set(groups):
            places = where[groups == g]
            assert len(places) - len(set(places)) == same[groups == g].sum()


def test_a_group_of_many_sources_is_small_and_quick():
    import time
    import tracemalloc

    r = np.random.default_rng(1)
    sizes = np.sort(r.integers(1, 400, 16_384))[::-1]
    hot = np.where(r.random(16_384) < 0.4, 0, np.arange(16_384) // 2)  # a source with two fifths of the items, the others in pairs
    for sources in (np.arange(16_384), np.arange(16_384) // 2, hot):
        tracemalloc.start()
        began = time.perf_counter()
        where, _, _ = packing.best_fit(sizes, sources, np.arange(16_384) // 2, 2048)
        assert tracemalloc.get_traced_memory()[1] < 100e6 and time.perf_counter() - began < 60
        tracemalloc.stop()
        assert check(sizes, where, 2048) <= -(-int(sizes.sum()) // 2048) * 1.002 + 2


def test_near_copies_are_one_cluster():
    import random

    r = random.Random(4)
    vocabulary = [f"w{n}" for n in range(3000)]
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    similarity = lambda a, b: len(sets(a) & sets(b)) / len(sets(a) | sets(b))
    texts = []
    for _ in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randrange(60, 300))]
        texts.append(" ".join(words))
        near = words[:]
        near[r.randrange(len(near))] = "changed"  # five shingles
        texts.append(" ".join(near))
        far = words[:]
        for k in range(0, len(far), 7):
            far[k] = "other"
        texts.append(" ".join(far))
    hashes = np.arange(len(texts))
    got = packing.clusters(hashes, [packing.signature(x) for x in texts])
    close = [(similarity(texts[k], texts[k + 1]), got[k] == got[k + 1]) for k in range(0, len(texts), 3)]
    assert sum(same for s, same in close if s >= 0.85) >= 0.95 * sum(s >= 0.85 for s, _ in close)
    assert all(got[k] != got[k + 2] for k in range(0, len(texts), 3)) and len(set(got)) <= 2 * 60 + 6
    assert packing.signature(None) is None and packing.signature("a b c d") is None and packing.signature("a b c d e") == packing.signature("a  b c\nd e")
    assert len(packing.signature("word " * 100_000)) == 4 * packing.MINIMA
    equal = packing.clusters(np.array([5, 5, 7]), [None, None, None])
    assert equal[0] == equal[1] != equal[2] and packing.clusters(np.array([], int), []).size == 0


def test_containers(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(i, f"text number {i} " * (i % 40), f"s{i % 3}") for i in range(300)] + [(1000 + i, "the same text again and again", "hot") for i in range(150)] + [(5000, long, None), (5001, None, "x"), (5002, "", "x"), (5002, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    vocab = bpe.vocabulary(spark)
    placed = packing.pack(packing.pieces(df, vocab), 454, group_items=128)
    e = bpe.Encoder(bpe.read_ranks(FILE.read_bytes()))
    got = placed.collect()
    total = sum(e.count(t) for _, t, _ in rows)
    assert sum(r["n_tokens"] for r in got) == total
    by = {}
    for r in got:
        by.setdefault(r["container_id"], []).append(r)
    for pieces in by.values():
        pieces.sort(key=lambda r: r["place"])
        at = 0
        for k, r in enumerate(pieces, 1):
            assert r["place"] == k and r["container_start"] == at
            at += r["n_tokens"]
        assert at == pieces[0]["container_tokens"] <= packing.CAPACITY
    split = [r for r in got if r["doc_id"] == 5000]
    assert sorted(r["n_tokens"] for r in split)[1:] == [2048] * (len(split) - 1) and len(split) == -(-e.count(long) // 2048)
    assert len([r for r in got if r["doc_id"] in (5001, 5002)]) == 3
    s = packing.summary(placed).first()
    assert s["containers"] == len(by) and s["containers"] <= -(-s["tokens"] // packing.CAPACITY) + 8  # one that is not full for each of its groups
    assert packing.pack(packing.pieces(df.limit(0), vocab), 0).count() == 0
    assert packing.summary(placed.where(F.lit(False))).first()["containers"] == 0
