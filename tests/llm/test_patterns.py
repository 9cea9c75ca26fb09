import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest
from tokenizers import Tokenizer

from rankloom.llm import packing, patterns

from .conftest import odd_rows


def test_patterns_are_all_that_fill():
    for classes in (1, 2, 7, 12):
        for depth in (1, 2, 3, 4):
            want = {tuple(sorted(p, reverse=True)) for k in range(1, depth + 1) for p in combinations_with_replacement(range(1, classes + 1), k) if sum(p) == classes}
            found = patterns.patterns(classes, depth)
            assert set(found) == want and len(found) == len(want)


def test_non_negative_least_squares_meets_its_conditions():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.standard_normal((12, rng.integers(1, 30))), rng.standard_normal(12)
        x = patterns.non_negative(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient <= 1e-6).all() and np.abs(gradient[x > 0]).max(initial=0) < 1e-6
    a = np.abs(rng.standard_normal((9, 5)))
    want = np.array([0, 2, 0, 1, 3.0])
    assert np.allclose(patterns.non_negative(a, a @ want), want)


@pytest.mark.parametrize("capacity", [7, 64, 4096])
def test_every_piece_is_packed_once(capacity):
    rng = random.Random(capacity)
    for round_ in range(20):
        counts = Counter(rng.randrange(1, capacity) for _ in range(rng.choice([0, 1, 5, 200])))
        if counts and round_ % 3 == 0:
            counts[rng.choice(list(counts))] += 10**9  # a hot length
        used = patterns.repeats(counts, capacity)
        groups, packed = patterns.filled(counts, capacity, used), Counter()
        for lengths, times in groups:
            assert sum(n * k for n, k in lengths.items()) <= capacity and times >= 1
            for n, k in lengths.items():
                packed[n] += k * times
        assert packed == counts
        plan = patterns.plan_of(groups, 3)
        assert len(plan) == sum(len(g) for g, _ in groups)


def test_patterns_find_a_full_packing():
    """Lengths that fill sequences by threes only: longest first takes pairs that leave room for nothing."""
    counts = {1600: 4000, 1408: 4000, 1088: 4000}
    used = patterns.repeats(counts, 4096)
    assert sum(t for _, t in patterns.filled(counts, 4096, used)) == 4000 < sum(t for _, t in patterns.filled(counts, 4096, []))


def test_few_sequences():
    rng = random.Random(9)
    for mean, spread in ((6, 1.0), (7.2, 0.6), (5, 0.5)):
        counts = Counter(min(4095, int(rng.lognormvariate(mean, spread)) + 1) for _ in range(20_000))
        least = -(-sum(n * c for n, c in counts.items()) // 4096)
        assert sum(t for _, t in patterns.filled(counts, 4096, patterns.repeats(counts, 4096))) <= 1.006 * least


def _checked(rows, got, capacity):
    vocabulary = Tokenizer.from_file(packing.tokenizer_file())
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*vocabulary.encode(text or "", add_special_tokens=False).ids, patterns.END_ID], "<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[doc_id, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pieces_and_places(spark, odd, none, monkeypatch):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert len(rows) == len(odd_rows())
    monkeypatch.setattr(patterns, "NUMBERED", 2)  # lengths numbered in parts
    for capacity in (64, 4096):
        got = patterns.pack(odd, capacity=capacity).collect()
        tokens = sum(r.length for r in got)
        assert _checked(rows, got, capacity) <= 1.1 * tokens / capacity + 1
    assert patterns.pack(none).count() == 0
    assert sorted(tuple(r)[:5] for r in patterns.pack(odd).fillna(-1).collect()) == sorted(tuple(r)[:5] for r in patterns.pack(odd.repartition(7)).fillna(-1).collect())


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = patterns.pack(docs).collect()
    assert _checked(rows, got, 4096) <= -(-sum(r.length for r in got) // 4096) + 1
