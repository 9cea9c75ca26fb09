import random
import re

import numpy as np
import pytest
import xxhash

from rankloom.llm import graph, simhash

from .conftest import made


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(ids, prints):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(zip(ids, prints, strict=True)):
        for b, y in list(zip(ids, prints, strict=True))[:i]:
            if bin(x ^ y).count("1") <= 4:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return [find(a) for a in ids]


def test_fingerprints():
    for t in [None, "", " \t", "one", "One two", "a b c d", "A b C d e É", "x " * 5000, "a\x1cb c\x85d e f", "w1 w2 w3 w1 w2 w3 w1 w2 w3"]:
        assert simhash.fingerprint(t) == brute(t), t


def test_every_close_pair_is_linked():
    rng = np.random.default_rng(0)
    seeds = rng.integers(0, 2**63, 150, dtype=np.uint64)
    near = [int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for s in seeds for _ in range(4)]
    fp = np.unique(np.array(near, np.uint64))
    rows, bucket, first = [], [], []
    for i in range(5):
        value = fp >> np.uint64(simhash.SHIFTS[i]) & np.uint64((1 << simhash.SEGMENTS[i]) - 1)
        rows.append(fp)
        bucket.append(value.astype(np.int64) + i * 10_000)
        first.append(np.full(len(fp), i))
    label = simhash.linked(*map(np.concatenate, (rows, bucket, first)))
    parent = {int(f): int(f) for f in fp}
    star = {}
    for f, r in zip(np.concatenate(rows), label, strict=True):
        star.setdefault(int(f), set()).add(int(r))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for f, roots in star.items():
        for r in roots:
            a, b = find(f), find(r)
            parent[max(a, b)] = min(a, b)
    want = groups([int(f) for f in fp], [int(f) for f in fp])
    assert [find(int(f)) for f in fp] == want


def near_rows(seed=1):
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(300)]
        for _ in range(rng.randrange(1, 9)):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(300)] = f"x{rng.randrange(99)}"
            rows.append((len(rows) * 7 % 101 + 200, " ".join(copy), "s"))
    return rows


@pytest.mark.parametrize("chunk", [1, 1024])
def test_components(spark, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rows = near_rows() + [(5, None, "s"), (6, "", "s"), (4, "  ", "s"), (900, "one word", "s"), (901, "one word", "s"), (901, "one word", "s")]
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.components(made(spark, rows)).collect())
    prints = [brute(t) for _, t, _ in rows]
    assert got == sorted(zip([i for i, _, _ in rows], prints, groups([i for i, _, _ in rows], prints), strict=True))


def near_brute(ids, texts):
    """Components of near copies: every pair held against the rule of the chain, one by one."""
    bits = [[int(x) for x in f"{int.from_bytes(simhash.wide_fingerprint(t), 'little'):0336b}"[::-1]] for t in texts]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def close(a, b):
        apart = [sum(x != y for x, y in zip(a[k * 12 : k * 12 + 12], b[k * 12 : k * 12 + 12], strict=True)) for k in range(28)]
        chains = ([*apart[k:], *apart[:k]] for k in range(28) if not apart[k])
        return sum(apart) <= 60 and any(all(sum(c[:n]) <= 60 * n // 28 for n in (5, 10, 15, 20, 25)) for c in chains)

    for i, a in enumerate(bits):
        for j in range(i):
            if close(a, bits[j]):
                p, q = find(ids[i]), find(ids[j])
                parent[max(p, q)] = min(p, q)
    return [find(i) for i in ids]


@pytest.mark.parametrize("chunk", [4, 64])
def test_hot_segments_lose_no_link(spark, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    same = lambda first, count: ~np.uint64(simhash.mask(first, count))
    # half of them agree in the last segment, a part of these in the first one too: the ring closes there
    seeds = [int(x & same(4, 1 + (i % 4 == 0)) if i % 2 == 0 else x) for i, x in enumerate(rng.integers(0, 2**64, 90, dtype=np.uint64))]
    near = {s ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for s in seeds for _ in range(5)}
    fp = sorted(near)
    rows = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fp], "fp long")
    parent = {x: x for x in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in simhash.links(rows).collect():
        p, q = find(int(np.int64(a).view(np.uint64))), find(int(np.int64(b).view(np.uint64)))
        parent[max(p, q)] = min(p, q)
    assert [find(x) for x in fp] == groups(fp, fp)


def test_wide_fingerprint():
    assert simhash.wide_fingerprint(None) == simhash.wide_fingerprint(" \t") == bytes(42)
    assert simhash.wide_fingerprint("A b c d e f") == simhash.wide_fingerprint("a B\nc d e f")
    once = " ".join(f"w{i}" for i in range(20_000))
    assert simhash.wide_fingerprint(f"{once} {once}") != simhash.wide_fingerprint(once[:50_000])  # all of a long text counts
    bits = np.unpackbits(np.frombuffer(simhash.wide_fingerprint(once), np.uint8))
    assert 120 < bits.sum() < 216


@pytest.mark.parametrize("chunk,small", [(1, 64), (16_384, 0), (16_384, 64)])
def test_near_components(spark, chunk, small, monkeypatch):
    monkeypatch.setattr(simhash, "NEAR_CHUNK", chunk)
    monkeypatch.setattr(simhash, "NEAR_SMALL", small)
    rows = near_rows() + [(5, None, "s"), (6, "", "s"), (4, "  ", "s"), (900, "one word", "s"), (901, "one word", "s"), (901, "one word", "s")]
    got = {r.doc_id: r.component_id for r in simhash.near_components(made(spark, rows)).collect()}
    every = {i: t for i, t, _ in rows}
    assert got == dict(zip(every, near_brute(list(every), list(every.values())), strict=True))


def test_hot_buckets_lose_no_link():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2, (3, 336), dtype=np.uint8)
    bits = np.concatenate([s[None, :] ^ (rng.random((n, 336)) < rate) for s, n, rate in zip(seeds, (300, 90, 40), (0.06, 0.085, 0.12), strict=True)] + [rng.integers(0, 2, (120, 336), dtype=np.uint8)])
    bits[:, :12] = seeds[0, :12]
    bits = bits.astype(np.uint8).reshape(-1, 28, 12)
    ring, bucket = simhash.ring_from(bits, 0), np.zeros(len(bits), np.int64)
    want = np.arange(len(bits))
    a, b = np.triu_indices(len(bits), 1)
    kept = simhash.near_pairs(a, b, ring)
    apart = (bits[a] != bits[b]).sum(axis=2)
    assert np.array_equal(kept, np.flatnonzero(np.all([apart[:, :n].sum(axis=1) <= 60 * n // 28 for n in (5, 10, 15, 20, 25, 28)], axis=0)))
    simhash.joined(want, a[kept], b[kept])
    assert np.array_equal(simhash.near_linked(ring, bucket), want) and len(np.unique(want)) < 200


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    rows, copies = [], set()
    for g in range(60):
        words = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(100, 600))]
        rows.append((g, " ".join(words), "s"))
        for c in range(g % 3):
            copy = list(words)
            for at in range(0, len(copy), 80):  # a word in 80: similarity about 0.88
                copy[at] = "changed"
            copies.add(1000 + 10 * g + c)
            rows.append((1000 + 10 * g + c, " ".join(copy) + " end" * c, "s"))
    kept = {r.doc_id for r in simhash.one_of_each(made(spark, rows)).collect()}
    assert set(range(60)) <= kept and len(kept & copies) <= 1


def test_one_of_each(spark, odd, none):
    more = odd.unionByName(made(spark, [(None, "another without an id", "s"), (None, "another without an id", "s")]))
    kept = simhash.one_of_each(more)
    ids = [r.doc_id for r in kept.collect()]
    every = [r.component_id for r in simhash.near_components(odd).collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i in every if i is not None}) and kept.columns == odd.columns
    assert ids.count(None) == 2
    assert simhash.one_of_each(none).count() == 0 and simhash.components(none).count() == 0 and simhash.near_components(none).count() == 0


def test_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in graph.star_roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}}


def jaccard_groups(rows):
    """Components by the exact similarity of the sets of five-word shingles, every pair counted."""
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                p, q = find(a), find(rows[j][0])
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i, _, _ in rows}


def pairs_about(seed, lows):
    """Two texts a seed, of 600 words, the second with some runs of words exchanged: similarities on both sides of 0.8."""
    rng = random.Random(seed)
    rows = []
    for g in range(len(lows)):
        words = [f"p{g}w{rng.randrange(10**6)}" for _ in range(600)]
        other = list(words)
        for at in range(0, 600, 600 // lows[g]):
            other[at] = f"y{g}x{at}"
        rows += [(10 * g + 1, " ".join(words), "s"), (10 * g + 2, " ".join(other), "s")]
    return rows


@pytest.mark.parametrize("chunk,small", [(20, 64), (16_384, 0), (16_384, 64)])
def test_links_are_those_of_exact_similarity(spark, chunk, small, monkeypatch):
    monkeypatch.setattr(simhash, "NEAR_CHUNK", chunk)
    monkeypatch.setattr(simhash, "NEAR_SMALL", small)
    rows = pairs_about(8, [12, 13, 14, 15, 16, 17, 18, 20] * 12) + [(5000, "", "s"), (5001, None, "s"), (5002, "a b", "s")]
    got = {r.doc_id: r.component_id for r in simhash.near_components(made(spark, rows)).collect()}
    want = jaccard_groups(rows)
    assert got == want and 20 < len(set(want.values())) - len(rows) // 2 < 80


def hot_rows():
    """A third of the texts copies of one another, some too far from the others' pivot, a chain of copies beyond them, and texts apart."""
    rng = random.Random(11)
    base = [f"h{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(400), rng.randrange(1, 14)):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words), "s"))
    words = list(base)
    for i in range(200, 240):
        for at in rng.sample(range(400), 4):
            words[at] = f"c{i}x{at}"
        rows.append((i, " ".join(words), "s"))
    return rows + [(20_000 + i, t, s) for i, t, s in pairs_about(9, [12, 14, 16, 17, 18, 20] * 8)] + [(9000 + i, " ".join(f"o{rng.randrange(10**6)}" for _ in range(60)), "s") for i in range(100)]


@pytest.mark.parametrize("chunk", [4])
def test_hot_copies_lose_no_link_and_stay_few(spark, chunk, monkeypatch):
    """Components are the same however small a chunk is; rows linked with a bucket's pivot are sent once for each chunk of the rest."""
    monkeypatch.setattr(simhash, "NEAR_SMALL", 0)
    rows = hot_rows()
    whole = {r.doc_id: r.component_id for r in simhash.near_components(made(spark, rows)).collect()}
    sent, dealt = [], simhash._dealt
    monkeypatch.setattr(simhash, "NEAR_CHUNK", chunk)
    monkeypatch.setattr(simhash, "_dealt", lambda r, hot, usual: sent.append((r.join(hot.select("first", "value"), ["first", "value"], "left_semi").count(), dealt(r, hot, usual).join(hot.select("first", "value"), ["first", "value"], "left_semi").count(), hot.count())) or dealt(r, hot, usual))
    assert {r.doc_id: r.component_id for r in simhash.near_components(made(spark, rows)).collect()} == whole == jaccard_groups(rows)
    ((before, after, hot),) = sent
    assert hot >= 40 and after < before * 12


def test_candidates_need_no_chain():
    """Pairs that agree in the first segment are found by the full distance, wherever their differences stand."""
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2, (200, 28, 12), dtype=np.uint8)
    bits[1::2] = bits[::2]
    for i in range(1, 200, 2):
        bits[i, 1:6] ^= (rng.permutation(60) < 20).astype(np.uint8).reshape(5, 12)  # more than the chain allows of five segments
        bits[i, 6:] ^= (rng.permutation(264) < 35).astype(np.uint8).reshape(22, 12)
    label = simhash.near_linked(simhash.ring_from(bits, 0), np.repeat(np.arange(100), 2), simhash.NEAR_REACH, lambda i, j: True)
    assert np.array_equal(label, np.repeat(np.arange(0, 200, 2), 2))


def test_nearly_every_pair_at_the_limit_agrees_in_a_segment():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2, (20_000, 28, 12), dtype=np.uint8)
    b = a ^ (rng.random(a.shape) < 0.1515)
    hit = (simhash.ring_values(a) == simhash.ring_values(b.astype(np.uint8))).any(axis=1) & ((a != b).sum(axis=(1, 2)) <= simhash.NEAR_REACH)
    assert hit.mean() > 0.998


@pytest.mark.parametrize("n", [4, 5, 6, 8, 10, 12, 16, 20, 40])
def test_short_texts_at_the_limit_are_candidates(n):
    """Of texts of few shingles, the pairs that differ as much as 0.8 allows."""
    rng, a, b = np.random.default_rng(n), [], []
    fits = [(both, x, n - both) for both in range(1, n + 1) for x in range(n) if 5 * both >= 4 * (n + x)]
    fits = [f for f in fits if f[1] + f[2] == max(x + y for _, x, y in fits)]
    for i in range(1000):
        both, x, y = fits[i % len(fits)]
        h = rng.integers(0, 2**63, both + x + y).astype(np.uint64)
        a.append(simhash.wide_bits(np.sort(h[: both + x])))
        b.append(simhash.wide_bits(np.sort(np.concatenate([h[:both], h[both + x :]]))))
    a, b = simhash.segments_of(a), simhash.segments_of(b)
    hit = (simhash.ring_values(a) == simhash.ring_values(b)).any(axis=1) & ((a != b).sum(axis=(1, 2)) <= simhash.NEAR_REACH)
    assert hit.mean() >= (0.98 if n < 6 else 0.99)


def test_an_id_on_unlike_rows_keeps_each_text(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a, "s"), (1, b, "s"), (2, b, "s"), (3, a + " more", "s"), (3, c, "s"), (3, c, "t"), (4, None, "s"), (4, "", "s")]
    for part in (rows, rows[:3], rows[::-1]):
        got = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(made(spark, part)).collect()), key=str)
        want = [(1, a), (1, b)] if len(part) == 3 else [(1, a), (1, b), (3, c), (4, got[-1][1])]
        assert got == sorted(want, key=str) and (len(part) == 3 or not got[-1][1])


def test_rows_without_an_id_stand_for_nothing(spark):
    a = " ".join(f"a{i}" for i in range(60))
    got = simhash.one_of_each(made(spark, [(None, a, "s"), (None, a, "s"), (5, a + " x", "s"), (6, a + " y", "s")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, a), (5, a + " x")]


def test_long_and_short_sets_are_compared_by_whole_hashes():
    """Hashes that agree in one half alone are no common shingles, however many or few a text has."""
    for n in (8, 9000):
        low = np.arange(n, dtype=np.uint64)
        assert not simhash.alike(low << np.uint64(32), (low << np.uint64(32)) + np.uint64(1))
        assert simhash.alike(low << np.uint64(32), low << np.uint64(32))
