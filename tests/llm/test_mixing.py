import re
from collections import Counter

import pytest

from rankloom.llm import mixing

from .conftest import made


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def by_rounds(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """The contract as it reads: what exceeds a cap is shared out again, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > cap * sizes[s]}
        if not over:
            return target | part
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, None: 50}, {"a": 0, "b": 5}, {"x": 7}, {}, {"é": 3, "z": 900, "a": 40, "Z": 40, None: 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([("-" if s is None else f"+{s}", n) for s, n in sizes.items()], "key string, source_size long")
    got = {None if r.key == "-" else r.key[1:]: r.target for r in mixing.targets(rows).collect()}
    want = by_rounds(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in got)


def test_report(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text", "source").collect()]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want = by_rounds(sizes)
    got = mixing.mix_report(odd).collect()
    source = {i: s for i, _, s in rows}
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), words(t)) for i, t, _ in rows)
    taken, largest = Counter(), Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2 and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(odd.repartition(7)).collect()))
    assert mixing.mix_report(none).count() == 0


def test_mixed_repeats_documents(spark, odd, none):
    copies = Counter()
    for r in mixing.mix_report(odd).collect():
        copies[r.doc_id] += r.copies
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and mixing.mixed(none).count() == 0
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter({i: n for i, n in copies.items() if n})


def test_equal_sizes_split_over_parts(spark):
    docs = made(spark, [(i, "a b c", "s") for i in range(500)] + [(1000 + i, "a b c", "t") for i in range(100)])
    got = mixing.mix_report(docs).collect()
    for first, n in ((0, 500), (1000, 100)):
        part = [r for r in got if first <= r.doc_id < first + 900]
        assert len(part) == n and abs(sum(r.taken for r in part) - part[0].target) <= 3
