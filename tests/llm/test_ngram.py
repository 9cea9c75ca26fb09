import math
import zlib
from collections import Counter

import numpy as np
import pytest

from rankloom.llm import ngram


def words(text):
    return [*(text or "").encode().lower().split(), "</s>"]


def model(texts, order):
    """Plain dictionaries: (counts, tokens, base, probability of a word after the two before it)."""
    rows = [words(t) for t in texts]
    c = Counter(w for r in rows for w in r)
    grams = Counter(tuple((["<s>"] * (order - 1) + r)[i : i + order]) for r in rows for i in range(len(r)))
    levels = [grams]  # the highest order's counts, then continuation counts: distinct words before
    while len(next(iter(levels[-1]), "x")) > 1:
        levels.append(Counter(g[1:] for g in levels[-1]))
    cuts, sums, free = [], [], []
    for level in levels:
        of = Counter(level.values())
        cuts.append((0, *ngram.discounts(*(of[i] for i in (1, 2, 3, 4)))))
        sums.append(Counter())
        free.append(Counter())
        for g, n in level.items():
            sums[-1][g[:-1]] += n
            free[-1][g[:-1]] += cuts[-1][min(n, 3)]
    total, kinds = sum(c.values()), len(c)

    def share(context, w, at=0):
        if at == order:
            return 1 / (kinds + 1)
        own = tuple(context[at:])
        if not sums[at][own]:
            return share(context, w, at + 1)
        n = levels[at][*own, w]
        return max(n - cuts[at][min(n, 3)], 0) / sums[at][own] + free[at][own] / sums[at][own] * share(context, w, at + 1)

    return c, total, lambda w: (c[w] + 0.5) / (total + 0.5 * (kinds + 1)), share


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize(("order", "slice_", "flush"), [(2, 2_000_000, 1 << 20), (3, 2_000_000, 1 << 20), (3, 2_000, 1_000), (3, 100, 64)])
def test_equals_dictionaries(spark, odd, none, order, slice_, flush):
    """Also with many slices, hot middle words, and texts that run over several pieces."""
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    if slice_ < 2000:
        rows = [(i, t) for i, t in rows if len(t or "") < 10_000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    c, total, base, share = model([t for i, t in rows if not held(i)], order)
    trained = ngram.train(docs.where("doc_id is null or crc32(cast(doc_id as string)) % 5 <> 1"), order, slice_, flush)
    assert slice_ > 100 or len(trained.hot) > 3
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8), round(r.score, 8)) for r in ngram.scored(docs, trained).collect())
    want = []
    for i, t in rows:
        w = words(t)
        padded = ["<s>"] * (order - 1) + w
        scores = [share(padded[k : k + order - 1], x) for k, x in enumerate(w)]
        want.append((str(i), len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10(base(x)) for x in w), 8), round(sum(map(math.log10, scores)), 8)))
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want)]
    assert all(abs(g[k] - w[k]) <= 1e-9 * abs(w[k]) + 1e-7 for g, w in zip(got, sorted(want), strict=True) for k in (4, 5))
    for a in (["<s>", "<s>"], ["<s>", b"w1"], [b"w1", b"w2"], [b"w1", b"never"]):  # shares of all known words and of an unknown one
        a = a[3 - order :]
        assert abs(sum(share(a, w) for w in c) + share(a, b"unseen") - 1) < 1e-9
    assert ngram.report(none, order=order).count() == 0


def test_the_third_order_tells_more(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    two, three = (ngram.report(docs, order=n).where("held_out").agg({"score": "sum"}).first()[0] for n in (2, 3))
    assert three > two


def test_no_training_rows(spark):
    i = next(i for i in range(1000) if held(i))
    row = ngram.report(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_held_out_texts_score_above_base(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    r = ngram.report(docs).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert r["sum(score)"] > r["sum(base_score)"]


def test_what_a_word_decides_is_worked_out_once(spark, monkeypatch):
    """Slices and sums of middle words are those of distinct words, not of every token; scores don't depend on the order of lookups."""
    trained = ngram.train(spark.createDataFrame([("a b a c a b",), ("b a",)], "text string"))
    asked, plain = [], ngram.pair_key
    monkeypatch.setattr(ngram, "pair_key", lambda context, word: asked.append(len(context)) or plain(context, word) if np.ndim(word) == 0 else plain(context, word))
    h, ends, _ = next(ngram.tokens(["a b " * 50, "c never a"], 1000))
    _, _, scores = trained.token_scores(h, ends)
    assert max(asked) <= len(set(h.tolist())) + 1
    h, ends, _ = next(ngram.tokens(["c never a"], 1000))
    assert np.allclose(scores[-len(h) :], trained.token_scores(h, ends)[2], rtol=1e-12)
