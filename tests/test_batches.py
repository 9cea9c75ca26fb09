import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom.operators import batches


def loop(lengths, budget, most_rows):
    """(batch of each of the sorted lengths), one by one."""
    out, batch, have = [], -1, 0
    for n in sorted(lengths):
        if batch < 0 or have >= most_rows or (have + 1) * n > budget:
            batch, have = batch + 1, 0
        have += 1
        out.append(batch)
    return out


def test_plan_equals_a_loop():
    rng = random.Random(1)
    for _ in range(400):
        lengths = [rng.randrange(1, rng.choice([3, 20, 200])) for _ in range(rng.randrange(1, 120))]
        budget, most = rng.choice([1, 50, 400, 10**9]), rng.choice([1, 8, 32, 10**9])
        histogram, want, got = Counter(lengths), loop(lengths, budget, most), []
        for (row, fit, batch, have), n in zip(batches.plan(histogram, budget, most), sorted(histogram)):
            assert row == len(got)
            got += [batch + (have + i) // fit for i in range(histogram[n])]
        assert got == want


def cut_one_by_one(a, b, room):
    """Tokens leave the longer half one at a time; halves of a tie give in turn, the one that was longer keeping more."""
    first_longer = a > b
    while a + b > room:
        if a > b or a == b and not first_longer:
            a -= 1
        else:
            b -= 1
    return a, b


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("alpha beta Gamma delta é 漢字 x.".split()) for _ in range(n))
    made = [(f"q{i % 20}", f"d{i}", text(rng.randrange(0, 30)), text(rng.randrange(0, 60)), float(i % 2)) for i in range(240)]
    made += [("q", "null", None, None, 1.0), ("q", "long", text(500), text(3), 0.0), ("q", "both", text(300), text(400), None), ("q", "document", text(3), text(4000), 1.0)]
    return spark.createDataFrame(made, "qid string, docid string, qtext string, doctext string, label double").repartition(5).cache()


def test_pairs(rows):
    tokens = {r.docid: (r.q, r.d) for r in rows.select("docid", batches.word_ids(F.col("qtext")).alias("q"), batches.word_ids(F.col("doctext")).alias("d")).collect()}
    for most, cut in ((40, "longest_first"), (41, "longest_first"), (40, "document")):
        got = batches.pairs(rows, ["docid"], most=most, cut=cut).collect()
        assert len(got) == 244
        for r in got:
            q, d = tokens[r.docid]
            if cut == "document":
                a = min(len(q), most - 3)
                b = min(len(d), most - 3 - a)
            else:
                a, b = cut_one_by_one(len(q), len(d), most - 3)
            assert r.ids == [1, *q[:a], 2, *d[:b], 2] and r.length == len(r.ids) <= most and r.types == [0] * (a + 2) + [1] * (b + 1)
    with pytest.raises(ValueError):
        batches.pairs(rows, ["docid"], cut="nothing")


def test_prompts_cut_the_document_alone(rows):
    words = {r.w: r.i for r in rows.sparkSession.createDataFrame([(w,) for w in ("query:", "document:", "relevant:")], "w string").select("w", batches.word_ids(F.col("w"))[0].alias("i")).collect()}
    tokens = {r.docid: (r.q, r.d) for r in rows.select("docid", batches.word_ids(F.col("qtext")).alias("q"), batches.word_ids(F.col("doctext")).alias("d")).collect()}
    for r in batches.prompts(rows, ["docid"], most=64).collect():
        q, d = tokens[r.docid]
        before = [words["query:"], *q, words["document:"]][:62]
        assert r.ids == [*before, *d[: 62 - len(before)], words["relevant:"], 2] and r.length == len(r.ids) <= 64 and set(r.types) == {0}


@pytest.mark.parametrize("budget,most_rows", [(300, 32), (10**6, 7), (1, 5)])
def test_every_row_is_in_one_batch(rows, budget, most_rows, monkeypatch):
    monkeypatch.setattr(batches, "NUMBERED", 3)  # lengths are numbered in parts
    encoded = batches.pairs(rows, ["docid"], most=50).cache()
    got = batches.batched(encoded, ["docid"], budget, most_rows).orderBy("batch").collect()
    own, seen = {tuple(r.ids): 0 for r in encoded.collect()}, Counter()
    want = Counter(tuple(r.ids) for r in encoded.collect())
    for b in got:
        assert b.rows == len(b.input_ids) == len(b.attention_mask) == len(b.token_type_ids) == len(b.labels) <= most_rows
        assert b.rows * b.width <= budget or b.rows == 1
        for ids, mask, types in zip(b.input_ids, b.attention_mask, b.token_type_ids):
            n = sum(mask)
            assert mask == [1] * n + [0] * (b.width - n) and ids[n:] == [0] * (b.width - n) and len(types) == b.width
            seen[tuple(ids[:n])] += 1
        assert b.width == max(map(sum, b.attention_mask)) and b.tokens == sum(map(sum, b.attention_mask))
    assert seen == want and len(own) <= 244
    lengths = [r.length for r in encoded.collect()]
    assert [b.rows for b in got] == [n for _, n in sorted(Counter(loop(lengths, budget, most_rows)).items())]
    total = batches.padding(batches.batched(encoded, ["docid"], budget, most_rows)).first()
    assert total.rows == 244 and abs(total.share - (1 - sum(lengths) / sum(b.rows * b.width for b in got))) < 1e-12
    assert batches.batched(encoded.limit(0), ["docid"]).count() == 0


def test_library_ids(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = spark.createDataFrame([("Some words, here.",), (None,)], "t string").select(batches.library_ids(path)(F.col("t")).alias("i")).collect()
    assert [r.i for r in got] == [Tokenizer.from_file(path).encode("Some words, here.").ids, []]
