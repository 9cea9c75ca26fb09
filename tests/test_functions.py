import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.functions import vector as V


def values(spark, rows, make, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(make(F.col("x"))).collect()]


def test_strip_takes_all_white_space(spark):
    odd = ["\t a\x1c", "\x85b\xa0", "　c \n", " ", "", "d e"]
    assert values(spark, odd, T.strip) == [x.strip() for x in odd]


def test_first_words(spark):
    rows = [" ".join(map(str, range(n))) for n in (0, 1, 511, 512, 513)] + ["a\x1cb　c\n\nd", ""]
    assert values(spark, rows, T.first_words) == [" ".join(x.split()[:512]) for x in rows]


@pytest.mark.parametrize(("corpus", "least"), [("signal1m", 3), ("hotpotqa", 150), ("quora", 15), ("climate-fever", 3), ("other", 300)])
def test_length_filter(spark, corpus, least):
    rows = ["😀" * (least - 1), "😀" * least]
    assert values(spark, rows, lambda c: T.long_enough(c, corpus)) == [False, True]


def test_mining_query_cuts_at_every_mark(spark):
    rows = [m + " x" for m in T.MINING_ENDS] + ["keep this " + m + " x" for m in T.MINING_ENDS] + ["\nwhat is\nit ", "Example 1:", ""]
    n = len(T.MINING_ENDS)
    assert values(spark, rows, T.mining_query) == [""] * n + ["keep this"] * n + ["what isit", "", ""]


def test_generated_query(spark):
    got = values(spark, ["P\n what is it? more", "P first\nsecond", "P a Answer: b Example 5: c", "no echo?"], lambda c: T.generated_query(c, F.lit("P")))
    assert got == ["what is it", "first", "a", "no echo"]


def test_ascii(spark):
    assert values(spark, ["", "é", "a\nb", "\x7f"], T.is_ascii) == [True, False, True, True]


def test_prompt_keeps_braces_of_documents(spark):
    assert values(spark, ["a {document} {} {query}"], lambda c: T.prompt("D: {document}\nQ: {query}\n", c)) == ["D: a {document} {} {query}\nQ:"]


def test_raw_documents(spark):
    rows = ['{"title": "T \\"q\\"", "text": "a\\",b", "metadata": {}}', '{"text": "only"}', "broken"]
    make = lambda style: lambda c: T.titled(T.raw_field(c, "title"), T.raw_field(c, "text"), style)
    assert values(spark, rows, make("space")) == ['T "q" a",b', " only", " "]
    assert values(spark, rows, make("sentence")) == ['T "q". a",b', ". only", ". "]


def test_labels_and_lines(spark):
    assert values(spark, [1.0, 0.0, 0.5, None], T.label_token, "x double") == ["true", "false", "false", "false"]
    assert values(spark, ["a\tb\nc\r"], T.one_line) == ["a b c "]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = rows.select(V.dot(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("b")), V.squared_distance(F.col("a"), F.col("b")), V.log_softmax(F.lit(1000.0), F.lit(1000.0))).collect()
    assert got[0][:3] == (24.0, 0.96, 2.0)
    assert got[1][1] != got[1][1]  # NaN
    assert abs(got[0][3] + 0.6931471805599453) < 1e-12
