import pytest

from rankloom.sources import connector


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("collections"))
    docs = spark.createDataFrame([(i, f"text {i}", 1) for i in range(300)] + [(None, "no key", 1), (7, "again", 2), (8, None, 3)], "docid long, doctext string, bucket_of int")
    connector.store(docs, root, "one", "documents", 16)
    connector.store(spark.createDataFrame([("q1", "d1", 1), ("q1", "d2", 0), ("é", "d1", 2)], "qid string, docid string, rel int"), root, "one", "qrels")
    connector.store(spark.createDataFrame([("q1", "a topic")], "qid string, title string"), root, "one", "topics")
    connector.store(docs.limit(0), root, "empty", "documents")
    return root


def reader(spark, root, wanted=None):
    r = connector.CollectionReader(f"{root}/one/documents", "docid", None)
    r.wanted = wanted
    return r


def test_whole_parts(spark, root):
    df = connector.collection(spark, root, "one", "documents")
    assert df.schema.simpleString() == "struct<docid:string,doctext:string,bucket_of:int>"
    rows = sorted(map(tuple, df.fillna("").collect()))
    assert rows == sorted([(str(i), f"text {i}", 1) for i in range(300)] + [("7", "again", 2), ("8", "", 3)])
    assert sorted(map(tuple, connector.collection(spark, root, "one", "qrels").collect())) == [("q1", "d1", 1), ("q1", "d2", 0), ("é", "d1", 2)]
    assert connector.collection(spark, root, "one", "topics").first().title == "a topic"


def test_keys_are_pushed_down(spark, root):
    df = connector.collection(spark, root, "one", "documents")
    asked = df.where(df.docid.isin("7", "9", "nope"))
    assert "PushedFilters: [In(docid, [7,9,nope])]" in asked._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert sorted(r.doctext for r in asked.collect()) == ["again", "text 7", "text 9"]
    assert sorted(r.doctext for r in df.where("docid = '7' AND bucket_of = 2").collect()) == ["again"]
    assert df.where("docid = '7' AND docid = '9'").count() == 0 and df.where("docid = 'nope'").count() == 0
    assert df.where("docid > '98'").count() == 1  # what is no equality stays with Spark
    assert len(reader(spark, root).partitions()) == 16
    assert len(reader(spark, root, {"7"}).partitions()) == 1


def test_joins_and_columns(spark, root):
    df = connector.collection(spark, root, "one", "documents")
    keys = spark.createDataFrame([("3",), ("4",)], "docid string")
    assert sorted(r.doctext for r in df.join(keys, "docid").select("doctext").collect()) == ["text 3", "text 4"]
    assert df.select("bucket_of").distinct().count() == 3 and df.count() == 302


def test_what_is_missing_is_an_error(spark, root):
    connector.register(spark)
    for options in ({"root": root, "name": "one"}, {"root": root, "name": "one", "part": "other"}, {"root": root, "name": "none", "part": "topics"}):
        with pytest.raises(Exception, match="missing|no part|no collection|No such file|FileNotFound|does not exist|Cannot open"):
            spark.read.format("rankloom").options(**options).load().collect()
