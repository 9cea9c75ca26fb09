"""Collections by name: documents, topics and judgments as a Spark data source, ``spark.read.format("rankloom")``.

A collection is a folder below a root that all machines reach: ``<root>/<name>/<part>/bucket=<n>/…`` with Parquet files, bucketed by
a hash of the part's key and sorted by it. A read is one task for each bucket; a filter for keys leaves only the buckets
that can hold them, and in these the row groups that can. Register the source once a session with ``register``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: The key of each part of a collection.
KEYS = {"documents": "docid", "topics": "qid", "qrels": "qid"}
BUCKETS = 32


def store(rows: DataFrame, root: str, name: str, part: str, buckets: int = BUCKETS) -> None:
    """Write a part of a collection: documents (docid, …), topics (qid, …) or qrels (qid, docid, rel). Rows without a key go."""
    key = KEYS[part]
    keyed = rows.withColumn(key, F.col(key).cast("string")).where(F.col(key).isNotNull())
    dealt = keyed.withColumn("bucket", F.pmod(F.crc32(F.col(key).cast("binary")), F.lit(buckets)).cast("int"))
    # a rebalance keeps a bucket in few files, and splits one that is too large for a task
    dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(path := f"{root.rstrip('/')}/{name}/{part}")
    system, place = _place(path)
    with system.open_output_stream(f"{place}/_buckets") as f:
        f.write(str(buckets).encode())


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def rows_of(uri: str):
    """The rows of one Parquet file, as an Arrow table."""
    import pyarrow.parquet as pq

    system, path = _place(uri)
    return pq.read_table(path, filesystem=system, partitioning=None)


class Bucket(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class CollectionReader(DataSourceReader):
    def __init__(self, uri: str, key: str, schema: StructType):
        self.uri, self.key, self.schema, self.wanted = uri, key, schema, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and lists of keys; the rest stays Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (self.key,):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def _buckets(self) -> dict[int, list[str]]:
        from pyarrow import fs

        system, path = _place(self.uri)
        out: dict[int, list[str]] = {}
        for f in system.get_file_info(fs.FileSelector(path, recursive=True)):
            folder, _, name = f.path.rpartition("/")
            if f.is_file and name.endswith(".parquet") and "/bucket=" in folder:
                out.setdefault(int(folder.rpartition("=")[2]), []).append(f.path)
        return out

    def partitions(self) -> list[Bucket]:
        found = self._buckets()
        if self.wanted is not None and found:
            # buckets without rows have no folder, so their number is kept beside
            count = self._count()
            keep = {zlib.crc32(w.encode()) % count for w in self.wanted if w is not None}
            found = {b: files for b, files in found.items() if b in keep}
        return [Bucket(sorted(files)) for _, files in sorted(found.items())] or [Bucket([])]

    def _count(self) -> int:
        system, path = _place(self.uri)
        with system.open_input_stream(f"{path}/_buckets") as f:
            return int(f.read())

    def read(self, partition: Bucket) -> Iterator:
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.files:
            return
        system, _ = _place(self.uri)
        schema = to_arrow_schema(self.schema)
        keep = None if self.wanted is None else ds.field(self.key).isin(pa.array([w for w in self.wanted if w is not None], pa.string()))
        for batch in ds.dataset(partition.files, schema=schema, filesystem=system, format="parquet").to_batches(columns=schema.names, filter=keep):
            if batch.num_rows:
                yield batch


class Collections(DataSource):
    """Options: root, name, part (documents, topics or qrels)."""

    @classmethod
    def name(cls) -> str:
        return "rankloom"

    def _uri(self) -> str:
        for option in ("root", "name", "part"):
            if option not in self.options:
                raise ValueError(f"the option {option} is missing")
        if self.options["part"] not in KEYS:
            raise ValueError(f"no part {self.options['part']}: {', '.join(KEYS)}")
        return f"{self.options['root'].rstrip('/')}/{self.options['name']}/{self.options['part']}"

    def schema(self) -> StructType:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        system, _ = _place(self._uri())
        files = [f for b in CollectionReader(self._uri(), "", StructType())._buckets().values() for f in b]
        if not files:
            raise ValueError(f"no collection at {self._uri()}")
        return from_arrow_schema(pq.read_schema(min(files), filesystem=system).remove_metadata())

    def reader(self, schema: StructType) -> CollectionReader:
        return CollectionReader(self._uri(), KEYS[self.options["part"]], schema)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters handed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Collections)


def collection(spark: SparkSession, root: str, name: str, part: str) -> DataFrame:
    register(spark)
    return spark.read.format("rankloom").option("root", root).option("name", name).option("part", part).load()
