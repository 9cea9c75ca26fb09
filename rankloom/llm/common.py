"""What the operators of this subpackage share: staging in the shared folder and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster names it.

    Only where neither the setting nor the context has one, in a local session as in tests, a temporary folder of
    this machine is made and set. On a cluster that is an error: its machines would each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor loses nothing."""
    spark, path = df.sparkSession, staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """Working names that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def salt_of(key: Column, buckets: int) -> Column:
    """A bucket number that depends on the key alone."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def crc_rest(doc_id: Column, divisor: int = 5) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


def vectors_of(df: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part: an id, and a vector without null or non-finite components.

    An id that occurs on several rows counts once, with the least of its vectors in array order.
    """
    vec = F.transform(F.col(column), lambda x: x.cast("double"))
    fit = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return (
        df.select(F.col("vec_id"), vec.alias("vec"))
        .where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
        .where(fit)
        .groupBy("vec_id")
        .agg(F.min("vec").alias("vec"))
    )
