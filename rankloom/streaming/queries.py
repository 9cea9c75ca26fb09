"""Generated queries as a stream: cleaned as they arrive, written batch by batch.

All operators of ``functions.text`` are stateless, so a stream takes the same expressions as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.corpus import query_candidates
from ..sources.files import GENERATED


def generated_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON files of a folder, as generated queries."""
    return spark.readStream.schema(GENERATED).json(folder)


def cleaned_to(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Cleaned queries appended as JSON lines, each input file once."""
    return query_candidates(stream).writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
