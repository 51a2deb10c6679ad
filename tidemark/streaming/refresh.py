"""Appends what new files bring, once per key, with Structured Streaming as the file tracker."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import append_missing


def refresh(spark: SparkSession, source: str, schema, target: str, keys: Sequence[str], derive: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Reads the files that have come into ``source`` since the last run, derives rows from them and
    appends those whose keys ``target`` lacks.  A batch that is run again after a failure adds nothing twice.
    """

    def take(batch: DataFrame, _: int) -> None:
        append_missing(derive(batch).dropDuplicates(list(keys)), target, keys)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
