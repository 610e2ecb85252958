"""Messages as they arrive: the same row-local pass over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from millrace.config import EngineConfig
from millrace.operators.dissect import dissect


def dissect_stream(messages: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """A stream of nested rows; stateless, so it needs no watermark."""
    return dissect(messages, config)


def write_dissected(dissected: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends nested rows to Parquet, each input once."""
    return dissected.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
