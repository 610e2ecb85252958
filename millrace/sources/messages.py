"""Raw messages as a table of (msg_key, path, content)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import EngineConfig
from millrace.functions.mime import form_field
from millrace.workspace import mapped

TOO_LARGE = "TOO_LARGE"


def with_keys(df: DataFrame, content: str = "content") -> DataFrame:
    """The key of a message is the digest of its bytes."""
    return df.withColumn("msg_key", F.sha2(F.col(content), 256))


def read_messages(spark: SparkSession, path: str, config: EngineConfig = EngineConfig(), glob: str = "*.eml") -> DataFrame:
    """Messages in files. Those past the size limit are known by their length alone: their
    bytes are never read, and they come with a null content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    small = with_keys(files.where(F.col("length") <= config.max_message_bytes).select("path", "length", "content"))
    large = files.where(F.col("length") > config.max_message_bytes).select("path", "length").withColumn("content", F.lit(None).cast("binary")).withColumn("msg_key", F.sha2("path", 256))
    return small.unionByName(large).select("msg_key", "path", "length", "content")


def stream_messages(spark: SparkSession, path: str, glob: str = "*.eml") -> DataFrame:
    """The same as a stream of files as they come."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(path)
    return with_keys(files).select("msg_key", "path", "length", "content")


def form_messages(posted: DataFrame, body: str = "body", content_type: str = "content_type", field: str = "eml") -> DataFrame:
    """(msg_key, content) of posted bodies: the field of a form, else the body as it is. A form
    without the field has a null content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, kind in zip(*batch.columns, strict=True):
                data, said = raw.as_py(), kind.as_py() or ""
                if data is not None and said.strip().lower().startswith("multipart/form-data"):
                    data = form_field(data, said, field)
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["content"])

    return with_keys(mapped(posted.select(F.col(body).cast("binary"), F.col(content_type)), run, "content binary")).select("msg_key", "content")
