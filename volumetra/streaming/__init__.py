"""The same pipeline over a stream of volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Pipeline


def augment_stream(volumes: DataFrame, pipeline: Pipeline, path: str, checkpoint: str) -> StreamingQuery:
    """Write augmented volumes as Parquet. Stateless, and draws are hashes, so a replayed batch gives the same rows."""
    return pipeline.apply(volumes).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
