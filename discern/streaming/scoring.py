"""Apply a fitted classifier to rows as they arrive."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Streaming rows with their prediction; stateless, so nothing is held back."""
    return model.transform(rows).select(*keep, "prediction")


def write_scores(scores: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append scores as parquet, each row once; without ``interval`` stop when the input is drained."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        scores.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )
