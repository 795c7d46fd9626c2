"""Score a stream of whole series with a fixed model: each series by itself, so the stream needs no state and no batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tsbags.operators import kernel
from tsbags.plans.bopf import kernel_of, score_by_joins
from tsbags.plans.common import Model


def score_stream(model: Model, stream: DataFrame, path: str, checkpoint: str, most: int = kernel.BYTES) -> StreamingQuery:
    """stream: (series_id, values). Appends (variant, series_id, predicted) as Parquet to `path`, each series once.

    The model is broadcast and the stream is mapped to its predictions, written by Spark's file sink, whose log counts a
    batch once however often it is run. Only a model of over `most` bytes is joined, micro-batch by micro-batch, each
    written to a folder of its own (`batch=...`) and overwritten if it is run again.
    """
    held = kernel_of(model, most)
    if held is not None:
        out = kernel.score(held, stream).writeStream.format("parquet").option("path", path)
        return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def write(batch: DataFrame, number: int) -> None:
        score_by_joins(model, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
