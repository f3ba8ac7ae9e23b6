"""Streams: bins and predictions of rows as they come. Nothing here keeps state, so nothing has to be late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.encoder import EncoderModel
from ..plans.forest import ForestModel


def binned(stream: DataFrame, encoder: EncoderModel) -> DataFrame:
    """The stream with its bins. Unknown categories should count as missing: a stream can't be looked through first."""
    if encoder.handle_unknown == "error" and any(encoder.categorical):
        raise ValueError("handle_unknown should be consider_missing for a stream")
    return encoder.transform(stream)


def predict(stream: DataFrame, model: ForestModel, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the predictions of each micro-batch as Parquet; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        model.predict(batch, key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
