"""The conversion on pages that keep arriving: every step is stateless per page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from pagesmelt.operators.captures import decode_responses
from pagesmelt.plans.convert import to_markdown


def capture_stream(responses: DataFrame) -> DataFrame:
    """Decoded captures of a streaming response table; narrow, so a stream as it stands."""
    return decode_responses(responses)


def markdown_stream(pages: DataFrame, path: str, checkpoint: str, **options) -> DataStreamWriter:
    """A writer that converts each micro-batch of a streaming page table.

    A batch is written under its own number, so one that is run again replaces itself.
    """
    def convert(batch: DataFrame, number: int) -> None:
        to_markdown(batch, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint)
