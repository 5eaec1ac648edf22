"""Statement files as they arrive, each content ingested once.

Copies of a file can arrive months apart, so no watermark bounds what has been
seen: every micro-batch is compared with the manifest table instead. A batch that
is run again after a failure finds its own rows there and adds nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans.rebuild import ingest_texts
from ledgerloom.sources.files import stream_packed, stream_texts
from ledgerloom.sources.lake import Lake
from ledgerloom.sources.layouts import LAYOUTS, Layout


def ingest_stream(
    lake: Lake,
    folder: str,
    checkpoint: str,
    glob: str = "*.txt",
    layouts: Sequence[Layout] = LAYOUTS,
    continuous_every: str | None = None,
    packed: bool = False,
) -> StreamingQuery:
    """Ingest what is there and stop, or keep looking every so often.

    With `packed`, the folder holds Parquet files with a statement per row instead."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        ingest_texts(Lake(batch.sparkSession, lake.root), batch, layouts)

    files = stream_packed(lake.spark, folder) if packed else stream_texts(lake.spark, folder, glob)
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    if continuous_every is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=continuous_every).start()
