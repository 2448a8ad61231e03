"""Streaming ingestion: new Markdown documents are built batch by batch, as each step is per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import pipeline


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the tables of every batch under `out`/<table>/batch=<n>; a batch that runs again replaces its own files."""

    def build(batch: DataFrame, number: int) -> None:
        steps = f"{out}/steps/batch={number}"  # each step of the batch is written once and read by the next
        made = pipeline.build(batch.select("doc_id", "source_file", "md_text"), keep=steps)
        for name in ("parsed", "chunks", "nodes", "edges"):
            getattr(made, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
