"""Change logs as streams: each micro-batch is a commit. A late change is clamped like a slow clock, so no watermark drops it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palimpsest.engine import TemporalTable
from palimpsest.sources.store import Files


def ingest(changes: DataFrame, table: TemporalTable, checkpoint: str, *, order: Sequence[str] = ("seq",), ts: str = "commit_ts", op: str = "op", trigger: dict | None = None, dangling_deletes: str = "drop", duplicate_inserts: str = "update") -> StreamingQuery:
    """Starts the stream. A micro-batch that is replayed after a failure is recognised by its number and by the id that the stream
    keeps in its checkpoint, and skipped; other streams into the table have ids of their own."""

    def commit(batch: DataFrame, number: int) -> None:
        stream = Files(batch.sparkSession, checkpoint).read("metadata")["id"]
        table.apply_changes(batch, order=order, ts=ts, op=op, stream=(stream, number), dangling_deletes=dangling_deletes, duplicate_inserts=duplicate_inserts)

    return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
