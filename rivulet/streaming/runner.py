"""Structured Streaming into the engine: each micro-batch is one batch of changes, applied once.

Engine state and the stream's last batch are published in one write before
Spark's checkpoint moves on.  After a restart Engine.load() gives the state, and
a micro-batch that Spark sends again is known by the stream's name and its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.zset import W


def run(engine, table: str, stream: DataFrame, checkpoint: str, weight: str | None = None, name: str | None = None, **trigger):
    """Start a query that applies stream's rows to table; weight: an SQL expression, 1 if not given; name: the stream's, its checkpoint if not given."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        w = F.expr(weight) if weight else F.lit(1)
        names = [c for c in engine.store.schemas[table].names if c != W]
        fixed = engine.store.fixed(batch.select(*names, w.cast("long").alias(W)))
        engine.apply_batch({table: fixed}, batch_id=batch_id, stream=name or checkpoint)
        engine.publish()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
