"""Watches on a stream: each watch tells of a signature once, over restarts too."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..context import Context
from ..operators import watches

#: The store of state that can hold maps by key and let entries expire.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "watch_id long, signature string, event string, investigation_id long, user_id long, team_id long, at timestamp"


class _Told(StatefulProcessor):
    """State of a watch: the signatures that it has told of, each for ``ttl_ms`` (none: for good)."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getMapState("told", "signature string", "at timestamp", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            new = pdf.sort_values(["at", "event"]).drop_duplicates("signature")
            new = new[[not self.told.containsKey((s,)) for s in new["signature"]]]
            for s, at in zip(new["signature"], new["at"], strict=True):
                self.told.updateValue((s,), (at.to_pydatetime(),))
            if len(new):
                yield new[[f.split(" ")[0] for f in _OUT.split(", ")]]

    def close(self) -> None:
        pass


def told_once(events: DataFrame, ttl_hours: float | None = None) -> DataFrame:
    """Of a stream of ``events`` (watch_id, signature, event, investigation_id, user_id, team_id, at) those whose signature their watch has not told of.

    State is kept by watch in the checkpoint; without ``ttl_hours`` a signature
    is never told again, as by a ledger with a unique key.
    """
    rows = events.select(*(F.expr(f"cast({n} as {t}) as {n}") for n, t in (f.split(" ") for f in _OUT.split(", ")))).where("watch_id IS NOT NULL AND signature IS NOT NULL")
    processor = _Told(None if ttl_hours is None else int(ttl_hours * 3.6e6))
    return rows.groupBy("watch_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=_OUT, outputMode="Append", timeMode="None" if ttl_hours is None else "ProcessingTime")


def comment_events(ctx: Context, comments: DataFrame) -> DataFrame:
    """A stream of comments (id, investigation_id, author_id, created_at) as events of the watches that want them; watches are a table of state."""
    w = ctx.table("watches").where(F.col("active") & watches.wanted(F.lit("comment"))).select(F.col("id").alias("watch_id"), "investigation_id", "user_id", "team_id")
    rows = comments.withColumnRenamed("id", "comment_id").join(w, "investigation_id").where("user_id IS NULL OR author_id IS NULL OR user_id <> author_id")
    return rows.select("watch_id", F.concat(F.lit("comment:"), F.col("comment_id").cast("string")).alias("signature"), F.lit("comment").alias("event"), "investigation_id", "user_id", "team_id", F.col("created_at").alias("at"))


def tell(events: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, ttl_hours: float | None = None) -> StreamingQuery:
    """Hands what is new to ``send`` (rows, batch number), batch by batch, until all that is there now is done; goes on from ``checkpoint``.

    A batch that was handed on but not finished is handed on again with its
    number: let ``send`` write under that number.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    query = told_once(events, ttl_hours).writeStream.outputMode("append").foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
