"""Incremental ingest: seen-content state, flagged copies, and idempotent upserts from a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgraph.sources.config import Versions

FLAGGED = "sha string, message_id string, duplicate_of string"


def distinct_within(messages: DataFrame, late: str) -> DataFrame:
    """First copies only, with state bounded by the watermark: (sha, ts, ...)."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sha"])


def flag_copies(messages: DataFrame, horizon_ms: int = 0) -> DataFrame:
    """(sha, message_id, duplicate_of): all messages, later copies with the id of the first seen. The state is one id for each content; with
    horizon_ms it is dropped after so long without a copy (then the next copy counts as a first)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = state.get[0] if state.exists else None
        for rows in batches:
            rows = rows.sort_values("ord")
            if first is None:
                first = rows["message_id"].iloc[0]
            yield pd.DataFrame({"sha": key[0], "message_id": rows["message_id"], "duplicate_of": [None if m == first else first for m in rows["message_id"]]})
        state.update((first,))
        if horizon_ms:
            state.setTimeoutDuration(horizon_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if horizon_ms else GroupStateTimeout.NoTimeout
    return messages.select("sha", "message_id", "ord").groupBy("sha").applyInPandasWithState(run, FLAGGED, "first string", "append", timeout)


def upsert_stream(stream: DataFrame, versions: Versions, table: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str):
    """Each micro-batch is merged into a versioned table. Merges are keyed, so a batch that runs twice changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            versions.commit(**{table: merge(versions.read(table), batch)})

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keyed_by_content(messages: DataFrame) -> DataFrame:
    return messages.withColumn("sha", F.sha2("body_raw", 256))
