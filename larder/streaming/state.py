"""Keyed state with a time to live, as of a moment in batch and as a stateful stream; upserts of a stream into a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larder.operators.ratings import latest

#: Seconds for which a saved state is valid; a state of exactly this age still is.
TTL = 900


def state_as_of(events: DataFrame, key: str, ts: str, action: str, payload: str, now: str, ttl: int = TTL) -> DataFrame:
    """(key, payload): the last saved payload of each key that is not cleared and not older than ``ttl`` at ``now`` (event time).

    One aggregation per key, combined before the shuffle; a null key is a key, events after ``now`` are not seen."""
    seen = events.filter(F.col(ts) <= F.lit(now).cast("timestamp"))
    last = seen.groupBy(key).agg(F.max_by(F.struct(F.col(action).alias("a"), F.col(payload).alias("p"), F.col(ts).alias("t")), F.struct(F.col(ts), F.col(payload))).alias("s"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("s.t")
    return last.filter((F.col("s.a") == "save") & (age <= ttl)).select(key, F.col("s.p").alias("payload"))


def ttl_stream(events: DataFrame, key: str, action: str, payload: str, ttl: int = TTL) -> DataFrame:
    """A stream of (key, payload, found): ``save`` keeps a payload for ``ttl`` seconds of processing time, ``get`` gives it back, ``clear`` drops it."""
    kind = dict(events.dtypes)[key]

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        out = []
        held = state.get[0] if state.exists else None
        for frame in frames:
            for what, value in zip(frame["_action"], frame["_payload"], strict=True):
                if what == "save":
                    held = value
                    state.update((value,))
                    state.setTimeoutDuration(ttl * 1000)
                elif what == "clear":
                    held = None
                    if state.exists:
                        state.remove()
                elif what == "get":
                    out.append((group[0], held, held is not None))
        if out:
            yield pd.DataFrame(out, columns=[key, "payload", "found"])

    used = events.select(F.col(key), F.col(action).alias("_action"), F.col(payload).alias("_payload"))
    return used.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, payload string, found boolean", "payload string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_stream(stream: DataFrame, target: str, keys: list[str], order: str, checkpoint: str):
    """A query that keeps the latest row per key of a stream in two alternating parquet versions of ``target``.

    Each batch joins its own rows to the last version; a batch that runs again writes the same version again, so the result
    is as if every event came once."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old, new = f"{target}/v{(number + 1) % 2}", f"{target}/v{number % 2}"
        rows = batch if number == 0 else batch.unionByName(spark.read.parquet(old))
        latest(rows, keys, order).select(*batch.columns).write.mode("overwrite").parquet(new)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts per window and kind under a watermark: state is dropped once a window can get no more rows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
