"""The watermark and shelf capture on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "segment_ts timestamp, segment_id long, ceiling long"
OUT = "reader_id long, book_id long, ts timestamp, event_id long, ceiling_seq long"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Events of one (reader, book) in event order; a reset starts anew, a set only raises."""
    events = pd.concat(list(batches)).drop_duplicates("event_id").sort_values(["ts", "event_id"])
    reset_ts, reset_id, ceiling = state.get if state.exists else (pd.Timestamp(0), -1, 0)
    reset_ts = pd.Timestamp(reset_ts)
    out = []
    for ts, event_id, action, seq in zip(events["ts"], events["event_id"], events["action"], events["seq"], strict=True):
        if (ts, event_id) >= (reset_ts, reset_id):  # an event before the last reset changes nothing any more
            if action == "reset":
                # A reset that comes late also drops what was set after it: a ceiling may be too low, never too high.
                ceiling = max(int(seq), 0)
                reset_ts, reset_id = ts, event_id
            else:
                ceiling = max(ceiling, int(seq))
        out.append((int(key[0]), int(key[1]), ts, int(event_id), ceiling))
    state.update((reset_ts.to_pydatetime(), int(reset_id), int(ceiling)))
    yield pd.DataFrame(out, columns=["reader_id", "book_id", "ts", "event_id", "ceiling_seq"])


def watermark_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Ceilings of a stream of position events (reader_id, book_id, ts timestamp, event_id, action, seq).

    Repeats of an event within the delay are dropped.  Events are folded in event order within a micro-batch;
    over micro-batches an event older than the last reset is ignored, and a late reset lowers the ceiling at once.
    """
    fresh = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return fresh.groupBy("reader_id", "book_id").applyInPandasWithState(_fold, OUT, STATE, "append", "NoTimeout")


def shelf_stream(fetches: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], shelf: str, truncated: bool):
    """A writer that merges each micro-batch of feed rows into the shelf table; ``save`` gets the batch id, so that a
    replayed batch can be recognised."""
    from lectern.operators.shelf import upsert_shelf

    def merge(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("review_id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "review_id"]), "fetched_at").alias("r")).select("review_id", "r.*")
        save(upsert_shelf(load(), newest, shelf, truncated), batch_id)

    return fetches.writeStream.foreachBatch(merge)
