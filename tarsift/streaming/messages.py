"""Queue messages, each version once, with state that ends.

Delivery is at least once, so a message may come again at any time. What was seen is kept for a
while only: an entry is one moment per version and goes when ``keep`` has passed since the last
message of that version (the state store's time to live). Every message leaves with what is known
of it, none is dropped here:

* ``fresh``: no message of its version was seen within ``keep``;
* ``repeat``: one was;
* ``late``: none was, but it was queued more than ``keep`` before its batch began, so that the
  entry that would have made it a repeat may have ended.

Fresh and late messages go on to the check against the stored versions, which is exact, so a
message that comes after its entry ended costs a look-up there and is not analysed twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from tarsift.functions.timestamps import parse_timestamp
from tarsift.session import ship_with_tasks

KEYS = ["name", "version"]
KEEP = timedelta(days=2)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# No leading underscore: rows reach the processor as named tuples.
_AT = "queued_at_millis"


class Seen(StatefulProcessor):
    """The last moment a version was asked for."""

    def __init__(self, keep: timedelta, columns: list[str]):
        self.keep, self.columns = keep, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long", ttlDurationMs=int(self.keep.total_seconds() * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known = self.last.exists()
        for frame in rows:
            if not len(frame):
                continue
            at = frame[_AT]
            old = at.notna() & (at < now - self.keep.total_seconds() * 1000)
            kinds = old.map({True: "late", False: "fresh"})
            if known:
                kinds[:] = "repeat"
            else:
                kinds.iloc[1:] = "repeat"
            known = True
            frame["kind"] = kinds
            yield frame[[*self.columns, "kind"]]
        self.last.update((int(now),))

    def close(self) -> None:
        pass


def state_store(spark: SparkSession) -> None:
    """State that ends needs a store that can let it: the session's is set where it is not."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def told_apart(messages: DataFrame, keep: timedelta = KEEP) -> DataFrame:
    """The messages with ``kind``: fresh, repeat or late."""
    state_store(messages.sparkSession)
    columns = messages.columns
    queued = parse_timestamp(F.col("queued_at")) if "queued_at" in columns else F.lit(None).cast("timestamp")
    timed = messages.withColumn(_AT, F.unix_millis(queued.cast("timestamp")).cast("double"))
    schema = StructType([*messages.schema.fields, StructField("kind", StringType())])
    return timed.groupBy(*KEYS).transformWithStateInPandas(
        statefulProcessor=Seen(keep, columns), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime"
    )


ship_with_tasks(__name__)
