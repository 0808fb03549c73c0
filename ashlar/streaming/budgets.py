"""Budgets and breakers kept by a stream: what each source has used of its month, and whether it fails too often to be asked."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ashlar.tables import filesystem

ZONE = "America/Los_Angeles"
#: Failures in a row after which a source isn't asked any more in its month.
FAILURES = 5
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "source string, call long, period string, call_no long, decision string"


class Ledger(StatefulProcessor):
    """Decides on the calls of one source in the order of their time and number. The state is five values, whatever the number of calls: the month and its end, the calls asked for and the failures
    in a row in it, and whether the breaker is open. A month is closed, with a row that says so, by a timer at its end or by a call of a later one, whichever comes first."""

    def __init__(self, budget: int, failures: int):
        self.budget, self.failures = budget, failures

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "period string, calls long, failed long, open boolean, ends long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        period, calls, failed, open_, due = self.used.get() if self.used.exists() else ("", 0, 0, False, None)
        out = []
        asked = pd.concat(list(rows)).sort_values(["at", "call"])  # of one source and one micro-batch
        for call, month, ends, bad in zip(asked["call"], asked["period"], asked["ends"], asked["failed"]):
            if month < period:
                out.append((key[0], call, month, None, "late"))
                continue
            if month > period:
                if due is not None:
                    out.append((key[0], None, period, calls, "closed"))
                    self.handle.deleteTimer(due)
                period, calls, failed, open_, due = month, 0, 0, False, int(ends)
                self.handle.registerTimer(due)
            calls += 1
            granted = not open_ and calls <= self.budget
            out.append((key[0], call, month, calls, "granted" if granted else "breaker open" if open_ else "over budget"))
            if granted:
                failed = failed + 1 if bad else 0
                open_ = failed >= self.failures
        self.used.update((period, calls, failed, open_, due))
        yield pd.DataFrame(out, columns=["source", "call", "period", "call_no", "decision"]).astype({"call": "Int64", "call_no": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.used.exists():
            period, calls, _, _, _ = self.used.get()
            self.used.update((period + "~", 0, 0, False, None))  # after the month, before the next: calls of the month are late from now on
            yield pd.DataFrame([(key[0], None, period, calls, "closed")], columns=["source", "call", "period", "call_no", "decision"]).astype({"call": "Int64", "call_no": "Int64"})

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """While this holds, streams that start keep their state in RocksDB, which values and timers need."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if old is None else spark.conf.set(_PROVIDER, old)


def ledger(calls: DataFrame, budget: int, failures: int = FAILURES, late: str = "1 day") -> DataFrame:
    """source, call, period, call_no, decision: a row for each call of a stream (source, call, at: timestamp, failed), and one that closes each month: when its end is `late` behind the newest call, or a call of a later month of its source comes.

    Calls of a source are taken in the order of their time, then their number, within a micro-batch, and micro-batches as they come. A call is granted while the month's budget lasts (Pacific time) and the breaker is closed; it opens when
    `failures` granted calls in a row have failed, until the month ends. Calls of a month that is over, for their source, are late and count nowhere. Null sources and times are left out; a null `failed` is no failure. A source's calls of one micro-batch are
    held together, so maxFilesPerTrigger bounds them.
    """
    local = F.from_utc_timestamp("at", ZONE)
    ends = F.to_utc_timestamp(F.date_trunc("month", F.add_months(F.date_trunc("month", local), 1)), ZONE)
    rows = calls.where("source IS NOT NULL AND at IS NOT NULL").select(
        F.col("source").cast("string").alias("source"), F.col("call").cast("long").alias("call"), "at", F.date_format(local, "yyyy-MM").alias("period"), F.unix_millis(ends).alias("ends"), F.coalesce("failed", F.lit(False)).alias("failed"))
    return rows.withWatermark("at", late).groupBy("source").transformWithStateInPandas(statefulProcessor=Ledger(budget, failures), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")


def keep(decisions: DataFrame, root: str) -> DataFrame:
    """Runs what ledger() gives over all that is there and returns all that was ever written under root. The checkpoint is there too: the next run, in whatever process, goes on counting."""
    spark = decisions.sparkSession
    fs, p = filesystem(spark, root)
    fs.mkdirs(p)
    with rocks(spark):
        q = decisions.writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{root}/out").start()
        q.awaitTermination()
    return spark.read.schema(decisions.schema).parquet(f"{root}/out")
