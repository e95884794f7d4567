"""Live status counts of tasks out of a stream of their changes.

The newest status of each task is keyed streaming state. A batch hands on only the tasks whose status
it changed, each with the status it had before, and stores those rows and a handful of totals under its
number. Nothing older is read or written again, and a batch that runs twice ends in the same files.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from harvest.schemas import TASK_STATES

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _order(changed_at, seq, status) -> tuple:
    """Changes by time, then number, then status; nulls come first, as in the batch form."""
    return tuple((v is not None, v) for v in (changed_at, seq, status))


class _Newest(StatefulProcessor):
    """Keeps a task's newest change and hands it on when it differs from the one before."""

    def __init__(self, kinds: T.StructType):
        self.kinds = kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", self.kinds)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = tuple(self.newest.get()) if self.newest.exists() else None
        best = before
        for row in rows:
            change = (row["changed_at"], row["seq"], row["status"])
            if best is None or _order(*change) > _order(*best):
                best = change
        if best != before:
            self.newest.update(best)
            yield Row(id=key[0], status=best[2], changed_at=best[0], seq=best[1],
                      before=None if before is None else before[2], first=before is None)

    def close(self) -> None:
        pass


def status_changes(changes: DataFrame) -> DataFrame:
    """Tasks whose newest status a batch changes: ``id, status, changed_at, seq, before, first``.

    ``changes``: ``id, status, changed_at, seq`` in any order; a change older than the newest one so far
    is passed over. One row of state per task. Needs a state store with column families, see
    :func:`stream_status`.
    """
    # a time with zone is kept as a number, so that no conversion on the way to Python and back shifts it
    zoned = isinstance(changes.schema["changed_at"].dataType, T.TimestampType)
    if zoned:
        changes = changes.withColumn("changed_at", F.unix_micros("changed_at"))
    kind = {f.name: f.dataType for f in changes.schema.fields}
    state = T.StructType([T.StructField(n, kind[n]) for n in ("changed_at", "seq", "status")])
    out = T.StructType([T.StructField(n, kind[n]) for n in ("id", "status", "changed_at", "seq")]
                       + [T.StructField("before", kind["status"]), T.StructField("first", T.BooleanType())])
    made = changes.select("id", "status", "changed_at", "seq").groupBy("id").transformWithState(
        statefulProcessor=_Newest(state), outputStructType=out, outputMode="Update", timeMode="None")
    return made.withColumn("changed_at", F.timestamp_micros("changed_at")) if zoned else made


class LiveStatus:
    """What the batches of :func:`stream_status` have stored under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def absorb(self, batch: DataFrame, number: int) -> None:
        """Store a batch of :func:`status_changes`: its rows, and what they add to each status."""
        rows = f"{self.folder}/changes/batch={number}"
        batch.write.mode("overwrite").parquet(rows)
        stored = batch.sparkSession.read.schema(batch.schema).parquet(rows)     # the state is asked once only
        signed = stored.select(F.explode(F.array(
            F.struct(F.col("status"), F.lit(1).alias("n")),
            F.struct(F.col("before").alias("status"), F.when(F.col("first"), 0).otherwise(-1).alias("n")))).alias("e"))
        signed.groupBy("e.status").agg(F.sum("e.n").alias("n")).where("n <> 0").coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/totals/batch={number}")

    def counts(self) -> DataFrame:
        """Tasks in all and by status, as ``task_status_counts`` gives them, out of the totals alone."""
        totals = self.spark.read.schema("status string, n long, batch long").parquet(f"{self.folder}/totals")
        each = [F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s) for s in TASK_STATES]
        return totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("task_count"), *each)

    def table(self) -> DataFrame:
        """One row per task with its newest change: ``id, status, changed_at, seq``."""
        rows = self.spark.read.parquet(f"{self.folder}/changes")
        return rows.groupBy("id").agg(F.max(F.struct("changed_at", "seq", "status")).alias("last")).select("id", "last.*")


def stream_status(changes: DataFrame, board: LiveStatus, folder: str) -> StreamingQuery:
    """Feed a stream of task changes into a :class:`LiveStatus` until all present input is read."""
    spark = changes.sparkSession
    given = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)           # read once, when the query starts
    try:
        return (
            status_changes(changes).writeStream.foreachBatch(board.absorb).outputMode("update")
            .option("checkpointLocation", f"{folder}/_progress").trigger(availableNow=True).start())
    finally:
        if given is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, given)

