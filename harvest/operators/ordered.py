"""Running values over ordered groups of any size.

A window over a group puts the whole group into one task. Where the largest group is small
(its size is counted first) that is fine. Otherwise the rows are range-partitioned by group and
order, so one group spreads over many slots; each slot computes its own running value and adds
what the slots before it hold. Both ways give the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvest.session import cut_lineage

ROWS_IN_ONE_TASK = 1_000_000
SETTING = "harvest.rowsInOneTask"       # session setting that overrides the number


class OrderedGroups:
    """Rows of ``df`` laid out by group and order; ``order`` must be unique within a group."""

    def __init__(self, df: DataFrame, group: list[str], order: list[str],
                 rows_in_one_task: int | None = None, written: bool = False):
        if rows_in_one_task is None:
            rows_in_one_task = int(df.sparkSession.conf.get(SETTING, str(ROWS_IN_ONE_TASK)))
        rows = df if written else cut_lineage(df)      # ``written``: already a stored table
        largest = rows.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
        self.group, self.order, self.spread = group, order, largest > rows_in_one_task
        if self.spread:
            # the slot number is written down: it must not change when a task runs again
            self.rows = cut_lineage(
                rows.repartitionByRange(*group, *order)
                .withColumn("_slot", F.spark_partition_id()))
        else:
            self.rows = rows.withColumn("_slot", F.lit(0))

    def running(self, name: str, value: Column, how: str = "sum") -> "OrderedGroups":
        """Add ``name``: the running ``sum`` or ``max`` of ``value`` up to and including each row."""
        fold = {"sum": F.sum, "max": F.max}[how]
        within = Window.partitionBy("_slot", *self.group).orderBy(*self.order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        rows = self.rows.withColumn("_value", value)
        out = rows.withColumn(name, fold("_value").over(within)).drop("_value")
        if self.spread:
            before = Window.partitionBy(*self.group).orderBy("_slot").rowsBetween(
                Window.unboundedPreceding, -1)
            # one row per slot and group: as many rows as partitions, not as rows
            earlier = (
                rows.groupBy(*self.group, "_slot").agg(fold("_value").alias("_total"))
                .withColumn("_before", fold("_total").over(before)).drop("_total"))
            keys = [*self.group, "_slot"]
            earlier = earlier.select(*[F.col(k).alias(f"_e_{k}") for k in keys], "_before")
            same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in keys])
            joined = out.join(earlier, same).drop(*[f"_e_{k}" for k in keys])
            whole = (
                F.col(name) + F.coalesce("_before", F.lit(0)) if how == "sum"
                else F.greatest(F.col(name), F.col("_before")))
            out = joined.withColumn(name, whole).drop("_before")
        self.rows = out
        return self

    def frame(self) -> DataFrame:
        return self.rows.drop("_slot")


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str,
                rows_in_one_task: int | None = None) -> DataFrame:
    """Position 1, 2, … of each row within its group."""
    return OrderedGroups(df, group, order, rows_in_one_task).running(
        name, F.lit(1).cast("long")).frame()
