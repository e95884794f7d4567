"""What a run returns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class CrawlResult:
    """``items`` of the tasks that succeeded, one row per task, one row per run."""

    items: DataFrame
    tasks: DataFrame
    runs: DataFrame
