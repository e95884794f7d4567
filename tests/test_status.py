"""Live status over batches, restarts and late changes."""

from datetime import datetime as D

import pyarrow.parquet as pq

from harvest.streaming import streams as S
from harvest.streaming.status import LiveStatus, _order, stream_status

SCHEMA = "id string, status string, changed_at timestamp, seq int"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, tmp_path):
    board = LiveStatus(spark, str(tmp_path / "board"))
    stream = S.read_stream(spark, str(tmp_path / "in"), files=1)
    stream_status(stream, board, str(tmp_path / "progress")).awaitTermination()
    return board


def stored(tmp_path, number):
    folder = tmp_path / "board" / "changes" / f"batch={number}"
    return sum(pq.read_metadata(f).num_rows for f in folder.glob("*.parquet"))


def test_batches_a_restart_and_late_changes(spark, tmp_path):
    put(spark, tmp_path / "in", [("a", "running", D(2024, 1, 2), 1), ("b", "running", D(2024, 1, 2), 2), ("a", "pending", D(2024, 1, 1), 0)])
    board = run(spark, tmp_path)
    assert board.counts().first().asDict() == {"task_count": 2, "pending": 0, "running": 2, "success": 0, "failed": 0}
    # a new query goes on from the stored state; what is older than the newest change is passed over
    put(spark, tmp_path / "in", [("a", "success", D(2024, 1, 3), 3), ("b", "pending", D(2024, 1, 1), 9), ("c", "skipped", None, None)])
    board = run(spark, tmp_path)
    assert board.counts().first().asDict() == {"task_count": 3, "pending": 0, "running": 1, "success": 1, "failed": 0}
    assert {(r.id, r.status) for r in board.table().collect()} == {("a", "success"), ("b", "running"), ("c", "skipped")}


def test_a_batch_writes_in_proportion_to_its_changes(spark, tmp_path):
    put(spark, tmp_path / "in", [(f"t{k}", "running", D(2024, 1, 1), k) for k in range(3_000)])
    run(spark, tmp_path)
    put(spark, tmp_path / "in", [("t7", "success", D(2024, 1, 2), 9), ("t8", "running", D(2023, 1, 1), 9)])
    board = run(spark, tmp_path)
    assert [stored(tmp_path, n) for n in (0, 1)] == [3_000, 1]
    assert board.counts().first().asDict() == {"task_count": 3_000, "pending": 0, "running": 2_999, "success": 1, "failed": 0}


def test_a_batch_that_is_stored_twice_counts_once(spark, tmp_path):
    board = LiveStatus(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "success", D(2024, 1, 1), 1, "running", False), ("b", "running", D(2024, 1, 1), 2, None, True)],
                                 f"{SCHEMA}, before string, first boolean")
    first = spark.createDataFrame([("a", "running", D(2023, 1, 1), 0, None, True)], rows.schema)
    for batch, number in ((first, 0), (rows, 1), (rows, 1)):
        board.absorb(batch, number)
    assert board.counts().first().asDict() == {"task_count": 2, "pending": 0, "running": 1, "success": 1, "failed": 0}


def test_changes_are_ordered_by_time_number_and_status():
    rows = [(D(2024, 1, 2), 1, "a"), (D(2024, 1, 1), 9, "z"), (None, 5, "a"), (D(2024, 1, 2), 1, "b"), (D(2024, 1, 2), None, "z")]
    assert max(rows, key=lambda r: _order(*r)) == rows[3] and min(rows, key=lambda r: _order(*r)) == rows[2]
