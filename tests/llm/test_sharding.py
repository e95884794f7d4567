from collections import Counter

import pytest

from harvest.llm.sharding import filled_table, place, write_shards

NAMES = [f"n{i}" for i in range(7)]


def test_slots_are_shared_evenly_and_few_move():
    full, less = filled_table(NAMES, 10_007), filled_table(NAMES[:-1], 10_007)
    counts = Counter(full)
    assert max(counts.values()) - min(counts.values()) <= 1
    moved = sum(a != b for a, b in zip(full, less) if a != 6)
    assert moved < 0.1 * len(full)


def test_each_turn_claims_the_first_free_slot():
    import hashlib

    size, orders = 101, []
    for name in NAMES:
        d = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "little") % size, int.from_bytes(d[8:16], "little") % (size - 1) + 1
        orders.append([(offset + i * skip) % size for i in range(size)])
    table = {}
    for turn in range(size):
        slot = next(s for s in orders[turn % len(NAMES)] if s not in table)
        table[slot] = turn % len(NAMES)
    assert filled_table(NAMES, size) == [table[s] for s in range(size)]


def test_bad_arguments():
    for shards, size in ((NAMES, 100), ([], 101), (["a", "a"], 101), (NAMES, 4_000_037)):
        with pytest.raises(ValueError):
            filled_table(shards, size)


def test_rows_follow_the_table(spark, awkward):
    table = filled_table(NAMES, 101)
    rows = place(awkward, NAMES, size=101).collect()
    assert len(rows) == awkward.count()
    assert all(r.shard == NAMES[table[r.slot]] for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1
    assert place(awkward.limit(0), NAMES, size=101).count() == 0
    many = place(spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "id AS other"), NAMES, size=101)
    assert max(r["count"] for r in many.groupBy("shard").count().collect()) < 4_000


def test_shards_are_written_and_read(spark, real, tmp_path):
    write_shards(real, str(tmp_path / "out"), NAMES)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == real.count() and back.select("doc_id").distinct().count() == real.count()


def test_nothing_is_shuffled(real):
    plan = place(real, NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
