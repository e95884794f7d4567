import random

import corpus_pipeline as pipeline
from harvest.llm import decontaminate, near_duplicates, pii
from harvest.session import cut_lineage


def test_stages_take_effect(spark, real):
    sf_dir = "/root/testdata/sf0.001"
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]
    docs, seen = real, {}
    for name, stage in pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == real.columns and 0 < docs.count() <= real.count()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert seen["language"].count() >= 0.95 * real.count()
    assert near_duplicates.near_duplicates(seen["near_duplicates"]).where("NOT kept").count() == 0
    assert decontaminate.leaks(seen["decontamination"], bench).count() == 0
    left = pii.personal_data(seen["personal_data"]).selectExpr("sum(n_email + n_ip + n_card + n_phone)").first()[0]
    assert left == 0
    packed = seen["packing"]
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in seen["personal_data"].select("doc_id").collect()}


def test_stages_survive_awkward_tables(spark, awkward, tmp_path):
    rng = random.Random(1)
    bench = [(k, " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30))) for k in range(3)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (awkward, awkward.limit(0)):
        for name, stage in pipeline.STAGES:
            out = cut_lineage(stage(spark, docs, str(tmp_path)))
            ids = sorted((r.doc_id for r in out.select("doc_id").collect()), key=str)
            given = sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str)
            if name == "packing":                           # pieces of every row, all ids of each in one piece or more
                assert set(ids) == set(given)
            elif name == "language":                        # what is left after refusals, nothing else
                assert out.columns == docs.columns and set(ids) <= set(given) and out.exceptAll(docs).count() == 0
            elif name == "near_duplicates":                 # of the repeated id 5, a copy of 4, no row stays
                assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
                assert set(given) - set(ids) == ({5} if given else set()) and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
            else:                                           # no benchmark passage in them: all rows stay
                assert out.columns == docs.columns and ids == given


def test_own_names_of_the_stages_may_clash(spark, make):
    """Columns that are named as the operators name theirs stay as they are."""
    from pyspark.sql import functions as F

    from harvest.llm.sharding import place

    names = ["_drop", "_twice", "_at", "_own0", "_OWN1", "__slot", "__shard", "_row", "_text", "_new", "_spans", "_every", "base", "found"]
    text = "these are some words that come again and again in one text"
    docs = make([(1, text), (2, text), (3, "other words altogether"), (3, "other words altogether"), (None, "no id")]).withColumns(
        {n: F.lit(n) for n in names})
    for out, kept in ((near_duplicates.without_copies(docs), 3), (pii.redacted(docs), 5), (place(docs, ["a", "b"]), 5)):
        rows = out.collect()
        assert len(rows) == kept and all(r[n] == n for r in rows for n in names) and set(docs.columns) <= set(out.columns)


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is pipeline.run
    assert sum(n.startswith("op") and n[2].isdigit() for n in entry.queries()) == 13
