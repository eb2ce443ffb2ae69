"""The corpus pipeline, stage by stage, against what its stages promise."""

import corpus_pipeline
from keepsake.llm import decontaminate, queries
from keepsake.session import stage_table

from .test_operators import brute_groups, brute_hits

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage_table(stage(spark, docs, SF), "stage")
        after = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and after <= set(before) and after
        if name == "near duplicates":
            groups = brute_groups(list(before.items()), 5, 80)
            assert after == {d for d, n, least in groups if d == least or not n}
        if name == "decontamination":
            for doc_id, text in before.items():
                n, hit, _ = brute_hits(text, items, 13)
                assert (doc_id in after) == (not hit or 20 * hit < n)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == after


def test_empty_and_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).collect()


def test_registered():
    import __spark_entry__ as entry

    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())
    assert decontaminate.words_of("É-a B9".encode()) == ["É".encode(), b"a", b"b9"]
