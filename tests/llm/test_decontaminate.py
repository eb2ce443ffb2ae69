"""Benchmarks of several blocks."""

from keepsake.llm import decontaminate


def test_blocks_are_not_chained(spark):
    docs = spark.createDataFrame(
        [(1, "x a b c d y e f g h", 5), (1, None, 6), (1, "x a b c d y e f g h", 5), (2, "a b", 7)],
        "doc_id long, text string, __row long")
    bench = spark.createDataFrame(
        [(f"i{k}", t) for k, t in enumerate(["a b c d", "e f g h", "b c d", "z z z z"])],
        "item_id string, text string")
    whole = decontaminate.scan(docs, bench, size=3)
    parts = decontaminate.scan(docs, bench, size=3, block_bytes=1)
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert parts.columns == whole.columns
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, whole.collect()))
