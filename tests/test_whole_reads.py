"""Nothing is recorded for a project that was not read whole, and reads are balanced by bytes."""

from pyspark.sql import functions as F

from keepsake.operators import digests, verify
from keepsake.plans import jobs

FILES = "project string, rel_path string, size bigint, mtime_ns bigint"
READ = "project string, rel_path string, fmt string, digest string, status string"
ORIGIN = "project string, rel_path string, fmt string, digest string, size bigint"


def _nothing(spark, schema):
    return spark.createDataFrame([], schema)


def _files(spark):
    return spark.createDataFrame(
        [("p", "a", 1, 1), ("p", "b", 1, 1), ("p", "c", 1, 1), ("q", "a", 1, 1)], FILES
    )


def _history(spark):
    return _nothing(
        spark, "project string, rel_path string, fmt string, digest string, generation_no int"
    )


def _expected(spark):
    from keepsake.operators import origin

    rows = spark.createDataFrame(
        [("z", "A.mhl", 1, "x", "md5", "00", 1)],
        "project string, manifest string, position int, name string, tag string, value string, size bigint",
    )
    return origin.merge_origin(origin.normalise_origin(rows)).limit(0)


def test_seal_refuses_what_was_not_read(spark):
    read = spark.createDataFrame(
        [("p", "a", "xxh128", "1", "ok"), ("p", "b", "xxh128", None, "error"),
         ("q", "a", "xxh128", "2", "ok"), ("q", "gone", "xxh128", "3", "ok")], READ)
    got = jobs.seal(_files(spark), read, _expected(spark), _history(spark))
    out = {r.project: r for r in got.outcome.collect()}
    assert (out["p"].state, out["p"].writes_generation) == ("error", False)
    assert out["p"].review_reason == "2 files without a digest: b, c"
    assert (out["q"].state, out["q"].writes_generation) == ("sealed", True)
    assert [(r.project, r.rel_path) for r in got.entries.collect()] == [("q", "a")]
    assert [(r.project, r.digest) for r in got.sealed.collect()] == [("q", "2")]


def test_an_unread_file_is_not_corrupt(spark):
    sealed = _files(spark).withColumn("digest", F.lit("1"))
    current = sealed.withColumn(
        "digest", F.when((F.col("project") == "p") & (F.col("rel_path") == "b"), None).otherwise("1")
    )
    status = {
        (r.project, r.rel_path): r.status
        for r in verify.compare_for_verify(sealed, current).collect()
    }
    assert status["p", "b"] == "unread" and status["p", "a"] == "ok"
    result, _ = jobs.verify_projects(sealed, current, _history(spark))
    out = {r.project: r for r in result.outcome.collect()}
    assert (out["p"].state, out["p"].stamps_verified) == ("error", False)
    assert out["q"].state == "sealed" and result.review_items.count() == 0
    assert {r.project for r in result.entries.collect()} == {"q"}


def test_the_reader_is_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [("p", n, "xxh128", "1", "ok") for n in "abc"] + [("q", "a", "xxh128", "2", "ok")]

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    read = spark.createDataFrame(rows, READ).mapInPandas(count, READ)
    got = jobs.seal(_files(spark), read, _expected(spark), _history(spark))
    for df in (got.entries, got.sealed, got.review_items, got.outcome):
        df.collect()
    assert seen.value == 4


def test_no_task_reads_more_than_a_bucket_and_a_file(spark):
    gib = 1024**3
    rows = [("p", f"big/{i:03d}", 100 * gib, 1) for i in range(40)]
    rows += [("p", f"small/{i:05d}", 10, 1) for i in range(4000)]
    placed = digests.balance_by_bytes(spark.createDataFrame(rows, FILES), bucket_bytes=64 * gib)
    per_task = (
        placed.groupBy(F.spark_partition_id().alias("task"))
        .agg(F.sum("size").alias("bytes"), F.countDistinct("bucket").alias("buckets"))
        .collect()
    )
    assert max(r.bytes for r in per_task) <= 164 * gib
    assert all(r.buckets == 1 for r in per_task) and len(per_task) >= 40
