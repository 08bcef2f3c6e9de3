import uuid

import pytest
from pyspark.sql import functions as F

from netweir.llm.common import Bitmap, one_row_each, row_count, small_side, staged, staging
from netweir.llm.simhash import components


@pytest.fixture
def jobs(spark):
    """Counts the jobs since it was last asked."""
    context, asked = spark.sparkContext, []

    def count():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        asked.append(uuid.uuid4().hex)
        context.setLocalProperty("spark.jobGroup.id", asked[-1])
        return len(context.statusTracker().getJobIdsForGroup(asked[-2])) if len(asked) > 1 else 0

    count()
    yield count
    context.setLocalProperty("spark.jobGroup.id", None)


def test_written_tables_are_read_and_counted_without_jobs(spark, jobs):
    rows = spark.range(100).select(F.col("id").alias("node"), F.struct(F.lit(1).alias("x")).alias("s"))
    with staging(spark) as stage:
        for write in (stage, staged):
            out = write(rows)
            assert jobs() == 1
            assert row_count(out) == 100 and "broadcast" in small_side(out, 8)._jdf.queryExecution().analyzed().toString()
            assert small_side(out, 8, 799) is out and jobs() == 0
            assert out.dtypes == rows.dtypes and {r.node for r in out.collect()} == set(range(100))
            assert row_count(out.where("node < 7")) == 7
            jobs()


def test_written_tables_without_rows(spark):
    for rows in (spark.range(0), spark.range(9).where("id > 9"), spark.range(9).groupBy("id").count().where("count > 1")):
        out = staged(rows)
        assert row_count(out) == 0 and out.count() == 0 and out.dtypes == rows.dtypes
        assert not Bitmap(out.select(F.col("id").alias("hash"))).words.any()


def test_rounds_of_components_take_no_job_for_their_count(spark, jobs):
    links = staged(spark.createDataFrame([(1, 2), (2, 3), (7, 9), (5, 5)], "a long, b long"))
    with staging(spark) as stage:
        between = []
        jobs()

        def noted(frame):
            between.append(jobs())
            out = stage(frame)
            jobs()
            return out

        roots = components(links, noted)
        assert [*between, jobs()] == [0] * (len(between) + 1) and len(between) >= 2
        assert {(r.node, r.root) for r in roots.collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}


def test_one_row_of_each_key_counts_once(spark, jobs):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c")], "id long, text string")
    keyed = staged(docs.where("id < 3").groupBy("id").agg(F.count(F.lit(1)).alias("__rows")))
    jobs()
    out = one_row_each(docs, keyed, ["id"])
    assert jobs() <= 2
    assert sorted((r.id, r.text) for r in out.collect()) == [(1, "a"), (2, "b")]
