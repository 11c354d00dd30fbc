"""Copies in the shared folder."""

from threading import Event, Thread

from pyspark.sql import functions as F

from corpusmill.llm.shared import SHUFFLE_CLEANUP, saved, settled


def test_settled_keeps_its_result_alone(spark):
    before, inner = spark.conf.get(SHUFFLE_CLEANUP, None), []

    def make():
        inner.append(saved(spark.range(10), "inner"))
        return settled(spark, lambda: saved(inner[0], "deep").groupBy((F.col("id") % 2).alias("k")).count(), "middle")

    out = settled(spark, make, "outer")
    assert sorted(map(tuple, out.collect())) == [(0, 5), (1, 5)]
    place = spark._jvm.org.apache.hadoop.fs.Path(inner[0].inputFiles()[0])
    assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == before


def test_settled_leaves_other_threads_alone(spark):
    """Another thread's copy, saved while settled works, stays."""
    before, other, go, done = spark.conf.get(SHUFFLE_CLEANUP, None), [], Event(), Event()

    def work():
        go.wait(60)
        other.append(saved(spark.range(7), "other"))
        done.set()

    def make():
        first = saved(spark.range(5), "own")
        go.set()
        assert done.wait(120)
        return first

    thread = Thread(target=work)
    thread.start()
    assert settled(spark, make, "settled").count() == 5
    thread.join()
    assert other[0].count() == 7
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == before
