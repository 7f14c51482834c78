"""What tasks leave behind in the processes that run them."""

import pathlib

from pyspark.sql import functions as F

from lodestack.llm import common, near_dups, quality_rules


def direct_mb(spark):
    kind = spark._jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean")
    pools = spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(kind)
    return sum(p.getMemoryUsed() for p in pools if p.getName() == "direct") / 1e6


def test_reading_tables_leaves_no_buffers(spark):
    ws = common.Workspace(spark, "test", codec="none")
    text = F.concat(*[F.sha2(F.concat("id", F.lit(f"-{k}")), 256) for k in range(16)])
    table = ws.save(spark.range(100_000).repartition(2).select("id", text.alias("text")), "texts")
    before = direct_mb(spark)
    assert table.agg(F.sum(F.length("text"))).first()[0] == 102_400_000
    assert direct_mb(spark) - before < 25


def test_written_tables_leave_no_shuffles_and_one_file_each(spark):
    before = spark.conf.get(common.CLEANUP)
    ws = common.Workspace(spark, "test", codec="none")
    held = lambda: {p.name for root in map(pathlib.Path, roots) for p in root.rglob("shuffle_*.data")}
    roots = spark._jvm.org.apache.spark.util.Utils.getConfiguredLocalDirs(spark.sparkContext._jsc.sc().conf())
    had = held()
    ws.save(spark.range(1000).repartition(4, "id"), "rows")
    assert held() <= had and spark.conf.get(common.CLEANUP) == before
    assert not list(pathlib.Path(ws.root.removeprefix("file:")).rglob("*.crc"))


class Tasks:
    """A table that gives back the task it is asked to run."""

    def __init__(self, schema=None):
        self.schema = schema

    def select(self, *_):
        return self

    def mapInArrow(self, task, _):
        return task


def test_tasks_that_encode_nothing_drop_what_others_remembered(spark, make, monkeypatch):
    schema = make([]).schema
    for task in (near_dups._signed(Tasks(), 5), quality_rules.with_counts(Tasks(schema), ["doc_id"])):
        monkeypatch.setattr(common, "_MEMOS", {("vocabulary", 1): object()})
        assert list(task(iter([]))) == [] and not common._MEMOS
