"""Written tables: where they are, that they can be read again, and how they go."""

import os

from millrace.config import EngineConfig
from millrace.operators import dissect as D
from millrace.operators.assemble import dissected_json
from millrace.operators.observables import observables, place_cuts
from millrace.queries import _injected
from millrace.sources.registries import for_config
from millrace.workspace import READ_ROWS, Written, partitions, release, shared_dir, written


def test_written_tables(spark):
    d = spark.range(10)
    t = Written(d, "x")
    assert t.path.startswith(shared_dir(spark)) and t.df.dtypes == d.dtypes and t.df.count() == 10
    folder = t.path.removeprefix("file:")
    t.drop()
    assert not os.path.exists(folder)
    again = written(d, "y")
    assert again.count() == 10
    release(spark)
    assert not os.path.exists(os.path.dirname(folder))


def test_partitions(spark):
    assert partitions(spark) >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_nested_rows_are_not_read_in_columns(spark):
    rows = spark.createDataFrame([(str(n), bytearray(b"Subject: x\r\n\r\nsee https://example.org/%d" % n)) for n in range(3)], "msg_key string, content binary")
    d = written(D.dissect(rows, fields=("mentions",)), "few_messages")
    plan = d.selectExpr("explode(messages)")._jdf.queryExecution().executedPlan().toString()
    assert "Batched: false" in plan and d.count() == 3


def test_observables_are_dealt_once(spark, sf):
    typed = written(_injected(spark, sf), "injected")
    for made, reads in ((observables(typed), 1), (place_cuts(typed, 3), 2)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == plan.count("REPARTITION_BY_NUM") == reads


def test_texts_are_read_few_at_once(spark, sf):
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == READ_ROWS < 4096


def test_no_tools_no_join(spark):
    rows = spark.createDataFrame([("a", bytearray(b"Subject: x\r\n\r\ny"))], "msg_key string, content binary")
    d = written(D.dissect(rows), "one_message")
    j = dissected_json(d, for_config(EngineConfig()))
    plan = j._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (msg_key" not in plan
    assert '"tools":{"extractor":"disabled","renderer":"disabled"}' in j.first()["json"]
