"""Tables in the shared folder, and what the driver lets go between them."""

from types import SimpleNamespace

import pytest

from gridloom import storage


@pytest.mark.parametrize("total, collected", [(374, 0), (376, 1), (750, 1)])
def test_a_grown_driver_heap_is_collected_before_a_table_is_written(total, collected):
    calls = []
    runtime = SimpleNamespace(totalMemory=lambda: total << 20, maxMemory=lambda: 750 << 20)
    system = SimpleNamespace(gc=lambda: calls.append("gc"))
    lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: runtime), System=system)
    java = SimpleNamespace(java=SimpleNamespace(lang=lang))
    conf = SimpleNamespace(get=lambda *_: "file:///tmp/none")
    context = SimpleNamespace(applicationId=f"app-{total}", getConf=lambda: conf)
    reader = SimpleNamespace(parquet=lambda path: path)
    spark = SimpleNamespace(_jvm=java, conf=conf, sparkContext=context, read=SimpleNamespace(schema=lambda s: reader))
    df = SimpleNamespace(sparkSession=spark, schema=None, write=SimpleNamespace(parquet=lambda path: calls.append("write")))
    storage.written(df, "t")
    assert calls == ["gc"] * collected + ["write"]


def test_written_tables_are_what_they_were(spark):
    assert [r.id for r in storage.written(spark.range(3), "ids").orderBy("id").collect()] == [0, 1, 2]
