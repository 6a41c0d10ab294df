"""What is staged goes: within operators when they return, the rest when results are written."""

import os

import pytest

from weftline.llm import queries, staging
from weftline.llm.staging import scoped, stage

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


def held(spark):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{staging.work_dir(spark)}/weftline")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {x.getPath().getName() for x in fs.listStatus(at)} if fs.exists(at) else set()


def test_scopes(spark):
    staging.clean(spark)
    before = held(spark)

    @scoped
    def inner():
        stage(spark.range(5), "gone")
        return stage(spark.range(7), "inner")

    @scoped
    def outer():
        a, b = inner(), stage(spark.range(3), "outer")
        inner()
        return a.join(b, "id").filter("id > 0")

    out = outer()
    left = held(spark) - before
    assert sorted(n.split("-")[0] for n in left) == ["inner", "outer"]
    assert out.count() == 2
    with pytest.raises(ZeroDivisionError):
        scoped(lambda: stage(spark.range(3), "failed") and 1 / 0)()
    staging.clean(spark)
    assert held(spark) == before


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_nothing_stays_once_a_result_is_written(spark, name, tmp_path):
    staging.clean(spark)
    before, tables = held(spark), {t.name for t in spark.catalog.listTables()}
    out = queries.QUERIES[name](spark, FOLDER)
    out.write.parquet(f"{tmp_path}/out")
    rows = out.count()
    staging.clean(spark)
    assert held(spark) == before and {t.name for t in spark.catalog.listTables()} == tables
    assert spark.read.parquet(f"{tmp_path}/out").count() == rows
