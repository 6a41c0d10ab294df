import pytest

from weftline import TransformerPipeline
from weftline.operators import AddLiterals, AssertNotEmpty, Filter, GroupBy, SparkDropDuplicates, WithColumns
from weftline.streaming import run_per_batch, stream_through


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "in")
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).write.mode("append").parquet(path)
    return spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 4).parquet(path)


def test_stream_through(spark, source, tmp_path):
    p = TransformerPipeline([Filter(input_col="id", operator="lt", value=25), AddLiterals(data=[{"alias": "x", "value": 1}])])
    q = stream_through(p, source).writeStream.format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*), sum(x) from out").first() == (25, 25)
    with pytest.raises(ValueError):
        stream_through(TransformerPipeline([AssertNotEmpty()]), source)
    with pytest.raises(ValueError):
        stream_through(p, spark.range(1))


def test_run_per_batch(source, tmp_path):
    seen = {}
    p = TransformerPipeline([AssertNotEmpty(), AddLiterals(data=[{"alias": "k", "value": 1}]), GroupBy(groupby_columns="k", aggregations={"sum": "id"})])
    q = run_per_batch(p, source, lambda df, n: seen.__setitem__(n, df.first().id), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen.values()) == sum(range(30)) and len(seen) > 1


def test_state_needs_a_bound(source):
    for step in (GroupBy(groupby_columns="id", aggregations={"max": "id"}), SparkDropDuplicates()):
        p = TransformerPipeline([step])
        with pytest.raises(ValueError, match="grow for ever"):
            stream_through(p, source)
        assert stream_through(p, source, unbounded_state=True).isStreaming
        timed = source.selectExpr("id", "timestamp_seconds(id) AS t").withWatermark("t", "1 minute")
        assert stream_through(p, timed).isStreaming
    with pytest.raises(ValueError, match="run_per_batch"):
        stream_through(TransformerPipeline([WithColumns(columns="id", method="cum_sum", kwargs={"order_by": "id"})]), source)
