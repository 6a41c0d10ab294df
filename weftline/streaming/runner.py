"""Pipelines over streaming frames.

A pipeline whose steps only extend the plan runs on a stream as it is. Steps that run a job, sort, or look over windows of rows
need whole frames; ``run_per_batch`` gives them those, one micro-batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftline.operators import AggregateOverWindow, AssertCount, AssertNotEmpty, CpuInfo, DataFrameMethod, GroupBy, LagOverWindow, LogDataSkew, Persist, Pivot, SparkDropDuplicates
from weftline.plans.nodes import ForkNode, TransformerNode
from weftline.plans.pipeline import TransformerPipeline

#: Operators that cannot be part of a streaming plan.
WHOLE_FRAMES = (AggregateOverWindow, AssertCount, AssertNotEmpty, CpuInfo, DataFrameMethod, LagOverWindow, LogDataSkew, Persist, Pivot)


#: Operators that remember all keys they have seen, unless a watermark lets old ones go.
STATEFUL = (GroupBy, SparkDropDuplicates)
_WATERMARK = "spark.watermarkDelayMs"


def stream_through(pipeline: TransformerPipeline, stream: DataFrame, unbounded_state: bool = False) -> DataFrame:
    """The stream after the pipeline; ValueError where a step needs whole frames, or groups or drops duplicates of a stream without a watermark.

    The state of the latter grows for ever; ``unbounded_state`` says that it may, as where the keys are known to be few.
    """
    if not stream.isStreaming:
        raise ValueError("not a streaming dataframe")
    bounded = unbounded_state or any(_WATERMARK in f.metadata for f in stream.schema.fields)
    for n in pipeline._ir.walk():
        if isinstance(n, TransformerNode) and isinstance(n.transformer, WHOLE_FRAMES):
            raise ValueError(f"'{n.name}' needs whole frames; use 'run_per_batch'")
        if isinstance(n, TransformerNode) and isinstance(n.transformer, STATEFUL) and not bounded:
            raise ValueError(f"the state of '{n.name}' would grow for ever: give the stream a watermark, or 'unbounded_state'")
        if isinstance(n, ForkNode) and (n.skip_if_empty or n.config.get("skip_if_empty")):
            raise ValueError("'skip_if_empty' needs whole frames; use 'run_per_batch'")
    return pipeline.run(stream, verbose=False)


def run_per_batch(pipeline: TransformerPipeline, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Starts a query that runs the pipeline on every micro-batch and gives the result to ``sink`` with the batch's number.

    A batch may come again after a failure, with the same number, so that a sink that keeps numbers sees each batch once.
    """
    out = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(pipeline.run(df, verbose=False), n))
    return (out.trigger(**trigger) if trigger else out).start()
