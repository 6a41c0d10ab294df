"""Pipelines over streams."""

from weftline.streaming.runner import run_per_batch, stream_through

__all__ = ["run_per_batch", "stream_through"]
