"""Weftline: declarative DataFrame pipelines on Spark."""

from weftline.plans import LoggingHooks, NoOpHooks, PipelineConfig, TransformerPipeline, load_pipeline
from weftline.sources import Storage, storage

__version__ = "0.1.0"
__all__ = ["LoggingHooks", "NoOpHooks", "PipelineConfig", "Storage", "TransformerPipeline", "load_pipeline", "storage"]
