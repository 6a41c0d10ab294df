"""Pipelines over operators: building, running, loading, showing."""

from weftline.plans.config import PipelineConfig
from weftline.plans.hooks import LoggingHooks, NoOpHooks, PipelineHooks
from weftline.plans.loader import load_pipeline
from weftline.plans.loops import expand_loops
from weftline.plans.pipeline import TransformerPipeline

__all__ = ["LoggingHooks", "NoOpHooks", "PipelineConfig", "PipelineHooks", "TransformerPipeline", "expand_loops", "load_pipeline"]
