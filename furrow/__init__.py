"""furrow: tabular data preparation expressed as Spark DataFrame jobs."""

from furrow.model import PipelineConfig

__all__ = ["PipelineConfig"]
