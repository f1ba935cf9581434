"""Fitted pipelines kept by day, next to the layers that they were fitted on."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from holdfast.sources.sinks import DAY


def save_model(model: PipelineModel, root: str, day: str) -> str:
    """Keep the model fitted on `day`; a second run of the day replaces it."""
    path = f"{root}/{DAY}={day}"
    model.write().overwrite().save(path)
    return path


def model_days(spark: SparkSession, root: str) -> list[str]:
    """Days with a model, oldest first. Works on any file system that Spark reaches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(path)]
    return sorted(n.partition("=")[2] for n in names if n.startswith(f"{DAY}="))


def load_model(spark: SparkSession, root: str, before: str) -> PipelineModel | None:
    """The newest model of a day before `before`; None where there is none."""
    days = [d for d in model_days(spark, root) if d < before]
    return PipelineModel.load(f"{root}/{DAY}={days[-1]}") if days else None
