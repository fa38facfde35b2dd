"""Datasets by task name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_catalog(path: str) -> dict:
    """A YAML file of task -> source kind -> list of dataset ids."""
    try:
        import yaml
    except ImportError as problem:  # pragma: no cover
        raise ImportError("pass the catalog as a dict where PyYAML is absent") from problem
    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle)


def dataset_path(catalog: dict, task: str, kind: str = "hf") -> str:
    """The first dataset of a task."""
    if task not in catalog:
        raise ValueError(f"unknown task {task!r}; the catalog has {sorted(catalog)}")
    listed = (catalog[task] or {}).get(kind) or [""]
    if not listed[0]:
        raise ValueError(f"the catalog names no dataset for task {task!r}")
    return listed[0]


def read_cataloged(
    spark: SparkSession, task: str, split: str, conf: dict | str, root: str = ""
) -> DataFrame:
    """One split of the task's first dataset, a parquet table partitioned by `split`."""
    catalog = read_catalog(conf) if isinstance(conf, str) else conf
    path = dataset_path(catalog, task)
    table = spark.read.parquet(f"{root.rstrip('/')}/{path}" if root else path)
    return table.where(F.col("split") == split).drop("split")
