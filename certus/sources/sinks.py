"""Writers: samples, predictions, tables of a run, and models with their metadata."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def _exists(read) -> bool:
    try:
        read()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def write_samples(samples: DataFrame, path: str) -> None:
    """One Parquet table by concept."""
    samples.write.mode("overwrite").partitionBy("concept").parquet(path)


def load_or_make(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``; made and written first if there is none, or one whose writer didn't end."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        write_samples(make(), path)
    return spark.read.parquet(path)


def write_predictions(predictions: DataFrame, path: str, fmt: str = "csv") -> None:
    """csv (with header), json or parquet; else ValueError."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported output format: {fmt}")
    writer = predictions.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.json(path) if fmt == "json" else writer.parquet(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a run (splits, results, analyses) in a folder of its name."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def save_metadata(spark: SparkSession, path: str, **metadata) -> None:
    """One row of JSON beside a model."""
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_metadata(spark: SparkSession, path: str) -> dict:
    """What ``save_metadata`` wrote; no features and threshold 0.5 if there is nothing."""
    if not _exists(lambda: spark.read.text(path)):
        return {"selected_features": [], "optimal_threshold": 0.5}
    return json.loads(spark.read.text(path).first()[0])
