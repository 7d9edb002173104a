"""Artifacts: JSON with sorted keys, guarded against overwriting what has elapsed."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import SparkSession

from ..operators.record import require_open


def write_json(spark: SparkSession, path: str, artifact: dict, overwrite: bool = True) -> None:
    """One small file, through Hadoop's file systems."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(fs_path, overwrite)
    out.write(bytearray(json.dumps(artifact, sort_keys=True, indent=1, default=str).encode()))
    out.close()


def write_forecast(spark: SparkSession, folder: str, as_of: dt.date, artifact: dict, shortest: int, run: dt.date) -> str:
    """The dated log of a forecast; one whose shortest horizon can have elapsed is not rewritten."""
    path = f"{folder}/{as_of.isoformat()}.json"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        require_open(as_of, shortest, run)
    write_json(spark, path, artifact)
    return path


def write_skip(spark: SparkSession, folder: str, day: dt.date, reason: str) -> str:
    path = f"{folder}/{day.isoformat()}.skip.json"
    write_json(spark, path, {"date": day.isoformat(), "reason": reason})
    return path
