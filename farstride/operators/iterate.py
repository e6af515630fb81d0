"""Intermediate tables of iterative jobs, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where none is set and Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Tables:
    """Stored tables of one job. Each cuts the lineage, survives lost executors, and goes once a later round has replaced it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.made = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", 0
        atexit.register(self.clear)

    def save(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_last(self, n: int) -> None:
        """Deletes all but the n tables saved last."""
        for i in range(1, self.made - n + 1):
            self.delete(f"{self.root}/{i}")

    def delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def clear(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before the interpreter
            self.delete(self.root)


def checkpointed(df: DataFrame) -> DataFrame:
    """df stored once, cut from its lineage."""
    return Tables(df.sparkSession).save(df)
