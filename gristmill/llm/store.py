"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own where it is unset, which only a local master may have."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one operator call. Each is written once, so a lost executor costs a
    re-read and never a recomputation; ``drop`` frees those no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gristmill/{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._gristmill_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in tables:
            p = jvm.org.apache.hadoop.fs.Path(df._gristmill_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        gc.collect()
        jvm.System.gc()  # lets Spark's cleaner delete shuffle files of plans that are gone
