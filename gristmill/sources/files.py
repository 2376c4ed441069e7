"""Invoice files: a scan with an outcome for each file, as a batch or as a stream.

Files come from Spark's binaryFile source, so any store that Spark reads will do and
contents are read only where a query selects them. A file of another kind or one that
is not there is a row with its reason; none fails the scan. Spark lists no empty
files, so an empty one that was asked for counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import said
from ..operators.pages import EXTENSIONS, accepted

# Messages.
UNSUPPORTED = "unsupported file extension '{extension}'; accepted extensions are " + ", ".join(EXTENSIONS)
ABSENT = "no such file: '{path}'"


def _outcome(path: Column) -> list[Column]:
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))
    message = F.when(~accepted(path), said(UNSUPPORTED, extension=extension))
    return [F.when(message.isNull(), "accepted").otherwise("refused").alias("outcome"), message.alias("message")]


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime, content, outcome, message) of every file below ``root``, however deep."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", "modificationTime", "content", *_outcome(F.col("path")))


def scan_stream(spark: SparkSession, root: str, at_once: int = 1000) -> DataFrame:
    """The same as a stream: each file once, at most ``at_once`` a batch; progress is kept where the query's checkpoint is."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", at_once).load(root)
    return files.select("path", "length", "modificationTime", "content", *_outcome(F.col("path")))


def requested(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(path, outcome, message) of the paths asked for; those that are not there are ``missing``. Paths are compared as the scan gives them."""
    found = files.select(F.col("path").alias("_path"), "outcome", "message")
    rows = wanted.select("path").distinct().join(found, F.col("path") == F.col("_path"), "left")
    return rows.select("path", F.coalesce("outcome", F.lit("missing")).alias("outcome"), F.when(F.col("_path").isNull(), said(ABSENT, path=F.col("path"))).otherwise(F.col("message")).alias("message"))
