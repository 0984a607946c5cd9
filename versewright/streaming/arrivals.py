"""Files as they arrive: an extension, the batch rules over a stream of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versewright.functions import text as T


def stream(spark: SparkSession, folder: str, glob: str = "*.usfm") -> DataFrame:
    """(path, text, cleaned) of each new file; run with a checkpoint and trigger(availableNow=True)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    d = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    d = d.select("path", F.expr("make_valid_utf8(cast(content as string))").alias("text"))
    return T.clean_text(d, "text", None, "cleaned")
