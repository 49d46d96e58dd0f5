"""New heads of a repository as a stream.

Each head is a file that is renamed into ``heads`` and never changed, so the file
source of Structured Streaming sees each once, and its checkpoint says how far a
consumer has come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.repository import Repository


def head_stream(repo: Repository, files_per_batch: int = 100) -> DataFrame:
    """``number, commit``: a row for each head, from the first on."""
    lines = repo.spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(f"{repo.path}/heads")
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)$", 1).cast("long")
    return lines.select(number.alias("number"), F.trim("value").alias("commit"))
