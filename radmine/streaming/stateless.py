"""Streams of records: the operators that look at one record at a time need no state or watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import normalized
from ..schema import RECORD, facts


def read_records_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Records of JSON-lines files as they arrive in a folder."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", max_files).json(path)


def normalized_stream(records: DataFrame) -> DataFrame:
    """Flat normalized facts of a stream of records."""
    return normalized(facts(records)).where(F.col("record_id").isNotNull())
