"""A training corpus from raw documents: five stages, each a corpus operator over all that the one before kept.

language   documents without a recognizable language go
lines      later repeats of runs of lines are deleted; documents that held nothing else go
minhash    one document of each class of near-duplicates (smallest id) stays
mix        sources are brought to their target weights: rows go, or come several times
pieces     SentencePiece ids of each row, checked by decoding

Every stage but the last returns the columns of its input. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from radmine.llm import langid, lines, minhash, mixing, pieces
from radmine.llm.common import stored

STAGES = [
    ("language", lambda spark, docs, sf_dir: langid.stage(docs)),
    ("lines", lambda spark, docs, sf_dir: lines.stage(docs)),
    ("minhash", lambda spark, docs, sf_dir: minhash.stage(docs)),
    ("mix", lambda spark, docs, sf_dir: mixing.stage(docs)),
    ("pieces", lambda spark, docs, sf_dir: pieces.stage(docs)),
]

#: Trained filters, components and BPE merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir; what each stage before returns is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
