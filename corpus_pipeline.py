"""From raw documents to training rows, in five stages.

Every stage reads all that the one before it kept, and writes its result as Parquet to the
shared folder: quality rules (rejected documents go, failed lines too), line dedup,
n-gram Jaccard join (the document of least id of each group stays), benchmark
decontamination (documents that hold an item go), SentencePiece encoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geosweep.llm import decontaminate, jaccard_join, line_dedup, quality_rules, sentencepiece_nbest
from geosweep.llm.frames import table, written

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("jaccard_join", jaccard_join.stage),
    ("decontaminate", decontaminate.stage),
    ("sentencepiece", sentencepiece_nbest.stage),
]

#: SQL expresses neither connected components of set similarity nor n-best segmentation;
#: tests/llm holds the stages against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
