"""From documents to packed training sequences: five stages, each one an operator of ``rinse.llm``.

1. A quality classifier fitted on ``labels`` rejects documents.
2. Of each group of near-duplicates (five words, similarity 0.8) the smallest doc_id stays.
3. Strings of 240 bytes that occur more than once are cut out; documents stay.
4. Documents that hold enough of an item of ``benchmark`` go.
5. What is left is packed into sequences of 4096 ids.

Every stage but the last returns the columns of ``documents``. Columns with other names pass; null
and empty texts are scored by their structure, linked with nothing and packed as one id.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinse.llm import quality
from rinse.llm.decontaminate import decontaminate
from rinse.llm.minhash import deduplicate
from rinse.llm.packing import pack_documents
from rinse.llm.suffix_dedup import without_repeats
from rinse.session import configure, scratch

# the passages to be found have over 50 words; the shortest of these take about 240 bytes
REPEAT, REPEAT_GRAM = 240, 80


def _ready(spark: SparkSession) -> None:
    """Python workers find the package next to this file."""
    environment = spark.sparkContext.environment
    here = os.path.dirname(os.path.abspath(__file__))
    paths = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if here not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, here])
    configure(spark)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    known = [name for name in ("n_chars",) if name in docs.columns]
    model = quality.train(docs, _table(spark, sf_dir, "labels"), metadata=known)
    return quality.keep_good(docs, model, metadata=known)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return deduplicate(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    cut = without_repeats(docs, REPEAT, REPEAT_GRAM)
    if "n_chars" in cut.columns:
        n_chars = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return cut


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return pack_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-dedup", near_deduplicated),
    ("suffix-array dedup", without_repeated_passages),
    ("decontamination", decontaminated),
    ("best-fit packing", packed),
]

# the first stages have no SQL: a fitted model, signatures, byte strings, a tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written before the next one reads it."""
    _ready(spark)
    docs = _table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = scratch(spark, f"stage-{number}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
