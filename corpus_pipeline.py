"""A pipeline of training-data stages over ``documents``: toxic texts go, near copies go but for one, secrets are masked,
sources are mixed to their weights, and what is left is turned into token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept; what it returns is written as
Parquet and read again as the next one's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteloom.llm import bpe, jaccard, mixture, secrets, toxicity
from siteloom.llm.common import save, table
from siteloom.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger finds toxic go. It learns from the labels of rows that are not held out."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked at 0.8 or more on shingles of five words, the one with the smallest id stays."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix of sources takes it, once more, twice or not at all."""
    return mixture.repeats(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, their number, and the digests of the ids and of the text they decode to."""
    ranks, pattern = vocabulary(spark)
    return bpe.round_trip(docs, ranks, pattern, digests=True, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixture", mix_sources),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The trained tagger, the weighted draw and the tokenizer are not expressible in SQL; tests hold the pipeline against
#: brute-force versions.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
