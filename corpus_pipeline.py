"""Corpus pipeline over ``documents``: language ID, near-duplicate removal, mixing of sources, tokens.

Each stage takes what the one before it kept. Between stages the rows are written as Parquet and read again.

In every stage: an empty table gives an empty result; columns besides those that the stage reads travel along unread (all stages but the last), whatever their names; texts of any length are read whole; ties are
decided by fixed rules, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.llm import bpe, jaccard, langid, mixing
from ledgerwatch.llm.common import documents, stored

#: Documents of whose letters less was seen in the language's sample go: they are in a script that nothing was learned of.
LEAST_KNOWN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language, and name it in ``lang``.

    Null and empty texts, and texts without a letter, go. Repeated rows are judged alike. A null ``lang`` or doc_id is no reason to go.
    """
    model = langid.train(docs.filter(~langid.held_out()))
    kept = langid.tagged(docs, model).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("known") >= LEAST_KNOWN))
    return kept.select(F.col("row").withField("lang", F.col("lang_pred")).alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: that of the smallest doc_id (null last).

    Null texts and texts without words have no copies and stay. Of repeated rows one stays; a row stays beside another text with its doc_id.
    """
    return jaccard.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents, some twice, so that sources meet their target weights.

    A null source is a source of its own. Null and empty texts have no words to take and go. Repeated rows are rows of their own and are taken as often as any.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what was taken, a row for each row; null and empty texts have no tokens, and the other columns are left out."""
    return bpe.digests(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: No SQL expresses the language and token stages; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
