"""A corpus pipeline: toxic and low-quality documents go, near-duplicates fold, sources are mixed, and what stays is encoded.

Each stage takes the rows that its predecessor kept, written as Parquet and read again, and decides by them alone. All but
the last return the columns of documents. A null text counts as empty in every stage, and columns besides doc_id, text
and source are carried along unread, whatever their names. Rows that repeat count each on its own until near-duplicates
fold, of which the least doc_id stays (null ids last, told apart by their text; of rows that can't be told apart one
stays); mixing may then take a row twice. Empty tables give no rows, and without labels no document is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vertexloom.llm import byte_bpe, mixing, quality, simhash, toxicity
from vertexloom.llm._common import drop_table, read_table, scratch_path
from vertexloom.llm.queries import _vocabulary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def fold_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.Mix().apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digest_documents(docs, _vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("quality", reject_low_quality),
    ("near_duplicates", fold_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: No SQL trains the classifiers or follows the fingerprints' links.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    base = scratch_path(spark, "corpus-pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        if k:  # what the stage before wrote has been read for the last time
            drop_table(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
