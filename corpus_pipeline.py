"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of ``documents``:

1. toxicity: documents whose noisy-or score reaches the threshold go; the model learns from ``labels``.
2. simhash: of each group of near-duplicates (candidates by wide SimHash fingerprints in the Gray-order index, each link confirmed by an exact Jaccard similarity of 0.8
   or more on shingles of five words) the document of the smallest id stays.
3. secrets: values that look live (held by few owners) are masked in the text; copied examples stay.
4. mixing: each document is repeated as often as the mix takes it, in whole documents; one that it takes no word of goes.
5. tokens: every text is encoded and decoded; one row per row of the mix.

Every stage takes nulls in any column, empty and very long texts, equal and repeated rows, empty tables and further columns; each says below what it does with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kairoscope.llm import bpe, mixing, secrets, simhash, toxicity
from kairoscope.session import ensure_checkpoint_dir, ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold, all columns.  A null or empty text has the score of an empty sentence and stays; rows of one id are scored
    each for itself; without labels of both kinds every score is the share of toxic labels (none: 0); no rows give no rows."""
    ship(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the rows of the smallest id, all columns.  Texts without words (null, empty) are copies of each other; rows without an id stay; rows that
    share an id go or stay together, as one document; no rows give no rows."""
    ship(spark)
    return simhash.survivors(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with live values masked (overlapping ones once) and n_chars of the new text.  A null text stays null; a null source is an owner of its own;
    equal texts are masked alike, whatever their ids; no rows give no rows."""
    ship(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it.  Null sources are one source, the last; a text without words is never taken; rows that share an id are placed each
    for itself; no rows give no rows."""
    ship(spark)
    return mixing.repeated(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every row.  A null text is empty; no rows give no rows."""
    ship(spark)
    trip = bpe.round_trip(docs)
    return bpe.digests(trip)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: Hashing, training and backtracking are not SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared checkpoint folder and removed behind the next stage, or where a stage fails.

    The folder of the result goes when the session ends.
    """
    ensure_checkpoint_dir(spark)
    top = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None

    def remove(path: str) -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    try:
        for k, (name, stage) in enumerate(STAGES):
            path = f"{top}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(before)
            before = path
    except Exception:
        remove(top)
        raise
    top_path = spark._jvm.org.apache.hadoop.fs.Path(top)
    top_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(top_path)
    return docs


QUERIES = {"pipeline": run}
