"""Bounded, deterministic samples of labelled documents for classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.session import cut

#: Characters that a fit learns from of a text at most: what is gathered from the sample is bounded by it, whatever the corpus holds.
FIT_CHARS = 20_000


def held_out(id_col: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == rest, F.lit(True))


def thresholds(labelled: DataFrame, label: str, per_label: int) -> dict:
    """For each label, the share of its rows (in millionths of the hash range) that gives about ``per_label`` rows.

    All rows are counted; a label with fewer rows gives all of them.
    """
    counts = labelled.groupBy(label).agg(F.count("*").alias("n")).collect()
    return {r[label]: min(1_000_000, int(1_000_000 * per_label / r["n"]) + 1) for r in counts if r[label] is not None}


def sample(labelled: DataFrame, id_col: str, label: str, per_label: int) -> DataFrame:
    """The rows of ``labelled`` whose hashed id lies under their label's threshold: a map-side filter, the same on every run."""
    share = thresholds(labelled, label, per_label)
    if not share:
        return labelled.where(F.lit(False))
    cases = F.lit(0)
    for value, limit in sorted(share.items(), key=str):
        cases = F.when(F.col(label) == F.lit(value), limit).otherwise(cases)
    return labelled.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1_000_000)) < cases)


def labelled_ids(labels: DataFrame, id_col: str, label: str, modulus: int, rest: int) -> DataFrame:
    """One row per labelled id of the learning fold; an id with several labels has the largest."""
    rows = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, modulus, rest))
    return rows.groupBy(F.col(id_col).alias("fit_id")).agg(F.max(label).cast("int").alias("fit_label"))


def sampled_docs(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, per_label: int, id_col: str = "doc_id", text_col: str = "text", chars: int = FIT_CHARS) -> DataFrame:
    """fit_id, fit_label and text of about ``per_label`` documents a label, one text each, of at most ``chars`` characters.

    A label's sample is drawn from its documents that have a text of that length; where it has none, from the others, of which a stretch at a place drawn by hash is taken. Of
    several texts of one id that of the smallest hash counts.  The sampled ids are few by the bound, so they are broadcast and the texts stay where they are.
    """
    size = F.coalesce(F.length(F.col(text_col)), F.lit(0))
    told = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(F.max(size <= chars).alias("short"))
    known = cut(labelled_ids(labels, id_col, label, modulus, rest).join(told, F.col("fit_id") == F.col("doc")).select("fit_id", "fit_label", "short"))
    some = known.groupBy("fit_label").agg(F.max("short").alias("any_short"))  # a row a label
    ids = sample(known.join(F.broadcast(some), "fit_label").where(F.col("short") == F.col("any_short")), "fit_id", "fit_label", per_label)
    at = 1 + F.pmod(F.xxhash64(F.col(text_col)), F.greatest(size - chars, F.lit(1)))
    text = F.when(size <= chars, F.col(text_col)).otherwise(F.substring(F.col(text_col), at.cast("int"), F.lit(chars)))
    rows = docs.select(F.col(id_col).alias("doc"), text.alias("text"), (size <= chars).alias("fits"), F.xxhash64(F.col(text_col)).alias("h"))
    rows = rows.join(F.broadcast(ids), (F.col("doc") == F.col("fit_id")) & (F.col("fits") == F.col("short")))
    return rows.groupBy("fit_id", "fit_label").agg(F.min(F.struct("h", "text")).alias("m")).select("fit_id", "fit_label", "m.text")
