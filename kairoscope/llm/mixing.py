"""Mixing sources to target weights by hash-random keys, prefix sums and exact cuts.

Targets.  Sources in order of code point (null last) weigh 5, 2, 1, 5, 2, 1 ...; together they
get ``share`` times the size of the corpus.  A target stops at ``most`` times its source's size and
what it leaves is shared again by weight: that is the level ``x`` with
``sum(min(most * size, weight * x)) = share * total``, found with one prefix sum over the sources
in order of ``most * size / weight``.

Cuts.  Every document has the key ``md5(doc_id)``, which is uniform, so its leading hexadecimal
digits deal each source into ranges of equal expected size; a hot source has as many ranges as any
other, so no task holds a source.  Sizes are summed by (source, range) before any row moves, a
prefix sum over the ranges gives where each begins, and a second one inside the range gives where
each document begins.  With the budget ``floor(target)``, a source runs ``budget // source_size``
whole epochs and then takes documents in key order up to exactly ``budget % source_size`` words; the
last one counts in part.

Nulls and ties.  A null text has size 0; null sources form one source of their own, the last; rows
that share a doc_id are ordered by size, and equal rows stand for one another.  A source without
words has target 0 and takes none.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.session import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Hexadecimal digits of the key that name a range: 16 ** 3 ranges in each source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """The number of maximal runs of characters that are not white space (ASCII 9 to 13 and 32)."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(trimmed, " \t\n\x0b\x0c\r", "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: mix_none, mix_source, source_size, target.  ``sizes`` has mix_none (no source), mix_source and size."""
    name = ["mix_none", "mix_source"]
    total = sizes.groupBy(*name).agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))  # a row a source
    turn = (F.row_number().over(every.orderBy(*name)) - 1) % len(weights)
    weighted = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    weighted = weighted.withColumn("ratio", F.col("source_size") / F.col("weight"))
    before = every.orderBy("ratio", *name).rowsBetween(Window.unboundedPreceding, -1)
    levels = weighted.select(
        "*",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full_size"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open_weight"),
        F.sum("source_size").over(every).alias("all_size"),
    ).withColumn("level", (F.lit(share) * F.col("all_size") - F.lit(most) * F.col("full_size")) / F.col("open_weight"))
    # The level is that of the first source that isn't full under its own level.
    first_open = F.min(F.when(F.lit(most) * F.col("ratio") >= F.col("level"), F.struct("ratio", *name, "level"))).over(every)
    return levels.withColumn("level", first_open["level"]).select(
        *name,
        "source_size",
        F.least(F.lit(most) * F.col("source_size"), F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"),
    )


def placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, most: float, carry: bool) -> DataFrame:
    """mix_id, size, source_size, target, taken and epochs of each row, and the row itself in ``mix_row`` if it is carried."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    deal = ["mix_none", "mix_source", "mix_range"]
    keyed = docs.select(
        F.col(source_col).isNull().alias("mix_none"),
        F.coalesce(F.col(source_col), F.lit("")).alias("mix_source"),
        F.substring(key, 1, RANGE_DIGITS).alias("mix_range"),
        F.col(id_col).alias("mix_id"),
        word_count(F.col(text_col)).alias("size"),
        key.alias("mix_key"),
        *([F.struct(*docs.columns).alias("mix_row")] if carry else []),
    )
    if not carry:
        keyed = cut(keyed)  # a few numbers a row: words are counted once
    by_range = keyed.groupBy(*deal).agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy(*deal[:2]).orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = by_range.withColumn("range_begin", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).drop("range_size")
    targets = source_targets(by_range.select(*deal[:2], F.col("range_size").alias("size")), weights, share, most)
    # The join and the window deal by the same columns, so the rows move once.
    joined = keyed.join(begins.join(targets, deal[:2]), deal)
    inside = Window.partitionBy(*deal).orderBy("mix_key", "mix_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("range_begin") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    joined = joined.withColumn("begin", begin).withColumn("epochs", epochs.cast("long"))
    rest = budget - F.col("epochs") * F.col("source_size")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("begin")))
    return joined.select("mix_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "epochs", *(["mix_row"] if carry else []))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document: the id, size, source_size, target, taken (words) and epochs (whole ones)."""
    return placed(docs, id_col, text_col, source_col, weights, share, most, False).withColumnRenamed("mix_id", id_col)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself, in whole documents: each row as often as the mix takes it, counting a part as a whole; rows it takes no word of go."""
    found = placed(docs, id_col, text_col, source_col, weights, share, most, True).where("taken > 0")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return found.select("mix_row", F.explode(F.sequence(F.lit(1), copies))).select("mix_row.*")


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "epochs")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (
  SELECT *, source_size / weight AS ratio FROM w),
v AS (
  SELECT *,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lv
  FROM l),
x AS (SELECT arg_min(lv, ratio) AS lv FROM v WHERE 2.0 * ratio >= lv),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * coalesce((SELECT lv FROM x), 0.0)) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begun
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - begun)) AS BIGINT) AS taken, epochs
FROM p
"""
