"""Document fingerprints: threshold-scaled sketches, with DataFrame functions only.

A text's sketch is the sorted set of those of its shingle hashes that lie below a fixed fraction of
all hash values.  The threshold is the same for every text, so the sketches of very unequal texts
estimate containment, and the sketch of a union is the union of the sketches.  A text none of whose
hashes lies below it keeps its smallest hash, which a union also keeps to (``merge``).

Shingles are ``WORDS`` words long, repeats count once; a text of fewer words has one shingle, all
of it; a text without words (null, empty or white space) has the empty sketch, which is like another
empty one (1.0) and unlike all others (0.0).

Neighbours.  A document's next one is found without a global window: the ids are cut into
ranges at their quantiles, each range is a window of its own, and the first document of a range is
also dealt to the range before it, where it closes the order (the first of all closes the
last range).  The whole texts move once.  Null ids come first; rows that share an id are in order of
their texts; rows that share both are equal to each other.  An empty table gives no rows; the only
document of a table is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
#: The share of all hash values that a sketch keeps.
FRACTION = 1 / 4
THRESHOLD = -(1 << 63) + int((1 << 64) * FRACTION)
#: Quantiles of the ids, and the rows that a range should have; ranges are at most QUANTILES ** 2.
QUANTILES, RANGE_ROWS = 256, 1000
_LEAST = -(1 << 63)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def hashes_of(words: str, size: int = WORDS) -> Column:
    """Hashes of the shingles of a column of words (a column, so that it is computed once)."""
    each = ", ".join(f"{words}[i + {k}]" if k else f"{words}[i]" for k in range(size))
    return F.expr(
        f"CASE WHEN size({words}) >= {size} THEN transform(sequence(0, size({words}) - {size}), i -> xxhash64({each})) "
        f"WHEN size({words}) > 0 THEN array(xxhash64(array_join({words}, ' '))) ELSE cast(array() AS array<bigint>) END"
    )


def with_sketch(frame: DataFrame, text: str, out: str, size: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``frame`` with the sketch of a text column.  Each step is a column, so none is computed twice."""
    steps = frame.withColumn("__words", words_of(F.col(text))).withColumn("__hashes", hashes_of("__words", size)).drop("__words")
    steps = steps.withColumn("__below", F.expr(f"filter(__hashes, h -> h < {threshold})" if threshold < (1 << 63) else "__hashes"))
    least = F.when(F.size("__hashes") > 0, F.array(F.array_min("__hashes"))).otherwise(F.col("__hashes"))
    return steps.withColumn(out, F.when(F.size("__below") > 0, F.array_sort(F.array_distinct("__below"))).otherwise(least)).drop("__below", "__hashes")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two texts, from their sketches."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has too."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda h: h < F.lit(threshold))
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def fingerprint(sketch: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and its sketch."""
    return with_sketch(docs.select(F.col(id_col), F.col(text_col).alias("__text")), "__text", "sketch").select(id_col, "sketch")


def with_next(docs: DataFrame, id_col: str, columns: list[str], tie: str) -> DataFrame:
    """``docs`` with ``next_<column>`` of the next row in ascending order of ``id_col``."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST))
    ids = docs.select(key.alias("k"))
    rows = ids.agg(F.count("*")).first()[0]
    cuts = sorted({int(x) for x in ids.approxQuantile("k", [i / QUANTILES for i in range(1, QUANTILES)], 0.0005)}) if rows else []
    parts = min(QUANTILES, -(-rows // (QUANTILES * RANGE_ROWS)) or 1)
    if cuts:
        bounds = F.array(*(F.lit(c) for c in cuts))
        above = F.size(F.filter(bounds, lambda c: c <= F.col("__key")))
        low = F.coalesce(F.get(bounds, above - 1), F.lit(cuts[0])).cast("double")
        high = F.coalesce(F.get(bounds, above), F.lit(cuts[-1])).cast("double")
        inside = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((F.col("__key").cast("double") - low) * parts / F.greatest(high - low, F.lit(1.0)))))
        place = above.cast("long") * QUANTILES + inside.cast("long")
    else:
        place = F.lit(0).cast("long")
    keyed = docs.withColumn("__key", key).withColumn("__range", place)
    heads = ids.withColumnRenamed("k", "__key").select("__key", place.alias("__range")).groupBy("__range").agg(F.min("__key").alias("head"))
    over = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.lag("__range").over(over.orderBy("__range")), F.max("__range").over(over))
    heads = heads.select("head", before.alias("closes"))  # at most QUANTILES ** 2 rows
    dealt = keyed.join(F.broadcast(heads), F.col("__key") == F.col("head"), "left")
    own = F.struct(F.col("__range").alias("at"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("closes").alias("at"), F.lit(True).alias("guest"))
    dealt = dealt.withColumn("__in", F.explode(F.when(F.col("closes").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    order = Window.partitionBy("__in.at").orderBy("__in.guest", "__key", tie)
    following = dealt.select("__in", *docs.columns, *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return following.where(~F.col("__in.guest")).drop("__in")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited text and the sketches of it, its edited text and the next document."""
    own = with_sketch(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", "sketch")
    pairs = with_next(own, "id", ["text", "sketch"], "text")
    n = F.length("text")
    moved = (n - n % 4) / 4
    cut = pairs.withColumn("n_chars", n.cast("long")).withColumn("__q", moved.cast("int"))
    cut = cut.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars AS int) - __q)"), F.expr("substring(next_text, 1, __q)")))
    cut = cut.select(F.col("id").alias(id_col), "n_chars", "edited", "sketch", "next_sketch")
    return with_sketch(cut, "edited", "edited_sketch")


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    pairs = edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
