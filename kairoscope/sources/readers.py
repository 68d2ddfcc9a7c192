"""Readers and writers: wide matrices, edge lists, motif files, id lists and maps.

Expression data are long: object_idx, gene_id, transcript_id, symb, rep, tp, value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def wide_to_long(wide: DataFrame, value_columns: list[str], reps: int, timepoints: int, keys: tuple[str, ...] = ("gene_id",)) -> DataFrame:
    """A wide matrix as long rows; replicate r owns the columns [r * timepoints, (r + 1) * timepoints).

    Raises ValueError if there are not reps * timepoints columns.  Rows are numbered by ``object_idx`` where the input has it.
    """
    if len(value_columns) != reps * timepoints:
        raise ValueError(f"{len(value_columns)} columns for {reps} replicates of {timepoints} time points")
    values = F.array(*(F.col(c).cast("double") for c in value_columns))
    spread = wide.select(*keys, F.posexplode(values).alias("pos", "value"))
    return spread.select(*keys, F.floor(F.col("pos") / timepoints).cast("int").alias("rep"), (F.col("pos") % timepoints).alias("tp"), "value")


def long_to_wide(expr: DataFrame, keys: tuple[str, ...], reps: int, timepoints: int) -> DataFrame:
    """The inverse: one row a key with ``vals``, replicate-major."""
    at = F.col("rep") * timepoints + F.col("tp")
    packed = expr.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "value"))).alias("v"))
    return packed.select(*keys, F.transform("v", lambda x: x["value"]).alias("vals"))


def canonical_edges(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Distinct undirected edges without loops, the smaller id first."""
    low, high = F.least(F.col(a), F.col(b)).alias("src"), F.greatest(F.col(a), F.col(b)).alias("dst")
    return edges.where(F.col(a) != F.col(b)).select(low, high).distinct()


def read_edge_list(spark: SparkSession, path: str, attributes: dict[str, str] | None = None) -> DataFrame:
    """White-space separated ``node node [attribute ...]``; # begins a comment.  attributes: name to type, in file order."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p"))
    extra = [F.get("p", F.lit(i + 2)).cast(kind).alias(name) for i, (name, kind) in enumerate((attributes or {}).items())]
    named = parts.select(F.get("p", F.lit(0)).alias("src"), F.get("p", F.lit(1)).alias("dst"), *extra).where("src <> dst")
    low, high = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    return named.select(low, high, *(attributes or {})).dropDuplicates(["src", "dst"])


def read_edge_table(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Tab separated edges; the first two columns count, all as strings."""
    table = spark.read.option("sep", "\t").option("header", header).csv(path)
    return canonical_edges(table, *table.columns[:2])


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """TRANSFAC count matrices of a folder: sf (the second field of the file name), motif_id, pos (from 0), a, c, g, t.  Files without rows give none."""
    text = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    rows = text.select("file", F.regexp_extract("value", r"(?m)^ID\s+(\S+)", 1).alias("id"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^(\d+\s+[-+.\deE]+\s+[-+.\deE]+\s+[-+.\deE]+\s+[-+.\deE]+)"), F.lit(1))).alias("row"))
    cells = rows.select("file", "id", F.split("row", r"\s+").alias("c"))
    number = lambda i: F.get("c", F.lit(i)).cast("double")
    name = F.split("file", r"\.")
    motif = F.when(F.col("id") != "", F.col("id")).otherwise(F.regexp_replace("file", r"\.mat\.txt$", ""))
    return cells.select(F.get(name, F.lit(1)).alias("sf"), motif.alias("motif_id"), (F.get("c", F.lit(0)).cast("int") - 1).alias("pos"), number(1).alias("a"), number(2).alias("c"), number(3).alias("g"), number(4).alias("t"))


def read_ids(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """One id a line."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "")


def write_ids(ids: DataFrame, path: str) -> None:
    ids.select(F.concat_ws(" ", *ids.columns)).write.mode("overwrite").text(path)


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    """slice_id, node from the text form: ``# i: ...`` lines that head ``[a, b, ...]`` lists; without a head a slice is numbered by its place."""
    lines = spark.read.text(path, lineSep="\n# ").select(F.explode(F.split("value", r"\n(?=\[)")).alias("part"), F.regexp_extract("value", r"^(?:# )?(\d+):", 1).alias("head"))
    lists = lines.where(F.trim("part").startswith("["))
    rows = lists.select(F.coalesce(F.col("head").try_cast("long"), F.monotonically_increasing_id()).alias("slice_id"), F.split(F.regexp_replace("part", r"[\[\]'\s]", ""), ",").alias("nodes"))
    return rows.select("slice_id", F.explode("nodes").alias("node")).where("node <> ''")


def _lists(members: DataFrame, group: str) -> DataFrame:
    """group, n and its nodes in order, ``[a, b, ...]``."""
    names = F.array_join(F.array_sort(F.collect_set("node")), ", ")
    return members.groupBy(group).agg(F.count_distinct("node").alias("n"), F.concat(F.lit("["), names, F.lit("]")).alias("nodes"))


def write_slices(parts: DataFrame, path: str) -> None:
    """slice_id, node as text: ``# i: n nodes`` and the list in the next line."""
    lists = _lists(parts, "slice_id")
    lines = F.concat(F.lit("# "), F.col("slice_id").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" nodes\n"), "nodes")
    lists.select(lines).write.mode("overwrite").text(path)


def write_modules(modules: DataFrame, path: str) -> None:
    """module_id, node as text: one list a line."""
    _lists(modules, "module_id").select("nodes").write.mode("overwrite").text(path)


def read_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A map from a key to one value or to an array of values (Parquet, or JSON lines where the path ends in .json) as distinct key, value rows; nulls go."""
    table = spark.read.json(path) if path.endswith(".json") else spark.read.parquet(path)
    kind = dict(table.dtypes)[value]
    each = table.select(F.col(key).alias("key"), F.explode(value).alias("value") if kind.startswith("array") else F.col(value).alias("value"))
    return each.where("key IS NOT NULL AND value IS NOT NULL").distinct()


def strip_version(id_column: Column) -> Column:
    """An id without what follows its first dot."""
    return F.split_part(id_column, F.lit("."), F.lit(1))


def translate(frame: DataFrame, names: DataFrame, id_col: str, out: str, default: str | None = "n") -> DataFrame:
    """``frame`` with the name of an id (names: id, name); ``default``, or the id itself where that is None, if there is none."""
    table = names.select(F.col("id").alias("__id"), F.col("name").alias("__name")).dropDuplicates(["__id"])
    other = F.col(id_col) if default is None else F.lit(default)
    return frame.join(table, F.col(id_col) == F.col("__id"), "left").withColumn(out, F.coalesce("__name", other)).drop("__id", "__name")
