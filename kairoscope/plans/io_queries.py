"""Queries on files: tables derived from the given ones are written to the shared folder, in the formats that the readers take, and read from there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kairoscope.operators import modules as M
from kairoscope.operators import motif
from kairoscope.plans.graph_queries import _clusters
from kairoscope.session import ensure_checkpoint_dir
from kairoscope.sources import readers as R
from kairoscope.sources import tables as T
from kairoscope.sources.tables import with_views as V

#: Positions of the matrices that are counted from the sequences.
WIDTH = 6


def _folder(spark) -> str:
    """A new folder in the shared one; it goes with the session."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def _lines(spark, lines, path: str) -> str:
    lines.write.text(path)
    return path


def edge_list_file(spark, d):
    """Turned round, twice, with loops and comments."""
    net = T.network(spark, d)
    lines = net.select(F.explode(F.array(F.concat("dst", F.lit("  "), "src"), F.concat("src", F.lit("\t"), "dst"), F.concat("src", F.lit(" "), "src"), F.concat(F.lit("# "), "src"))).alias("value"))
    return R.read_edge_list(spark, _lines(spark, lines, _folder(spark)))


def edge_list_attributes(spark, d):
    number = lambda c: F.substring(c, 2, 20).cast("double")
    lines = T.network(spark, d).select(F.concat_ws(" ", "src", "dst", (number("src") + number("dst") / 2).cast("string"), F.substring("dst", 1, 2)).alias("value"))
    return R.read_edge_list(spark, _lines(spark, lines, _folder(spark)), {"weight": "double", "kind": "string"})


def edge_table(spark, d):
    lines = T.network(spark, d).select(F.concat_ws("\t", "dst", "src", F.lit("0.5")).alias("value"))
    return R.read_edge_table(spark, _lines(spark, lines, _folder(spark)))


def edge_table_header(spark, d):
    path = _folder(spark)
    T.network(spark, d).select(F.col("dst").alias("a"), F.col("src").alias("b")).write.option("sep", "\t").option("header", True).csv(path)
    return R.read_edge_table(spark, path, header=True)


def slices_file(spark, d):
    path = _folder(spark)
    R.write_slices(_clusters(spark, d).withColumnRenamed("cluster", "slice_id"), path)
    return R.read_slices(spark, path)


def modules_file(spark, d):
    path = _folder(spark)
    R.write_modules(_clusters(spark, d).withColumnRenamed("cluster", "module_id"), path)
    return spark.read.text(path).select(F.col("value").alias("nodes"))


def ids_file(spark, d):
    path = _folder(spark)
    R.write_ids(T.table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("node")), path)
    return R.read_ids(spark, path, "node")


def factor_list(spark, d):
    """The brands of domains, one a line between empty lines and spaces."""
    lines = T.domains(spark, d).select(F.explode(F.array(F.concat(F.lit("  "), "domain_id", F.lit(" ")), F.lit(""))).alias("value")).distinct()
    return R.read_ids(spark, _lines(spark, lines, _folder(spark)), "factor")


def map_file(spark, d):
    path = _folder(spark)
    T.annotations(spark, d).groupBy("exon").agg(F.collect_list("pfam").alias("pfams")).write.parquet(path)
    return R.read_map(spark, path, "exon", "pfams")


def counted_motifs(spark, d):
    """Matrices of letter counts at the first places of the sequences of each group: sf, motif_id, pos, a, c, g, t."""
    at = T.sequences(spark, d).select("grp", F.posexplode(F.split(F.substring("seq", 1, WIDTH), "")).alias("pos", "letter")).where("letter <> ''")
    counts = at.groupBy("grp", "pos").agg(*(F.count_if(F.col("letter") == x.upper()).cast("double").alias(x) for x in motif.LETTERS))
    return counts.select(F.concat(F.lit("sf"), F.substring("grp", 1, 1)).alias("sf"), F.col("grp").alias("motif_id"), "pos", *motif.LETTERS)


def motif_files(spark, d):
    """The matrices as files, one each (a group of sequences)."""
    folder = _folder(spark)
    row = F.concat_ws(" ", F.lpad((F.col("pos") + 1).cast("string"), 2, "0"), *(F.col(x).cast("long").cast("string") for x in motif.LETTERS))
    files = counted_motifs(spark, d).groupBy("sf", "motif_id").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    for r in files.collect():  # a row a group
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/x.{r['sf']}.{r['motif_id']}.mat.txt")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(f"ID  {r['motif_id']}\nPO  A C G T\n{r['rows']}\nXX\n//\n".encode())
        out.close()
    return R.read_motifs(spark, folder)


def pwm_normalise(spark, d):
    return motif.normalised(counted_motifs(spark, d)).select("motif_id", "pos", *(F.round(x, 6).alias(x) for x in motif.LETTERS))


def large_modules(spark, d):
    return M.larger(_clusters(spark, d).withColumnRenamed("cluster", "module_id"), 2)


QUERIES = {f.__name__: f for f in (edge_list_file, edge_list_attributes, edge_table, edge_table_header, slices_file, modules_file, ids_file, factor_list, map_file, motif_files, pwm_normalise, large_modules)}

_COUNTS = f"ct AS (SELECT 'sf' || substr(grp, 1, 1) AS sf, grp AS motif_id, CAST(p AS INT) AS pos, " + ", ".join(f"CAST(count(*) FILTER (substr(seq, p + 1, 1) = '{x.upper()}') AS DOUBLE) AS {x}" for x in "acgt") + f" FROM seqs, (SELECT unnest(range({WIDTH})) AS p) WHERE length(seq) > p GROUP BY grp, p)"
_SUPPLIERS = "(SELECT CAST(s_nationkey AS BIGINT) AS c, 'G' || s_suppkey AS node FROM supplier)"
ORACLE_SQL = {
    "edge_list_file": V("net", "SELECT src, dst FROM net"),
    "edge_list_attributes": V("net", "SELECT src, dst, CAST(substr(src, 2) AS DOUBLE) + CAST(substr(dst, 2) AS DOUBLE) / 2 AS weight, substr(dst, 1, 2) AS kind FROM net"),
    "edge_table": V("net", "SELECT src, dst FROM net"),
    "edge_table_header": V("net", "SELECT src, dst FROM net"),
    "slices_file": f"SELECT c AS slice_id, node FROM {_SUPPLIERS}",
    "modules_file": f"SELECT '[' || string_agg(node, ', ' ORDER BY node) || ']' AS nodes FROM {_SUPPLIERS} GROUP BY c",
    "ids_file": "SELECT 'G' || s_suppkey AS node FROM supplier WHERE s_acctbal > 0",
    "factor_list": V("dom", "SELECT DISTINCT domain_id AS factor FROM dom"),
    "map_file": V("ann", "SELECT DISTINCT exon AS key, pfam AS value FROM ann"),
    "motif_files": V("seqs", f"{_COUNTS} SELECT sf, motif_id, pos, a, c, g, t FROM ct"),
    "pwm_normalise": V("seqs", f"{_COUNTS} SELECT motif_id, pos, round(a / (a + c + g + t), 6) AS a, round(c / (a + c + g + t), 6) AS c, round(g / (a + c + g + t), 6) AS g, round(t / (a + c + g + t), 6) AS t FROM ct"),
    "large_modules": f"SELECT CAST(c AS INT) AS module_id, node FROM {_SUPPLIERS} QUALIFY count(*) OVER (PARTITION BY c) >= 2",
}
