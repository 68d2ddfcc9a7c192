"""The driver's tables as time-course data.

Genes are suppliers, a gene's transcripts come from its parts, replicates come from line numbers and time points from the years
of shipment.  ``SQL`` has the same views as DuckDB CTEs, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPS, TIMEPOINTS = 3, 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcript_of(gene: Column) -> Column:
    return F.concat(gene, F.lit(".T"), (F.col("l_partkey") % 7).cast("string"))


def observed(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ("gene_id", "transcript_id")) -> DataFrame:
    """Measured cells only: gene_id, transcript_id, rep, tp, value; sums of a gene if that is all of ``keys``."""
    line = table(spark, sf_dir, "lineitem")
    gene = F.concat(F.lit("G"), F.col("l_suppkey").cast("string"))
    cells = line.select(gene.alias("gene_id"), transcript_of(gene).alias("transcript_id"), ((F.col("l_linenumber") - 1) % REPS).cast("int").alias("rep"), (F.year("l_shipdate") - 1995).cast("int").alias("tp"), F.col("l_quantity").cast("double").alias("q"))
    return cells.groupBy(*keys, "rep", "tp").agg(F.sum("q").alias("value"))


def densified(cells: DataFrame, reps: int = REPS, timepoints: int = TIMEPOINTS, keys: tuple[str, ...] = ("gene_id", "transcript_id")) -> DataFrame:
    """All replicates and time points of each transcript (of what ``keys`` name), 0.0 where nothing was measured."""
    place = F.when(F.col("rep").between(0, reps - 1) & F.col("tp").between(0, timepoints - 1), F.col("rep") * timepoints + F.col("tp"))
    packed = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(place.isNotNull(), F.struct(place, F.col("value"))))).alias("m"))
    every = packed.select(*keys, "m", F.explode(F.sequence(F.lit(0), F.lit(reps * timepoints - 1))).alias("at"))
    return every.select(*keys, F.floor(F.col("at") / timepoints).cast("int").alias("rep"), (F.col("at") % timepoints).alias("tp"), F.coalesce(F.try_element_at("m", F.col("at")), F.lit(0.0)).alias("value"))


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densified(observed(spark, sf_dir))


def gene_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene_id, rep, tp, value: ``expression`` summed over a gene's transcripts, without their rows."""
    return densified(observed(spark, sf_dir, ("gene_id",)), keys=("gene_id",))


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: an interaction is a first line with a quantity over 45."""
    genes = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    line = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_quantity > 45").crossJoin(F.broadcast(genes))  # one row
    a = F.concat(F.lit("G"), F.col("l_suppkey").cast("string"))
    b = F.concat(F.lit("G"), (1 + (F.col("l_partkey") * 7 + F.col("l_suppkey")) % F.col("n")).cast("string"))
    return line.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).where("src <> dst").distinct()


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed series with a given clustering: object_idx, cluster, vals."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(F.col("vec_id").alias("object_idx"), (F.col("label") + 1).cast("int").alias("cluster"), F.col("embedding").cast("array<double>").alias("vals"))


def long_series(packed: DataFrame) -> DataFrame:
    return packed.select("object_idx", "cluster", F.posexplode("vals").alias("tp", "value"))


def gene_of_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    part = table(spark, sf_dir, "part").crossJoin(F.broadcast(genes))  # one row
    return part.withColumn("gene_id", F.concat(F.lit("G"), (1 + F.col("p_partkey") % F.col("n")).cast("string"))).drop("n")


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    start = (F.col("l_quantity") * 10).cast("long")
    return line.select(F.concat(F.lit("G"), F.col("l_suppkey").cast("string")).alias("gene_id"), F.concat_ws("_", F.lit("E"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("exon_id"), start.alias("start"), (start + F.col("l_linenumber") * 5).cast("long").alias("end"))


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("p_size") * 10).cast("long")
    return gene_of_part(spark, sf_dir).select("gene_id", F.concat(F.lit("PF"), F.substring("p_brand", 7, 10)).alias("domain_id"), start.alias("start"), (start + 25).alias("end"))


def pathways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pathway, source, gene_id."""
    part = gene_of_part(spark, sf_dir)
    source = part.groupBy("p_brand").agg(F.min("p_type").alias("source"))
    return part.join(source, "p_brand").select(F.col("p_brand").alias("pathway"), "source", "gene_id").distinct()


def pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), ((F.col("o_orderkey") % 997 + 1) / F.lit(1000.0)).alias("p"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene_id, transcript_id, exon, pfam of strong first lines, distinct."""
    line = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_quantity > 45")
    joined = line.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    gene = F.concat(F.lit("G"), F.col("l_suppkey").cast("string"))
    return joined.select(gene.alias("gene_id"), transcript_of(gene).alias("transcript_id"), F.concat(F.lit("E"), (F.col("l_partkey") % 20).cast("string")).alias("exon"), F.col("p_brand").alias("pfam")).distinct()


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq (the letters ACGT of a text), grp (lost, gained or background); sequences of 50 letters or more."""
    docs = table(spark, sf_dir, "documents")
    seq = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    group = F.element_at(F.array(F.lit("lost"), F.lit("gained"), F.lit("background")), (F.pmod(F.col("doc_id"), F.lit(3)) + 1).cast("int"))
    return docs.select("doc_id", seq.alias("seq"), group.alias("grp")).where(F.length("seq") >= 50)


def splice_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ES, gene_id, delta, prob and coords as separated strings."""
    e = table(spark, sf_dir, "events")
    text = lambda x: x.cast("decimal(18,6)").cast("string")
    delta = F.concat_ws(";", text(F.col("value") / 1000), text(F.col("value") / 2000))
    prob = F.concat_ws(";", text(F.least(F.lit(1.0), F.col("value") / 100)), text(F.least(F.lit(1.0), F.col("value") / 200)))
    base = F.col("event_id").cast("long")
    coords = F.concat_ws(";", F.concat_ws("-", base.cast("string"), (base + 10).cast("string")), F.concat_ws("-", base.cast("string"), (base + 25).cast("string")))
    return e.select((F.col("event_type") == "click").alias("es"), F.col("event_id").alias("event_id"), F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("gene_id"), delta.alias("delta"), prob.alias("prob"), coords.alias("coords"))


#: DuckDB CTEs of the views above, by name; each may use those before it.
SQL = {
    "obs": "SELECT 'G' || l_suppkey AS gene_id, 'G' || l_suppkey || '.T' || (l_partkey % 7) AS transcript_id, CAST((l_linenumber - 1) % 3 AS INT) AS rep, CAST(year(l_shipdate) - 1995 AS INT) AS tp, sum(CAST(l_quantity AS DOUBLE)) AS value FROM lineitem GROUP BY ALL",
    "expr": "SELECT t.gene_id, t.transcript_id, CAST(r.r AS INT) AS rep, CAST(s.s AS INT) AS tp, coalesce(o.value, 0.0) AS value FROM (SELECT DISTINCT gene_id, transcript_id FROM obs) t CROSS JOIN range(3) r(r) CROSS JOIN range(7) s(s) LEFT JOIN obs o ON o.transcript_id = t.transcript_id AND o.rep = r.r AND o.tp = s.s",
    "nsupp": "SELECT count(*) AS n FROM supplier",
    "net": "SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT 'G' || l_suppkey AS a, 'G' || (1 + (l_partkey * 7 + l_suppkey) % (SELECT n FROM nsupp)) AS b FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 45) WHERE a <> b",
    "ser": "SELECT vec_id AS object_idx, CAST(label + 1 AS INT) AS cluster, CAST(embedding AS DOUBLE[]) AS vals FROM embeddings",
    "lser": "SELECT object_idx, cluster, CAST(i - 1 AS INT) AS tp, vals[i] AS value FROM (SELECT object_idx, cluster, vals, unnest(range(1, len(vals) + 1)) AS i FROM ser)",
    "gpart": "SELECT *, 'G' || (1 + p_partkey % (SELECT n FROM nsupp)) AS gene_id FROM part",
    "exon": "SELECT 'G' || l_suppkey AS gene_id, 'E_' || l_orderkey || '_' || l_linenumber AS exon_id, CAST(l_quantity * 10 AS BIGINT) AS s, CAST(l_quantity * 10 AS BIGINT) + l_linenumber * 5 AS e FROM lineitem WHERE l_returnflag = 'R'",
    "dom": "SELECT gene_id, 'PF' || substr(p_brand, 7, 10) AS domain_id, CAST(p_size * 10 AS BIGINT) AS s, CAST(p_size * 10 AS BIGINT) + 25 AS e FROM gpart",
    "pw": "SELECT DISTINCT p_brand AS pathway, min(p_type) OVER (PARTITION BY p_brand) AS source, gene_id FROM gpart",
    "pv": "SELECT o_orderkey AS id, o_custkey AS grp, (o_orderkey % 997 + 1) / 1000.0::DOUBLE AS p FROM orders",
    "ann": "SELECT DISTINCT 'G' || l_suppkey AS gene_id, 'G' || l_suppkey || '.T' || (l_partkey % 7) AS transcript_id, 'E' || (l_partkey % 20) AS exon, p_brand AS pfam FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1 AND l_quantity > 45",
    "sev": "SELECT event_type = 'click' AS es, event_id, 'G' || user_id AS gene_id, CAST(CAST(value / 1000 AS DECIMAL(18, 6)) AS VARCHAR) || ';' || CAST(CAST(value / 2000 AS DECIMAL(18, 6)) AS VARCHAR) AS delta, CAST(CAST(least(1.0::DOUBLE, value / 100) AS DECIMAL(18, 6)) AS VARCHAR) || ';' || CAST(CAST(least(1.0::DOUBLE, value / 200) AS DECIMAL(18, 6)) AS VARCHAR) AS prob, event_id || '-' || (event_id + 10) || ';' || event_id || '-' || (event_id + 25) AS coords FROM events",
    "seqs": "SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq, CASE ((doc_id % 3) + 3) % 3 WHEN 0 THEN 'lost' WHEN 1 THEN 'gained' ELSE 'background' END AS grp FROM documents WHERE length(regexp_replace(upper(text), '[^ACGT]', '', 'g')) >= 50",
}
_NEEDS = {"expr": ["obs"], "net": ["nsupp"], "lser": ["ser"], "gpart": ["nsupp"], "dom": ["gpart", "nsupp"], "pw": ["gpart", "nsupp"]}


def with_views(names: str, query: str) -> str:
    """``query`` behind the CTEs that it names; it may begin with further CTEs (``x AS (...), ... SELECT``)."""
    wanted = set(names.split())
    for n in list(wanted):
        wanted |= set(_NEEDS.get(n, []))
    ctes = ", ".join(f"{n} AS ({s})" for n, s in SQL.items() if n in wanted)
    return f"WITH {ctes}{' ' if query.lstrip().upper().startswith('SELECT') else ', '}{query}"
