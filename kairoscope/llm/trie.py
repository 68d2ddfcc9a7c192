"""A prefix trie of conversations and its subtree totals, by peeling leaves.

Nodes.  The node of a conversation's first d turns has as its key d and the exclusive or of a 128-bit hash of (position, role, text) over them, so all prefixes come from one
running fold and nodes from one ``groupBy``.  A parent's key is the child's without its last turn.

Totals.  Each node belongs to the path of the member whose hashed id is smallest (hashes, so that a path hangs below few others whatever the ids are: about the logarithm
of the number of conversations).  Paths hold counters of the child paths that remain; those without any have their totals, send them to their parents (summed before the
shuffle, so a node with very many children is a row a task) and are peeled off, until only the root's path is left.  A node's own totals are then a running sum along its path,
from its end up.

Hot conversations.  Turns are numbered over ranges of (conversation, turn), and running folds go over stretches of ``STRETCH`` positions and then over the stretches' totals,
so a conversation of very many turns is spread over tasks.

Odd rows.  Turns without a conversation are left out.  Null turns come first; turns of one number are ordered by a hash of role and text (rows that are equal in all of it stand for
one another).  A null role or text is empty.  A conversation that is left without turns is a member of the root alone; no conversations give no rows.  Further columns
don't matter.  Conversation ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.llm.mixing import word_count
from kairoscope.session import cut

STRETCH = 256
#: Ids of one node that lie in the same 2 ** PIECE_BITS go to its digest as one row.
PIECE_BITS = 12
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
KEY = ["d", "k1", "k2"]


def running(frame: DataFrame, key: str, at: str, folds: dict[str, tuple], down: bool = False) -> DataFrame:
    """``frame`` with running folds along ``at`` (from 0 on) inside each key: output name -> (column, aggregate, how a stretch joins what lies before it)."""
    order = F.col(at).desc() if down else F.col(at).asc()
    piece = frame.withColumn("stretch", F.expr(f"{at} div {STRETCH}"))
    inside = Window.partitionBy(key, "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = piece.groupBy(key, "stretch").agg(*(fold(c).alias(f"all_{out}") for out, (c, fold, _) in folds.items()))
    earlier = Window.partitionBy(key).orderBy(F.col("stretch").desc() if down else F.col("stretch").asc()).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "stretch", *(F.coalesce(fold(f"all_{out}").over(earlier), F.lit(0)).alias(f"pre_{out}") for out, (_, fold, _) in folds.items()))
    local = piece.select("*", *(fold(c).over(inside).alias(f"in_{out}") for out, (c, fold, _) in folds.items()))
    both = local.join(before, [key, "stretch"])
    return both.select(*frame.columns, *(join(F.col(f"in_{out}"), F.col(f"pre_{out}")).alias(out) for out, (_, _, join) in folds.items()))


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def numbered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv, pid, at, t1, t2, words), at from 0 within its range pid; and the ranges: conv, pid, before, total."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    told = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("t1"), F.xxhash64(text, role, F.lit("turn")).alias("t2"), word_count(text).alias("words")
    )
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(told.repartitionByRange(parts, "conv", F.col("turn").asc_nulls_first(), "t1").withColumn("pid", F.spark_partition_id()))
    here = Window.partitionBy("pid", "conv").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2")
    rows = ranged.select("conv", "pid", (F.row_number().over(here) - 1).cast("long").alias("at"), "t1", "t2", "words")
    ranges = ranged.groupBy("conv", "pid").agg(F.count("*").alias("n"))
    every = Window.partitionBy("conv")
    earlier = every.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return rows, ranges.select("conv", "pid", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(every).alias("total"))


def rebuilt(rows: DataFrame, ranges: DataFrame, head: Column, base: Column, most: int) -> DataFrame:
    """conv, d (from 0: the root), t1, t2, words, size: the first ``head`` (at most ``most``) turns of conversation ``base``, then the own ones behind the first ``head``.

    Both are columns over conv; a conversation that isn't there gives no turns.
    """
    convs = ranges.groupBy("conv").agg(F.max("total").alias("total")).select("conv", "total", head.cast("long").alias("head"), base.cast("long").alias("base"))
    bases = convs.select(F.col("base").alias("conv")).distinct()
    first = rows.join(ranges, ["conv", "pid"]).withColumn("at", F.col("at") + F.col("before")).where(F.col("at") < most).join(bases, "conv", "left_semi")
    heads = first.groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("at", "t1", "t2", "words"))).alias("turns"))
    told = convs.join(heads, "base", "left").withColumn("turns", F.slice(F.coalesce("turns", F.array().cast("array<struct<at:bigint,t1:bigint,t2:bigint,words:bigint>>")), F.lit(1), F.col("head").cast("int")))
    told = told.withColumn("taken", F.size("turns").cast("long")).withColumn("size", F.col("taken") + F.greatest(F.lit(0), F.col("total") - F.col("head")))
    told = cut(told.select("conv", "head", "taken", "size", "turns"))
    zero = F.lit(0).cast("long")
    root = told.select("conv", zero.alias("d"), zero.alias("t1"), zero.alias("t2"), zero.alias("words"), "size")
    lent = told.select("conv", "size", F.explode("turns").alias("x")).select("conv", (F.col("x.at") + 1).alias("d"), "x.t1", "x.t2", "x.words", "size")
    placed = ranges.join(told.select("conv", "head", "taken", "size"), "conv")
    own = rows.join(placed, ["conv", "pid"]).withColumn("at", F.col("at") + F.col("before")).where(F.col("at") >= F.col("head"))
    return root.unionByName(lent).unionByName(own.select("conv", (F.col("at") - F.col("head") + F.col("taken") + 1).alias("d"), "t1", "t2", "words", "size"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, d, k1, k2 (the prefix's key), g1, g2 (its last turn's part of it), words (of its last turn), size; the root has key 0."""
    part = lambda *c: F.when(F.col("d") > 0, F.xxhash64(*c)).otherwise(F.lit(0).cast("long"))
    keyed = turns.select("conv", "d", part("d", "t1", "t2").alias("g1"), part("t2", "t1", "d").alias("g2"), "words", "size")
    return running(keyed, "conv", "d", {"k1": ("g1", F.bit_xor, _xor), "k2": ("g2", F.bit_xor, _xor)})


def peeled(paths: DataFrame) -> DataFrame:
    """path, parent, top (depth of its first node), total, leaves: what hangs below each path is in its totals; ``paths`` has its own parts of them."""
    waiting = paths.where("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("open"))
    state = cut(paths.join(waiting, "path", "left").withColumn("open", F.coalesce("open", F.lit(0))))
    done = []
    while not state.isEmpty():
        ready = state.where("open = 0")
        done.append(ready.drop("open"))
        sent = ready.where("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.sum("total").alias("more"), F.sum("leaves").alias("more_leaves"), F.count("*").alias("came"))
        rest = state.where("open > 0").join(sent, "path", "left")
        more = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
        state = cut(rest.select("path", "parent", "top", more("total", "more"), more("leaves", "more_leaves"), (F.col("open") - F.coalesce("came", F.lit(0))).alias("open")))
    out = done[0] if done else state.drop("open")
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def ends(told: DataFrame) -> DataFrame:
    """d, k1, k2, ends_sha256: of the ids of those that end at a node, ascending, joined by commas.

    Neighbouring ids become one row first; a node's rows then stream through one task in order, which holds a digest and not the ids.
    """
    last = told.where("d = size").select(*KEY, "conv", F.shiftright("conv", PIECE_BITS).alias("piece"))
    pieces = last.groupBy(*KEY, "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    parts = int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, *KEY).sortWithinPartitions(*KEY, "piece")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha = None, None
        for batch in batches:
            out = []
            for d, k1, k2, ids in batch[[*KEY, "ids"]].itertuples(index=False):
                if key == (d, k1, k2):
                    sha.update(b",")
                else:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (d, k1, k2), hashlib.sha256()
                sha.update(ids.encode())
            yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, sha.hexdigest())], columns=[*KEY, "ends_sha256"])

    return dealt.mapInPandas(digest, "d long, k1 long, k2 long, ends_sha256 string")


def trie(told: DataFrame) -> DataFrame:
    """One row per node of the prefixes ``told``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    first = F.min(F.struct(F.xxhash64("conv").alias("h"), "conv"))["conv"]
    nodes = cut(told.groupBy(*KEY).agg(F.min("conv").alias("conv_id"), first.alias("path"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("g1").alias("g1"), F.max("g2").alias("g2")))
    up = [(F.col("d") - 1).alias("d"), F.col("k1").bitwiseXOR(F.col("g1")).alias("k1"), F.col("k2").bitwiseXOR(F.col("g2")).alias("k2")]
    children = nodes.where("d > 0").select(*up).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    own = nodes.join(children, KEY, "left").select(*KEY, "conv_id", "path", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    above = nodes.select(*(F.col(c).alias(f"up_{c}") for c in KEY), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent"))
    links = nodes.where("d > 0").select(*KEY, *(c.alias(f"up_{k}") for k, c in zip(KEY, up, strict=True))).join(above, [f"up_{c}" for c in KEY]).select(*KEY, "parent_conv_id", "parent")
    full = cut(own.join(links, KEY, "left"))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    top = F.min(F.struct(F.col("d"), F.col("parent")))
    paths = full.groupBy("path").agg(top.alias("t"), F.sum("saved").alias("total"), F.sum(leaf).alias("leaves")).select("path", F.col("t.parent").alias("parent"), F.col("t.d").alias("top"), "total", "leaves")
    hung = peeled(paths).where("parent IS NOT NULL").groupBy(F.col("parent").alias("path"), (F.col("top") - 1).alias("d")).agg(F.sum("total").alias("more"), F.sum("leaves").alias("more_leaves"))
    local = full.join(hung, ["path", "d"], "left").withColumn("saved", F.col("saved") + F.coalesce("more", F.lit(0))).withColumn("leaf", leaf + F.coalesce("more_leaves", F.lit(0))).drop("more", "more_leaves")
    summed = running(local, "path", "d", {"saved_tokens": ("saved", F.sum, _plus), "n_leaves": ("leaf", F.sum, _plus)}, down=True)
    out = summed.join(ends(told), KEY, "left")
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", head: Column | None = None, base: Column | None = None, most: int = 0) -> DataFrame:
    """The trie of the conversations of ``turns``; with ``head`` and ``base`` (columns over ``conv``; head <= ``most``) of their rebuilt form, as in ``rebuilt``."""
    rows, ranges = numbered(turns, conv_col, turn_col, role_col, text_col)
    made = rebuilt(rows, ranges, F.lit(0) if head is None else head, F.col("conv") if base is None else base, most)
    return trie(cut(prefixes(made)))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), head=F.crc32(conv.cast("string").cast("binary")) % 4, base=conv - conv % 20, most=3)


#: Node by node: each prefix is the list of its turns' digests, and subtrees are found along the smallest member's prefixes.
OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
         md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
         lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda p, q: CASE WHEN p % 2 = 1 THEN xor(p // 2, 3988292384) ELSE p // 2 END)) AS v
  FROM (SELECT DISTINCT c FROM t)),
o AS (SELECT c, list(h ORDER BY i) AS hs, list(w ORDER BY i) AS ws FROM t GROUP BY c),
r AS (
  SELECT o.c, list_concat(coalesce(b.hs[1:k], []), o.hs[k + 1:]) AS hs, list_concat(coalesce(b.ws[1:k], []), o.ws[k + 1:]) AS ws
  FROM o JOIN (SELECT c, xor(v, 4294967295) % 4 AS k FROM crc) USING (c) LEFT JOIN o b ON b.c = o.c - o.c % 20),
p AS (SELECT c, d, md5(array_to_string(hs[1:d], '')) AS k, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS w, d = len(hs) AS last, CASE WHEN d > 0 THEN md5(array_to_string(hs[1:d - 1], '')) END AS u
      FROM (SELECT *, unnest(range(len(hs) + 1)) AS d FROM r)),
n AS (SELECT d, k, any_value(u) AS u, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
             coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '') AS ids FROM p GROUP BY d, k),
ch AS (SELECT d - 1 AS d, u AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
s AS (SELECT p.d, p.k, sum((n.n_convs - 1) * n.w) AS saved, count(*) FILTER (ch.n_children IS NULL) AS leaves
      FROM n JOIN p ON p.c = n.conv_id AND p.d <= n.d LEFT JOIN ch ON ch.d = n.d AND ch.k = n.k GROUP BY p.d, p.k)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n_children, 0) AS n_children,
  s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM n JOIN s ON s.d = n.d AND s.k = n.k LEFT JOIN ch ON ch.d = n.d AND ch.k = n.k LEFT JOIN n q ON q.d = n.d - 1 AND q.k = n.u
"""
