"""Near-duplicates by wide SimHash fingerprints, confirmed by the exact Jaccard similarity of shingle sets.

Sets.  The distinct XXH64 hashes of a text's shingles of ``WORDS`` words (cut as for SimHash); equal sets become one row first.

Candidates.  The Gray-order index of ``simhash`` under its wide scheme: two sets are candidates if their fingerprints (majorities over the set)
agree in the front of some order and differ in 68 of 256 bits at most.  A pair of similarity 0.8 meets in no order in 1 of 10,000 cases by
the model.  Candidates' components are the groups in which links are sought.

Links.  Two sets of a group link if their Jaccard similarity is ``LEAST`` or more, counted on the whole sets in integers.  A group is dealt into chunks of
at most about ``CHUNK_SETS`` sets and ``CHUNK_HASHES`` hashes, and every pair of chunks is a tile of its own, so no task holds a large group;
all pairs of a tile are compared and it yields a spanning forest of its links.

An empty set is like another empty one and like nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.llm import simhash
from kairoscope.llm._forest import forest
from kairoscope.llm._memory import give_back
from kairoscope.llm.components import components
from kairoscope.session import cut

WORDS = simhash.WIDE_WORDS
#: The least similarity of a link, as numerator and denominator.
LEAST = (4, 5)
CHUNK_SETS, CHUNK_HASHES = 512, 1 << 19


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    parts = [np.unique(h) for h in simhash.shingle_hashes(text, WORDS)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def tile_links(a: list[np.ndarray], na: np.ndarray, b: list[np.ndarray] | None = None, nb: np.ndarray | None = None, least: tuple[int, int] = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, smaller node) of the links within a chunk or between two."""
    same = b is None
    of, begin = (a, 0) if same else (b, len(a))
    nodes = na if same else np.concatenate((na, nb))
    size = np.array([len(s) for s in of])
    hashes, owner = np.concatenate(of), np.repeat(np.arange(len(of)), size)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    p, q = least
    left, right = [], []
    for i, s in enumerate(a):
        low, high = np.searchsorted(hashes, s, "left"), np.searchsorted(hashes, s, "right")
        n = high - low
        held = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[held], minlength=len(of))
        hit = np.flatnonzero(q * both >= p * (len(s) + size - both))
        hit = hit[hit < i] if same else hit
        left.append(np.full(len(hit), i))
        right.append(hit + begin)
    root = forest(np.concatenate(left), np.concatenate(right), len(nodes))
    low = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(low, root, nodes)
    low = low[root]
    out = low != nodes
    return nodes[out], low[out]


def groups(distinct: DataFrame, block_rows: int = simhash.BLOCK) -> DataFrame:
    """(node, component): what the index connects; ``distinct`` has node long, n long and fp binary."""
    some = distinct.where("n > 0")
    prints = cut(some.groupBy("fp").agg(F.min("node").alias("node")))
    found = simhash.links(prints, simhash.wide(prints.count()), block_rows)
    alike = some.join(prints.select(F.col("fp").alias("of_fp"), F.col("node").alias("first")), F.col("fp") == F.col("of_fp")).where("node <> first")  # unequal sets of one fingerprint
    return components(found.union(alike.select(F.col("node").alias("a"), F.col("first").alias("b"))))


def links(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str, chunk_sets: int = CHUNK_SETS) -> DataFrame:
    """(a, b): exact links that connect what is near; ``distinct`` has key binary, node long, n long and fp binary."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(distinct.select("key", "node", "n").join(groups(distinct), "node"))
    sizes = placed.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / chunk_sets, F.sum("n") / CHUNK_HASHES)).cast("long").alias("chunks"))
    placed = placed.join(sizes, "component").withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks"))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(placed, "node")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t or "") for t in batch["text"]]
            own = np.array([set_key(s) == bytes(k) for s, k in zip(sets, batch["key"], strict=True)], bool)  # rows may share an id
            out = batch.loc[own, ["component", "chunk", "chunks", "node"]]
            give_back()
            yield out.assign(hashes=[s.tobytes() for s, o in zip(sets, own, strict=True) if o])

    sets = texts.select("component", "chunk", "chunks", "node", "key", "text").mapInPandas(hashed, "component long, chunk long, chunks long, node long, hashes binary")
    tiled = sets.withColumn("tile", F.explode(F.expr("transform(sequence(0L, chunks - 1), k -> struct(least(chunk, k) as one, greatest(chunk, k) as two))")))
    tiled = tiled.select("component", "tile.one", "tile.two", "chunk", "node", "hashes")
    dealt = tiled.repartition(parts, "component", "one", "two").sortWithinPartitions("component", "one", "two")

    def of_tile(one: int, two: int, rows: list) -> pd.DataFrame:
        sides = []
        for c in (one,) if one == two else (one, two):
            side = [(n, s) for k, n, s in rows if k == c]
            sides += [[np.frombuffer(s, np.uint64) for _, s in side], np.array([n for n, _ in side], np.int64)]
        x, y = tile_links(*sides) if all(len(s) for s in sides) else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame({"a": x, "b": y})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, rows = None, []
        for batch in batches:
            found = []
            for component, one, two, chunk, node, hashes in batch.itertuples(index=False):
                if tile != (component, one, two):
                    if len(rows) > 1:
                        found.append(of_tile(*tile[1:], rows))
                    tile, rows = (component, one, two), []
                rows.append((chunk, node, hashes))
            if found:
                yield pd.concat(found)
        if len(rows) > 1:
            yield of_tile(*tile[1:], rows)

    return dealt.mapInPandas(joined, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_sets: int = CHUNK_SETS) -> DataFrame:
    """One row per document: id and component_id (the smallest id reachable); a null id has a null component."""

    @F.pandas_udf("key binary, n long, fp binary")
    def made(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = shingle_set(t or "")
            rows.append((set_key(s), len(s), simhash.majority(iter((s,)), simhash.WIDE_SIZE)))
        give_back()
        return pd.DataFrame(rows, columns=["key", "n", "fp"])

    rows = cut(docs.select(F.col(id_col).alias("id"), made(F.col(text_col)).alias("m")).select("id", "m.*"))
    distinct = cut(rows.where("id IS NOT NULL").groupBy("key").agg(F.min("id").cast("long").alias("node"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    found = components(links(docs, distinct, id_col, text_col, chunk_sets))
    placed = distinct.select(F.col("key").alias("of_key"), "node").join(found, "node", "left").select("of_key", F.coalesce("component", "node").alias("component_id"))
    out = rows.select("id", "key").join(placed, F.col("key") == F.col("of_key"), "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
