"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints.  ASCII capitals become small, words are runs of other than white space (ASCII 9 to 13 and 32), and the shingles of so many
words, repeats included, are hashed with XXH64 (UTF-8, seed 42).  A bit of the fingerprint is 1 if it is set in over half of the hashes.
Fewer words make one shingle; a text without words (null too) has the fingerprint zero, which links like any other.
Wide fingerprints have three more 64-bit words, from the same hash multiplied by odd constants.

Links.  Two fingerprints link at ``distance`` or fewer differing bits.  Equal fingerprints become one row first.  Each one goes into several orders, and in an
order links are sought only among those that agree in its front bits:

* ``EXACT``: 64 bits, 3 differences.  Three differences cannot touch all four quarters of the bits, so four orders with one quarter each in
  front find every link.
* ``wide(n)``: 256 bits, 68 differences, for a similarity of 0.8 among n fingerprints.  Two sets of that similarity agree in a bit with a probability of 0.8485
  (1 - arccos(8 / 9) / pi; 0.8125 where they have four and five shingles, the worst case).  The bits in front are so many that
  about ``FRONT_ROWS`` fingerprints share a front, and there are so many orders that such a pair shares no front in ``MISS`` of all cases at most: both grow with
  the corpus, so what is compared grows little faster than it.  What is found that way is confirmed exactly (``shingles``).

Every order is dealt into ranges by Gray rank (front bits first), in which neighbours share most bits, and cut into blocks, between fronts where it can be.  A
block is a tree: each node has the mask of the bits that all below it share and their pattern.  Two trees (or one and itself) are
joined from the top; a pair of nodes goes on only while the differences on the shared bits are within the distance, none of them in front, and while its rows aren't in
one component already.  Rows with one front that fill several blocks (a hot front, however large) are joined block pair by block pair; pairs
whose tops differ too much are never made.  A pair of blocks yields a spanning forest of its links, at most one a row, so a
group of copies costs no pairs.

Results.  One row per document, with the smallest id of all that it reaches; rows that repeat an id are each placed by their own
text (``survivors`` takes them as one document).  A null id is no node: its row has a fingerprint and a null component.  An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.llm._forest import forest
from kairoscope.llm._memory import give_back
from kairoscope.llm._names import fresh
from kairoscope.llm.components import components
from kairoscope.session import cut

SEED = 42
#: Factors of the further words of a wide fingerprint.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Rows of a block.
BLOCK = 2048
#: Rows that should share a front of a wide scheme, the probability that a bit agrees, and that of a pair that meets in no order.
FRONT_ROWS, AGREE, MISS = 2048, 0.8485, 1e-4
#: Tasks that the pairs of ranges of one front are dealt to.
SALTS = 16
#: Node pairs, or shingles, that are looked at together.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Scheme:
    """words: of a shingle; size: 64-bit words of a fingerprint; distance: most differing bits; fronts: each order's bits in front; leaf: rows of a leaf of a tree."""

    words: int
    size: int
    distance: int
    fronts: tuple[tuple[int, ...], ...]
    leaf: int = 8

    @cached_property
    def masks(self) -> np.ndarray:
        """The front bits of each order as words."""
        masks = np.zeros((len(self.fronts), self.size), np.uint64)
        for o, bits in enumerate(self.fronts):
            for b in bits:
                masks[o, b // 64] |= np.uint64(1 << (63 - b % 64))
        return masks

    @cached_property
    def turns(self) -> list[np.ndarray]:
        """For each order 64 bits to sort by: those in front, then the next ones."""
        return [np.array([*bits, *(b for b in np.roll(np.arange(64 * self.size), -bits[-1] - 1) if b not in set(bits))][:64]) for bits in self.fronts]


EXACT = Scheme(3, 1, 3, tuple(tuple(range(16 * k, 16 * k + 16)) for k in range(4)))
WIDE_WORDS, WIDE_SIZE, WIDE_DISTANCE = 5, 4, 68


def wide(n: int) -> Scheme:
    """The scheme for a similarity of 0.8 among n fingerprints."""
    bits = min(64, max(1, math.ceil(math.log2(max(1, n) / FRONT_ROWS))))
    orders = math.ceil(math.log(MISS) / math.log1p(-(AGREE**bits)))
    rng = np.random.default_rng(5)
    fronts = tuple(tuple(int(b) for b in np.sort(rng.choice(64 * WIDE_SIZE, bits, replace=False))) for _ in range(orders))
    return Scheme(WIDE_WORDS, WIDE_SIZE, WIDE_DISTANCE, fronts, 64)


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, in chunks."""
    data = text.encode("utf-8", "surrogatepass").lower()  # of bytes: ASCII letters only
    digest = xxhash.xxh64_intdigest
    kept: list[bytes] = []
    some = False
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > 1 << 20:  # a piece of a long text ends behind white space
            end = max(data.rfind(b" ", at, at + (1 << 20)), data.rfind(b"\n", at, at + (1 << 20))) + 1
            if end <= at:
                found = [i for i in (data.find(s, at) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if i >= 0]
                end = min(found) + 1 if found else len(data)
        kept += data[at:end].split()
        at = end
        if len(kept) >= words:
            joined = map(b" ".join, zip(*(kept[k:] for k in range(words)), strict=False))
            yield np.fromiter((digest(s, SEED) for s in joined), np.uint64, len(kept) - words + 1)
            some = True
            kept = kept[len(kept) - words + 1 :]
    if not some and kept:
        yield np.array([digest(b" ".join(kept), SEED)], np.uint64)


def majority(parts: Iterator[np.ndarray], size: int) -> bytes:
    """The bits, first bit first, that over half of the hashes have; ``size`` words from each hash."""
    total, n = np.zeros(64 * size, np.int64), 0
    for hashes in parts:
        for at in range(0, len(hashes), CHUNK // size // 4):
            part = hashes[at : at + CHUNK // size // 4]
            more = [(part * np.uint64(f)) ^ (part >> np.uint64(31)) for f in FACTORS[: size - 1]]
            bits = np.unpackbits(np.stack([part, *more], 1).astype(">u8").view(np.uint8), axis=1)
            total += bits.sum(0, dtype=np.int64)
        n += len(hashes)
    return np.packbits(2 * total > n).tobytes()


def fingerprint(text: str, scheme: Scheme = EXACT) -> bytes:
    """The fingerprint of a text, first bit first."""
    return majority(shingle_hashes(text, scheme.words), scheme.size)


def fingerprint_column(text: Column, scheme: Scheme = EXACT) -> Column:
    """The fingerprint of a text as binary."""

    @F.pandas_udf("binary")
    def made(texts: pd.Series) -> pd.Series:
        out = pd.Series([fingerprint(t or "", scheme) for t in texts], dtype=object)
        give_back()
        return out

    return made(text)


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray code, with the sign turned so that signed order is that of the place."""
    out = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def words_of(prints: list[bytes], size: int) -> np.ndarray:
    """Fingerprints as an n x size array."""
    return np.frombuffer(b"".join(prints), ">u8").astype(np.uint64).reshape(-1, size)


def differing(diff: np.ndarray) -> np.ndarray:
    total = np.bitwise_count(diff[..., 0]).astype(np.uint16)
    for k in range(1, diff.shape[-1]):
        total += np.bitwise_count(diff[..., k])
    return total


class Tree:
    """The nodes above rows in Gray order; the last row fills up the leaves.  root: the component of each row so far."""

    def __init__(self, rows: np.ndarray, root: np.ndarray, leaf: int):
        self.n = len(rows)
        depth = max(0, int(np.ceil(np.log2(max(1, -(-self.n // leaf))))))
        more = (leaf << depth) - self.n
        self.rows = np.concatenate((rows, np.repeat(rows[-1:], more, 0)))
        root = np.concatenate((root, np.repeat(root[-1:], more)))
        grid, roots = self.rows.reshape(-1, leaf, rows.shape[1]), root.reshape(-1, leaf)
        pattern = np.bitwise_and.reduce(grid, axis=1)
        mask = ~(np.bitwise_or.reduce(grid, axis=1) ^ pattern)
        low, high = roots.min(1), roots.max(1)
        self.levels = [(mask, pattern, low, high)]
        while len(mask) > 1:
            mask = mask[::2] & mask[1::2] & ~(pattern[::2] ^ pattern[1::2])
            pattern, low, high = pattern[::2], np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.levels.append((mask, pattern, low, high))


def tree_join(a: Tree, b: Tree, same: bool, front: np.ndarray, distance: int, leaf: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a and b that link, in chunks, but for those in one component; ``same``: a is b, each pair once."""
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        (ma, pa, low_a, high_a), (mb, pb, low_b, high_b) = a.levels[la], b.levels[lb]
        diff = (pa[i] ^ pb[j]) & ma[i] & mb[j]
        one = (low_a[i] == high_a[i]) & (low_b[j] == high_b[j]) & (low_a[i] == low_b[j])
        go = (differing(diff) <= distance) & ~(diff & front).any(-1) & ~one
        i, j = i[go], j[go]
        if not len(i):
            continue
        if la == 0 and lb == 0:
            step = CHUNK // (leaf * leaf)
            for at in range(0, len(i), step):
                ri = (i[at : at + step, None] * leaf + np.arange(leaf))[:, :, None]
                rj = (j[at : at + step, None] * leaf + np.arange(leaf))[:, None, :]
                left, right = a.rows[ri[:, :, 0]], b.rows[rj[:, 0, :]]
                total = np.zeros((len(left), leaf, leaf), np.uint16)
                for w in range(left.shape[-1]):
                    total += np.bitwise_count(left[:, :, None, w] ^ right[:, None, :, w])
                k, x, y = np.nonzero(total <= distance)
                x, y = ri[k, x, 0], rj[k, 0, y]
                held = (x < a.n) & (y < b.n) & ~((a.rows[x] ^ b.rows[y]) & front).any(-1)
                if same:
                    held &= x < y
                if held.any():
                    yield x[held], y[held]
            continue
        if la >= lb and la > 0:
            i, j, la = np.concatenate((2 * i, 2 * i + 1)), np.concatenate((j, j)), la - 1
        if lb > la:
            i, j, lb = np.concatenate((i, i)), np.concatenate((2 * j, 2 * j + 1)), lb - 1
        if same and la == lb:
            keep = i <= j
            i, j = i[keep], j[keep]
        for at in range(0, len(i), CHUNK // 4):
            stack.append((la, lb, i[at : at + CHUNK // 4], j[at : at + CHUNK // 4]))


def joined_roots(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return forest(np.concatenate((root, x)), np.concatenate((np.arange(len(root)), y)), len(root))


def block_links(fa: np.ndarray, na: np.ndarray, fb: np.ndarray | None, nb: np.ndarray | None, front: np.ndarray, distance: int, leaf: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, smaller node) of the links within a block or between two."""
    same = fb is None
    rows, nodes = (fa, na) if same else (np.concatenate((fa, fb)), np.concatenate((na, nb)))
    root = np.arange(len(nodes))
    # Neighbours in order first: what they join needs no further look.
    for k in (1, 2, 3) if same else ():
        near = np.flatnonzero(differing(rows[k:] ^ rows[:-k]) <= distance)
        root = joined_roots(root, near, near + k)
    if not same:
        for part, begin in ((fa, 0), (fb, len(fa))):
            near = np.flatnonzero(differing(part[1:] ^ part[:-1]) <= distance) + begin
            root = joined_roots(root, near, near + 1)
        few = np.arange(min(len(fa), len(fb)))
        near = few[differing(fa[few] ^ fb[few]) <= distance]
        root = joined_roots(root, near, near + len(fa))
    a = Tree(rows[: len(fa)], root[: len(fa)], leaf)
    b = a if same else Tree(fb, root[len(fa) :], leaf)
    for x, y in tree_join(a, b, same, front, distance, leaf):
        root = joined_roots(root, x, y if same else y + len(fa))
    low = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(low, root, nodes)
    low = low[root]
    out = low != nodes
    return nodes[out], low[out]


def links(prints: DataFrame, scheme: Scheme = EXACT, block_rows: int = BLOCK) -> DataFrame:
    """(a, b): links that connect what is near; ``prints`` has fp binary (distinct) and node long (distinct)."""
    spark = prints.sparkSession
    size, distance = scheme.size, scheme.distance
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(batch["fp"]), np.uint8).reshape(-1, 8 * size), axis=1)
            for o, turn in enumerate(scheme.turns):
                turned = np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits[:, turn]), axis=1)).view(">u8").astype(np.uint64)[:, 0]
                yield pd.DataFrame({"ord": np.int32(o), "rank": gray_rank(turned), "node": batch["node"].to_numpy(), "fp": batch["fp"].to_numpy()})

    order = prints.select("fp", "node").mapInPandas(ordered, "ord int, rank long, node long, fp binary")
    dealt = order.repartitionByRange(parts, "ord", "rank", "node").sortWithinPartitions("ord", "rank", "node")
    masks = [f"{side}{k}" for side in ("mask", "pattern") for k in range(size)]

    def fronts_of(ranks: pd.Series, o: int) -> np.ndarray:
        """The front bits of rows of an order, from their Gray ranks."""
        place = ranks.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
        return ((place ^ (place >> np.uint64(1))) >> np.uint64(64 - len(scheme.fronts[o]))).astype(np.int64)

    def cuts_of(front: np.ndarray) -> list[int]:
        """Where blocks begin and the last ends: whole fronts, while these fit; a front that fills more than a block is cut."""
        begins = [0, *(np.flatnonzero(np.diff(front)) + 1), len(front)]
        cuts = [0]
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            if b - cuts[-1] > block_rows and a > cuts[-1]:
                cuts.append(a)
            cuts += range(cuts[-1] + block_rows, b, block_rows)
        return [*cuts, len(front)]

    def block(rows: pd.DataFrame, front: np.ndarray) -> pd.DataFrame:
        words = words_of(list(rows["fp"]), size)
        both = np.bitwise_and.reduce(words)
        mask = ~(np.bitwise_or.reduce(words) ^ both)
        tops = dict(zip(masks, np.concatenate((mask, both)).view(np.int64), strict=True))
        return pd.DataFrame({"ord": [rows["ord"].iloc[0]], "first": [front[0]], "last": [front[-1]], "prints": [words.tobytes()], "nodes": [rows["node"].to_numpy().tobytes()], **{k: [x] for k, x in tops.items()}})

    def cut_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat((held, batch), ignore_index=True)
            for o, rows in held.groupby("ord", sort=True):  # blocks that are full go, the last one of the last order waits
                front = fronts_of(rows["rank"], o)
                cuts = cuts_of(front)
                if rows.index[-1] == held.index[-1]:
                    rest = rows.iloc[cuts[-2] :]
                    cuts.pop()
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    yield block(rows.iloc[a:b], front[a:b])
            held = rest.reset_index(drop=True)
        if held is not None:
            yield block(held, fronts_of(held["rank"], int(held["ord"].iloc[0])))

    made = dealt.mapInPandas(cut_blocks, f"ord int, first long, last long, prints binary, nodes binary, {', '.join(f'{c} long' for c in masks)}")
    blocks = cut(made.withColumn("block", F.monotonically_increasing_id()))
    # Only a block that ends or begins with a front shares it with others.  The upper node of the blocks of a range
    # that have a front is joined first; below it, those pairs of blocks that its differences leave.
    ends = blocks.select("block", F.shiftrightunsigned("block", 33).alias("part"), "ord", *masks, F.explode(F.array_distinct(F.array("first", "last"))).alias("front"))
    shared = [F.expr(f"bit_and(mask{k}) & ~(bit_or(pattern{k}) ^ bit_and(pattern{k}))").alias(f"mask{k}") for k in range(size)]
    uppers = ends.groupBy("ord", "front", "part").agg(*shared, *(F.expr(f"bit_and(pattern{k})").alias(f"pattern{k}") for k in range(size)))
    close = F.expr(" + ".join(f"bit_count((pattern{k} ^ pattern{k}_b) & mask{k} & mask{k}_b)" for k in range(size)) + f" <= {distance}")
    as_b = lambda t, *keys: t.select(*keys, *(F.col(c).alias(f"{c}_b") for c in t.columns if c not in keys))
    # A front that very many rows have lies in all ranges: its pairs of ranges are dealt to several tasks.
    salted = as_b(uppers, "ord", "front").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    upper_pairs = uppers.withColumn("salt", (F.col("part") % SALTS).cast("int")).join(salted, ["ord", "front", "salt"]).where((F.col("part") <= F.col("part_b")) & close).select("ord", "front", "part", "part_b")
    below = upper_pairs.join(ends, ["ord", "front", "part"]).join(as_b(ends, "ord", "front", "part").withColumnRenamed("part", "part_b"), ["ord", "front", "part_b"])
    pairs = below.where((F.col("block") < F.col("block_b")) & close).select("block", "block_b").distinct()
    a = blocks.select("block", "ord", "prints", "nodes")
    b = blocks.select(F.col("block").alias("block_b"), F.col("prints").alias("prints_b"), F.col("nodes").alias("nodes_b"))
    crossed = pairs.join(a, "block").join(b, "block_b").select("ord", "prints", "nodes", "prints_b", "nodes_b")
    alone = a.select("ord", "prints", "nodes", F.lit(None).cast("binary").alias("prints_b"), F.lit(None).cast("binary").alias("nodes_b"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lambda x: np.frombuffer(x, np.uint64).reshape(-1, size)
        for batch in batches:
            for o, pa, na, pb, nb in batch.itertuples(index=False):
                two = pb is not None
                x, y = block_links(read(pa), np.frombuffer(na, np.int64), read(pb) if two else None, np.frombuffer(nb, np.int64) if two else None, scheme.masks[o], distance, scheme.leaf)
                yield pd.DataFrame({"a": x, "b": y})
            give_back()

    return alone.unionByName(crossed).mapInPandas(joined, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = EXACT, block_rows: int = BLOCK) -> DataFrame:
    """One row per document: id, fp (binary) and component_id (the smallest id reachable)."""
    prints = cut(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), scheme).alias("fp")))
    distinct = cut(prints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").cast("long").alias("node")))
    found = components(links(distinct, scheme, block_rows))
    placed = distinct.join(found, "node", "left").select(F.col("fp").alias("of_fp"), F.coalesce("component", "node").alias("component_id"))
    out = prints.join(placed, F.col("fp") == F.col("of_fp"), "left")
    return out.select(F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is the smallest of their near-duplicates' (``shingles``: wide fingerprints, confirmed exactly), all columns; rows without an id stay."""
    from kairoscope.llm import shingles  # which reads the hashes above

    found = shingles.near_duplicates(docs, id_col, text_col)
    (gone_id,) = fresh(docs, "gone_id")
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone_id)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(gone_id), "left_anti")
