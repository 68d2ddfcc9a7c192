"""Byte stretches that repeat anywhere in a corpus: suffix buckets, sorted one at a time, after the ranks of a difference cover.

A byte goes if a string of ``WINDOW`` bytes that covers it starts anywhere else too, in the same text or in another one.

Cover.  ``COVER`` is a difference cover of the numbers below ``MODULUS``: for any two positions there is a shift below MODULUS that brings both into it.  So two
equal windows hold, at the same shift, two cover samples whose first ``SAMPLE`` = WINDOW - MODULUS + 1 bytes are equal.  The samples (a ninth of all positions) are sorted first,
bucket by bucket; one whose string has no like is alone in the corpus and decides every tie of the windows that hold it.

Blocks.  Only suffixes that hold a sample with a like, less than MODULUS positions on, can tie with another one over WINDOW bytes.  They are dealt into buckets and sorted, one bucket
at a time, and those that tie come back as a mask.  Strings are compared by hashes and not letter by letter, for equality is all that is asked of the order: 40 bits
and the bucket's for samples (a sample too many only leaves more to sort), 80 bits and the bucket's for windows.

Distribution.  Texts, each distinct one once, are packed in chunks of about ``CHUNK`` bytes, which are written to the shared folder in buckets by chunk, so that masks come back
to them without moving them again.  What a chunk holds twice is known there, and it sends a string once, so a passage that very many texts share is one entry a chunk. Buckets hold about ``BUCKET``
entries; no task holds more than a chunk or a bucket.  Texts with a copy are all repeated and only found in by others.

Odd rows.  A null text is empty; texts under WINDOW bytes hold no window; equal rows give equal rows, each wholly removed (of WINDOW bytes or more), and the id may be null or repeat;
further columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.llm._hashing import mixed
from kairoscope.llm._memory import give_back
from kairoscope.session import cut, ensure_checkpoint_dir

WINDOW = 200
#: A perfect difference set: each number below MODULUS is the difference of two of these, modulo MODULUS.
COVER, MODULUS = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81), 91
SAMPLE = WINDOW - MODULUS + 1
CHUNK, BUCKET, PIECE = 1 << 21, 1 << 19, 1 << 18
#: Bytes of text of a partition of chunks, where the session asks for fewer partitions; and the most buckets that Spark writes.
PART, MOST_PARTS = 1 << 26, 100_000
SAMPLE_BYTES, WINDOW_BYTES = 5, 10
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_IS_COVER = np.isin(np.arange(MODULUS), COVER)


@lru_cache(2)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def string_hashes(raw: np.ndarray, size: int, wanted: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hashes of the strings of ``size`` bytes from the wanted positions (ascending) on."""
    up, down = _powers(base, PIECE + WINDOW)
    out = np.zeros(len(wanted), np.uint64)
    cuts = np.searchsorted(wanted, np.arange(0, len(raw) + PIECE, PIECE))
    for k, at in enumerate(range(0, len(raw), PIECE)):
        low, high = cuts[k], cuts[k + 1]
        if low < high:
            part = raw[at : at + PIECE + size].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            here = wanted[low:high] - at
            out[low:high] = mixed((sums[here + size] - sums[here]) * down[here])
    return out


class Chunk:
    """Texts behind one another, and which strings of theirs are sent to which bucket."""

    def __init__(self, blob: bytes, ends: bytes) -> None:
        self.raw, self.ends = np.frombuffer(blob, np.uint8), np.frombuffer(ends, np.int64)
        self.begins = np.concatenate(([0], self.ends[:-1]))

    def samples(self) -> np.ndarray:
        found = [b + np.flatnonzero(_IS_COVER[np.arange(e - b - SAMPLE + 1) % MODULUS]) for b, e in zip(self.begins, self.ends, strict=True)]
        return np.concatenate(found)

    def suffixes(self, alike: np.ndarray) -> np.ndarray:
        """Positions of windows that hold a sample with a like at their first MODULUS positions."""
        edge = np.zeros(len(self.raw) + 1, np.int32)
        np.add.at(edge, np.maximum(alike - MODULUS + 1, 0), 1)
        np.add.at(edge, alike + 1, -1)
        inside = np.cumsum(edge[:-1]) > 0
        for b, e in zip(self.begins, self.ends, strict=True):
            inside[max(b, e - WINDOW + 1) : e] = False
        return np.flatnonzero(inside)


class Sent:
    """The distinct strings of a chunk from some positions on, by bucket and hash, and which of the positions hold each."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, size: int, width: int, bits: int) -> None:
        first = string_hashes(raw, size, at)
        high = first >> np.uint64(64 - bits) if bits else np.zeros(len(at), np.uint64)
        if width <= 8:
            low = (first << np.uint64(bits)) >> np.uint64(64 - 8 * width)
            second = np.zeros(len(at), np.uint64)
        else:  # the bucket is of the first hash; all of that and a part of another one are sent
            low = first
            second = string_hashes(raw, size, at, BASES[1]) >> np.uint64(64 - 8 * (width - 8))
        order = np.lexsort((second, low, high))
        high, low, second = high[order], low[order], second[order]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(high) != 0) | (np.diff(low) != 0) | (np.diff(second) != 0)
        self.order, self.group = order, np.cumsum(new) - 1
        self.count = np.bincount(self.group, minlength=1) if len(at) else np.zeros(0, int)
        self.high, self.width = high[new], width
        self.low, self.second = low[new], second[new]
        self.buckets, self.starts = np.unique(self.high, return_index=True)
        self.stops = np.append(self.starts[1:], len(self.high))

    def rows(self) -> Iterator[tuple[int, bytes]]:
        for bucket, a, b in zip(self.buckets, self.starts, self.stops, strict=True):
            body = self.low[a:b].view(np.uint8).reshape(-1, 8)[:, : min(self.width, 8)]
            if self.width > 8:
                body = np.concatenate((body, self.second[a:b].view(np.uint8).reshape(-1, 8)[:, : self.width - 8]), axis=1)
            yield int(bucket), np.ascontiguousarray(body).tobytes()

    def repeated(self, buckets: list[int], masks: list[bytes]) -> np.ndarray:
        """Which of the positions hold a string that this chunk or another one has again; the masks are those that came back."""
        again = self.count > 1
        place = {int(b): k for k, b in enumerate(self.buckets)}
        for bucket, mask in zip(buckets, masks, strict=True):
            a, b = self.starts[place[bucket]], self.stops[place[bucket]]
            again[a:b] |= np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a).astype(bool)
        out = np.zeros(len(self.order), bool)
        out[self.order] = again[self.group]
        return out


def _bits(entries: int) -> int:
    """So many bits of the hash name a bucket that one has about BUCKET entries."""
    return max(0, (max(entries, 1) - 1) // BUCKET).bit_length()


def ties(sent: DataFrame, width: int) -> DataFrame:
    """chunk, bucket, mask: which strings of each row (bucket, chunk, body) another row of the bucket has too."""

    def sort(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["body"].map(len).to_numpy() // width
        flat = np.frombuffer(b"".join(rows["body"]), np.uint8).reshape(-1, width)
        wide = np.zeros((len(flat), 8 * -(-width // 8)), np.uint8)
        wide[:, :width] = flat
        keys = wide.view(np.uint64)
        order = np.lexsort(keys.T)
        same = (np.diff(keys[order], axis=0) == 0).all(1) if len(order) > 1 else np.zeros(0, bool)
        again = np.zeros(len(flat), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        out, at = [], 0
        for chunk, bucket, n in zip(rows["chunk"], rows["bucket"], sizes, strict=True):
            if again[at : at + n].any():
                out.append((chunk, bucket, np.packbits(again[at : at + n]).tobytes()))
            at += n
        give_back()
        return pd.DataFrame(out, columns=["chunk", "bucket", "mask"])

    return sent.groupBy("bucket").applyInPandas(sort, "chunk long, bucket long, mask binary")


def _texts(long: DataFrame, chunks: int, parts: int) -> DataFrame:
    """The chunks of the distinct texts (key binary, body binary): chunk, keys, ends, blob; in the shared folder, in buckets by chunk."""
    spark = long.sparkSession

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()  # a text that a task has very often is sent once
        for batch in batches:
            new = []
            for key in map(bytes, batch["key"]):
                new.append(key not in seen)
                seen.add(key)
            if len(seen) > 1 << 20:
                seen.clear()
            yield batch[new]

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("key").sort_values("key")
        ends = np.cumsum(rows["body"].map(len).to_numpy(np.int64))
        out = pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "keys": [b"".join(rows["key"])], "ends": [ends.tobytes()], "blob": [b"".join(rows["body"])]})
        give_back()
        return out

    dealt = long.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks))).mapInPandas(once, "key binary, body binary, chunk long")
    packed = dealt.groupBy("chunk").applyInPandas(pack, "chunk long, keys binary, ends binary, blob binary")
    ensure_checkpoint_dir(spark)
    name = f"repeats_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    writer = packed.repartition(parts, "chunk").write.bucketBy(parts, "chunk").option("path", path).option("compression", "zstd").option("parquet.block.size", str(CHUNK)).option("parquet.enable.dictionary", "false")
    writer.saveAsTable(name)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.table(name)


def _replies(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "mask")).alias(name))


def _of_chunks(table: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(chunk, Chunk, keys, *replies)`` on each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, keys, ends, blob, *replies in batch.itertuples(index=False):
                told = [([] if r is None else [x["bucket"] for x in r], [] if r is None else [x["mask"] for x in r]) for r in replies]
                yield work(chunk, Chunk(blob, ends), keys, *told)
                give_back()

    return table.mapInPandas(run, schema)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the bytes that remain)."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    spark = docs.sparkSession
    keyed = cut(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(body, 256)).alias("key"), F.octet_length(body).cast("long").alias("n_bytes")))
    held = keyed.where(F.col("n_bytes") >= WINDOW).groupBy("key").agg(F.count("*").alias("copies"), F.max("n_bytes").alias("n"))
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    chunks = max(1, total // CHUNK)
    parts = int(min(chunks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART), MOST_PARTS))
    long = docs.select(F.unhex(F.sha2(body, 256)).alias("key"), body.alias("body")).where(F.octet_length("body") >= WINDOW)
    table = _texts(long, chunks, parts)
    bits = _bits(total * len(COVER) // MODULUS)
    sent_schema = "bucket long, chunk long, body binary"

    def ask(chunk: int, c: Chunk, keys: bytes) -> pd.DataFrame:
        sent = Sent(c.raw, c.samples(), SAMPLE, SAMPLE_BYTES, bits)
        return pd.DataFrame([(b, chunk, x) for b, x in sent.rows()], columns=["bucket", "chunk", "body"])

    samples = cut(_replies(ties(_of_chunks(table, ask, sent_schema), SAMPLE_BYTES), "samples"))

    def suffixes(c: Chunk, told: tuple[list[int], list[bytes]]) -> np.ndarray:
        at = c.samples()
        return c.suffixes(at[Sent(c.raw, at, SAMPLE, SAMPLE_BYTES, bits).repeated(*told)])

    def block(chunk: int, c: Chunk, keys: bytes, told: tuple[list[int], list[bytes]]) -> pd.DataFrame:
        sent = Sent(c.raw, suffixes(c, told), WINDOW, WINDOW_BYTES, bits)
        return pd.DataFrame([(b, chunk, x) for b, x in sent.rows()], columns=["bucket", "chunk", "body"])

    both = table.join(samples, "chunk", "left").select("chunk", "keys", "ends", "blob", "samples")
    windows = cut(_replies(ties(_of_chunks(both, block, sent_schema), WINDOW_BYTES), "windows"))

    def removed(chunk: int, c: Chunk, keys: bytes, told: tuple, back: tuple) -> pd.DataFrame:
        at = suffixes(c, told)
        hits = at[Sent(c.raw, at, WINDOW, WINDOW_BYTES, bits).repeated(*back)]
        edge = np.zeros(len(c.raw) + 1, np.int32)
        np.add.at(edge, hits, 1)
        np.add.at(edge, hits + WINDOW, -1)
        gone = np.cumsum(edge[:-1]) > 0
        rows = []
        for k, (b, e) in enumerate(zip(c.begins, c.ends, strict=True)):
            g = gone[b:e]
            spans = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1]))
            rows.append((keys[32 * k : 32 * k + 32], int(g.sum()), spans, hashlib.sha256(c.raw[b:e][~g].tobytes()).hexdigest()))
        return pd.DataFrame(rows, columns=["of_key", "n_removed", "n_spans", "kept_sha256"])

    last = both.join(windows, "chunk", "left").select("chunk", "keys", "ends", "blob", "samples", "windows")
    found = _of_chunks(last, removed, "of_key binary, n_removed long, n_spans long, kept_sha256 string")
    copied = F.col("copies") > 1
    per_text = held.join(found, F.col("key") == F.col("of_key")).select(
        "of_key",
        F.when(copied, F.col("n")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copied, 1).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
    out = keyed.join(cut(per_text), F.col("key") == F.col("of_key"), "left")
    whole = F.lower(F.hex("key"))
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce(F.col("n_spans").cast("long"), zero).alias("n_spans"), F.coalesce("kept_sha256", whole).alias("kept_sha256"))


def op12_repeated_bytes(spark, sf_dir: str) -> DataFrame:
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
