"""Quality classifier: supervised subword embeddings.

A text's features are its words (runs that are not white space, with their case), its pairs of neighbouring words and its
character 3-grams (code points), hashed to ``BINS`` vectors of ``DIM`` numbers.  A pair is hashed by the difference of its words' hashes, so
that a word which follows itself is one feature whatever the word.  Vectors are averaged over the document, for each of the
three kinds, and a softmax of the joined averages gives the two classes.  Vectors and output are trained together by stochastic
gradient descent in numpy on about ``PER_LABEL`` documents a label, chosen by hashed id, of ``FIT_CHARS`` characters at most.  As
the output is linear in the averages, scoring uses one number a bin: the product of vectors and output.

Nulls and ties.  A null or empty text has no features and gets the score of the bias, between 0 and 1.  Without labels
of both kinds every score is the share of label 1 (0.5 without rows).  An id with several labels has the largest.
Rows that share an id are scored each for itself.  Texts are read whole, in pieces of bounded size, and the features are the same wherever
a piece ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.llm import _fit, _hashing
from kairoscope.llm._memory import give_back

BINS, DIM = 1 << 16, 8
PER_LABEL = 2000
EPOCHS, RATE = 8, 4.0
#: Where the bins of words, of pairs and of n-grams begin, and where the last end.
EDGES = (0, BINS // 4, BINS // 2, BINS)


def binned(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (EDGES[kind] + hashes % np.uint64(EDGES[kind + 1] - EDGES[kind])).astype(np.int32)


def features(text: str) -> Iterator[list[np.ndarray]]:
    """The bins of a text, one an occurrence, of words, pairs and n-grams: piece by piece."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    words, before, tail = _hashing.Words(), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for raw, goes_on in _hashing.pieces(points, _hashing.not_spaces):
        _, _, hashes, _, _ = words.of(raw, _hashing.not_spaces(raw), goes_on)
        own = _hashing.salted(hashes, 11)
        chain, wide = np.concatenate((before, own)), np.concatenate((tail, raw.astype(np.uint64)))
        grams = wide[:-2] << np.uint64(42) | wide[1:-1] << np.uint64(21) | wide[2:]
        before, tail = chain[-1:], wide[-2:]
        yield [binned(own, 0), binned(_hashing.mixed(chain[1:] - chain[:-1]), 1), binned(_hashing.mixed(grams) >> np.uint64(13), 2)]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bins of a text and their counts."""
    total = np.zeros(BINS, np.int32)
    for parts in features(text):
        total += np.bincount(np.concatenate(parts), minlength=BINS).astype(np.int32)
    bins = np.flatnonzero(total)
    return bins.astype(np.int32), total[bins]


def kinds(bins: np.ndarray) -> list[slice]:
    """Where each kind stands in ascending bins."""
    at = np.searchsorted(bins, EDGES)
    return [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]


@dataclass
class Model:
    """gain: the log-odds that a bin adds; bias: those of an empty text; constant: the score where nothing could be learnt."""

    gain: np.ndarray
    bias: float
    constant: float | None = None

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        sums, sizes = np.zeros(len(EDGES) - 1), np.zeros(len(EDGES) - 1)
        for parts in features(text or ""):
            sums += [self.gain[p].sum(dtype=np.float64) for p in parts]
            sizes += [len(p) for p in parts]
        z = self.bias + float((sums / np.maximum(sizes, 1)).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """rows: label, distinct bins and their counts of each document."""
    labels = np.array([y for y, _, _ in rows])
    if not len(rows) or labels.min() == labels.max():
        return Model(np.zeros(BINS, np.float32), 0.0, float(labels.mean()) if len(rows) else 0.5)
    rng = np.random.default_rng(11)
    n = len(EDGES) - 1
    vectors = rng.normal(0.0, 1.0 / DIM, (BINS, DIM))
    out, bias = rng.normal(0.0, 0.1, (n, DIM, 2)), np.zeros(2)
    parts = [kinds(b) for _, b, _ in rows]
    shares = [[c[p] / max(c[p].sum(), 1) for p in ps] for (_, _, c), ps in zip(rows, parts, strict=True)]
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, bins, _ = rows[i]
            lr = rate * (1.0 - done / steps)
            done += 1
            hidden = [a @ vectors[bins[p]] for a, p in zip(shares[i], parts[i], strict=True)]
            s = bias + sum(h @ o for h, o in zip(hidden, out, strict=True))
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            for k in range(n):
                back = out[k] @ p
                out[k] -= 0.05 * lr * np.outer(hidden[k], p)
                vectors[bins[parts[i][k]]] -= lr * np.outer(shares[i][k], back)
            bias -= 0.01 * lr * p
    gain = np.empty(BINS)
    for k in range(n):
        part = slice(EDGES[k], EDGES[k + 1])
        gain[part] = vectors[part] @ (out[k][:, 1] - out[k][:, 0])
    return Model(gain.astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, rest: int = 1, per_label: int = PER_LABEL) -> Model:
    """Learn from the labelled documents of the learning fold; features are made on the executors."""

    @F.pandas_udf("bins binary, counts binary")
    def featured(texts: pd.Series) -> pd.DataFrame:
        made = [counted(t or "") for t in texts]
        return pd.DataFrame({"bins": [b.tobytes() for b, _ in made], "counts": [c.tobytes() for _, c in made]})

    rows = _fit.sampled_docs(docs, labels, label, modulus, rest, per_label).select("fit_id", "fit_label", featured("text").alias("f"))
    found = sorted(rows.select("fit_id", "fit_label", "f.bins", "f.counts").collect(), key=lambda r: (r[0], r[1], len(r[2]), zlib.crc32(r[2])))
    return train([(int(r[1]), np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.int32)) for r in found])


def score_column(text: Column, model: Model, spark) -> Column:
    shared = spark.sparkContext.broadcast(model)  # BINS numbers, whatever the corpus

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        m = shared.value
        out = pd.Series([m.score(t) for t in texts], dtype="float64")
        give_back()
        return out

    return scored(text)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score."""
    return docs.select(F.col(id_col), score_column(F.col(text_col), model, docs.sparkSession).alias("score"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    return found.select("doc_id", _fit.held_out("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
