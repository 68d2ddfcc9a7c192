"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, everything but letters becomes one space, and its 1-, 2- and 3-grams are hashed to
``BINS``.  Counts are damped (1 + log), weighted by the inverse document frequency and scaled to length 1.
Document frequencies are counted over every document of the learning fold (summed by bin on the
executors); the weights are learnt on the driver by follow-the-regularised-leader with an elastic-net
penalty from about ``PER_LABEL`` documents a language (fewer where that makes more than ``SAMPLE`` of all), chosen by hashed id; and the
temperature of the softmax is fitted on a fifth of these that the learner doesn't see.

Results.  A text that is null or has no letter is ``und`` with score 0.0.  Without any labelled row
every text is ``und``.  Rows that share an id are read each for itself; a null label teaches
nothing; an empty table gives no rows.  Every language is learnt; above ``MOST_LABELS`` the driver couldn't hold the fit, so it raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.llm import _fit
from kairoscope.llm._memory import give_back
from kairoscope.session import cut

BINS = 1 << 15
ORDERS = (1, 2, 3)
PER_LABEL, SAMPLE, MOST_LABELS = 800, 20_000, 300
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-3, 1e-3, 3
UNKNOWN = "und"
_PIECE = 1 << 18


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The bins that a text has and how often; empty where it has no letter."""
    total = np.zeros(BINS, np.int64)
    tail = np.array([32], np.uint64)
    some, before = False, True
    text = text.lower()  # whole: how a sigma is lowered depends on what lies beside it
    for at in range(0, len(text), _PIECE):
        raw = code_points(text[at : at + _PIECE])
        letter = letters()[raw]
        some = some or bool(letter.any())
        held = letter | np.concatenate(([before], letter[:-1]))  # one space for a run of others
        before = bool(letter[-1])
        now = np.where(letter, raw, 32)[held].astype(np.uint64)
        full = np.concatenate((tail, now))
        for n in ORDERS:
            if len(full) < n:
                continue
            h = np.full(len(full) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ full[k : len(full) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            new = h[max(0, len(tail) - n + 1) :]
            total += np.bincount((new >> np.uint64(20)).astype(np.int64) & (BINS - 1), minlength=BINS)
        tail = full[-(max(ORDERS) - 1) :]
    bins = np.flatnonzero(total) if some else np.zeros(0, np.int64)
    return bins.astype(np.int32), total[bins].astype(np.int32)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # bins x labels
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def vector(self, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1.0 + np.log(counts)) * self.idf[bins]
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def logits(self, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(bins, counts) @ self.weights[bins] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        bins, counts = counts_of(text or "")
        if not len(bins) or not self.labels:
            return UNKNOWN, 0.0
        z = self.logits(bins, counts) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], frequency: np.ndarray, documents: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> Model:
    """rows: label, bins and counts of each sampled document, in an order that doesn't depend on the run."""
    labels = sorted({y for y, _, _ in rows})
    model = Model(labels, np.zeros((BINS, len(labels))), np.zeros(len(labels)), np.log((1.0 + documents) / (1.0 + frequency)) + 1.0)
    rows = [r for r in rows if len(r[1])]
    if len(labels) < 2 or not rows:
        return model
    place = {y: i for i, y in enumerate(labels)}
    order = np.random.default_rng(7).permutation(len(rows))
    tuning, learning = [rows[i] for i in order[::5]], [rows[i] for i in np.delete(order, np.arange(0, len(order), 5))]
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    zb, nb = np.zeros(len(labels)), np.zeros(len(labels))

    def leader(z: np.ndarray, n: np.ndarray, penalty: float) -> np.ndarray:
        """The weights that follow the regularised leader."""
        return np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for y, bins, counts in learning:
            v = model.vector(bins, counts)
            w, b = leader(z[bins], n[bins], l1), leader(zb, nb, 0.0)
            s = v @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[place[y]] -= 1.0
            g = v[:, None] * p
            z[bins] += g - (np.sqrt(n[bins] + g * g) - np.sqrt(n[bins])) / alpha * w
            n[bins] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * b
            nb += p * p
    model.weights, model.bias = leader(z, n, l1), leader(zb, nb, 0.0)
    model.temperature = calibrated(np.array([model.logits(b, c) for _, b, c in tuning]), np.array([place[y] for y, _, _ in tuning]))
    return model


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), labels]).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", modulus: int = 4, rest: int = 2, per_label: int = PER_LABEL) -> Model:
    """Learn from the labelled documents of the learning fold: frequencies from all of them, weights from the sample."""
    fold = docs.where(F.col(label_col).isNotNull() & ~_fit.held_out(id_col, modulus, rest)).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("y"))
    fold = fold.withColumn("h", F.xxhash64(F.col("i").cast("string"), "t", F.lit("sample")))
    rows = cut(fold.groupBy("y", "h").agg(F.count("*").alias("n")))  # rows of one id and text are one row of the sample
    counts = rows.groupBy("y").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"the documents have more than {MOST_LABELS} languages; a fit learns {MOST_LABELS} at most")
    if not counts:
        return Model([], np.zeros((BINS, 0)), np.zeros(0), np.zeros(BINS))
    quota = min(per_label, max(1, SAMPLE // len(counts)))
    # The smallest hashes of each label: those under twice the share that gives the quota, and of these the first, by rank.
    share = {r["y"]: min(1.0, 2 * (quota + 50) / r["distinct"]) for r in counts}
    low = F.pmod(F.xxhash64("h"), F.lit(1_000_000)) / 1_000_000.0
    near = rows.where(F.coalesce(*(F.when((F.col("y") == k) & (low < v), True) for k, v in share.items()), F.lit(False)))
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("h"), "h"))).where(F.col("place") <= quota)
    chosen = first.select(F.col("y").alias("of_y"), F.col("h").alias("of_h"), F.lit(True).alias("s"))
    drawn = fold.join(F.broadcast(chosen), (F.col("y") == F.col("of_y")) & (F.col("h") == F.col("of_h")), "left")  # SAMPLE rows at most

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequency, sent = np.zeros(BINS, np.int64), set()
        for batch in batches:
            label, place, bins, often = [], [], [], []
            for t, y, s, h in zip(batch["t"], batch["y"], batch["s"], batch["h"], strict=True):
                b, c = counts_of(t or "")
                frequency[b] += 1
                if s and (y, h) not in sent:  # SAMPLE of them at most
                    sent.add((y, h))
                    label.append(y)
                    place.append(h)
                    bins.append(b.tobytes())
                    often.append(c.tobytes())
            if label:
                yield pd.DataFrame({"y": label, "h": place, "bins": bins, "counts": often})
        used = np.flatnonzero(frequency)
        if len(used):
            yield pd.DataFrame({"y": [None], "h": [0], "bins": [used.astype(np.int32).tobytes()], "counts": [frequency[used].astype(np.int32).tobytes()]})

    made = cut(drawn.select("t", "y", F.coalesce("s", F.lit(False)).alias("s"), "h").mapInPandas(counted, "y string, h long, bins binary, counts binary"))

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b, c in zip(batch["bins"], batch["counts"], strict=True):
                yield pd.DataFrame({"bin": np.frombuffer(b, np.int32), "n": np.frombuffer(c, np.int32).astype(np.int64)})

    by_bin = made.where(F.col("y").isNull()).mapInPandas(unpacked, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    frequency = np.zeros(BINS)
    for r in by_bin.collect():  # at most BINS rows
        frequency[r["bin"]] = r["n"]
    rows = sorted(((r[0], bytes(r[1]), bytes(r[2])) for r in made.where(F.col("y").isNotNull()).dropDuplicates(["y", "h"]).select("y", "bins", "counts").collect()))
    return train([(y, np.frombuffer(b, np.int32), np.frombuffer(c, np.int32)) for y, b, c in rows], frequency, sum(r["n"] for r in counts))


def predict_column(text: Column, model: Model, spark) -> Column:
    """struct(lang_pred, score) of a text."""
    shared = spark.sparkContext.broadcast(model)  # BINS x MOST_LABELS weights at most, whatever the corpus

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        out = pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score"])
        give_back()
        return out

    return predicted(text)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score."""
    found = docs.select(F.col(id_col), predict_column(F.col(text_col), model, docs.sparkSession).alias("p"))
    return found.select(id_col, "p.lang_pred", "p.score")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs, fit(docs))
    return found.select("doc_id", _fit.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
