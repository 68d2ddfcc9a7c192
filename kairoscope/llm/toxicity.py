"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence has the score ``p = sigmoid(b + sum of weights)`` over its
hashed words and word prefixes, each once; the document's score is the noisy-or ``1 - prod(1 - p)``.
Weights are trained from document labels alone, by proximal gradient steps on the log-likelihood of the noisy-or with an
L1 penalty, so the gradient of a toxic document goes to the sentences that explain it, and
those are then the ones that it points at.

Fitting uses at most about ``PER_LABEL`` documents a label, chosen by hashed id, of ``FIT_CHARS`` characters at most; features are made on the
executors and only those of the sample reach the driver.  Scoring reads every whole text.

Nulls and ties.  A null or empty text is one empty sentence: its score is that of the bias.  Without labelled rows of both
kinds every score is the share of label 1 (0.0 without rows).  An id with several labels has the largest.  Rows that
share an id are scored each for itself.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.llm import _fit, _hashing
from kairoscope.llm._memory import give_back

BINS = 1 << 18
PREFIXES = (3, 4, 5)
#: Documents a label, at most about, in a fit.
PER_LABEL = 3000
THRESHOLD = 0.3
#: Rounds of steps, step size, penalty, first bias of a sentence, and the sampled documents that must hold a bin.
EPOCHS, RATE, L1, BIAS, LEAST_BAGS = (40, 400), 0.1, 3e-4, -7.0, 3
STRETCH = 1 << 20


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of a text's sentences, the number of bins of each sentence, and each sentence's first and last byte (n x 2)."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    words, bins, counts, extents = _hashing.Words(), [], [], []
    open_bins, begin, at = np.zeros(0, np.int64), 0, 0  # of the sentence that goes on
    binned = lambda h: (h & np.uint64(BINS - 1)).astype(np.int64)
    for raw, goes_on in _hashing.pieces(data, _hashing.letters):
        began = words.length > 0
        starts, ends, hashes, sums, older = words.of(raw, _hashing.letters(raw), goes_on)
        stops = np.flatnonzero(_hashing.stops(raw)) + 1
        made = [(starts, _hashing.salted(hashes, 1))]
        first, last = (np.zeros(int(not began), np.int64), np.full(int(not began), len(raw))) if goes_on else (starts[older:], ends[older:])
        for n in PREFIXES:
            long = last - first > n
            made.append((first[long], _hashing.spans_hash(sums, first[long], first[long] + n, 2 + n)))
        sentence = np.searchsorted(stops, np.concatenate([s for s, _ in made]), side="right").astype(np.int64)
        code = np.unique(np.concatenate((open_bins, sentence * BINS + binned(np.concatenate([h for _, h in made])))))
        closed = code[code < len(stops) * BINS]
        n = np.bincount(closed // BINS, minlength=len(stops))
        edges = np.stack((np.concatenate(([begin], stops[:-1] + at)), stops + at), 1) if len(stops) else np.zeros((0, 2), np.int64)
        bins.append((closed % BINS).astype(np.int32))
        counts.append(n[n > 0].astype(np.int32))
        extents.append(edges[n > 0])
        open_bins, begin, at = code[len(closed) :] % BINS, int(edges[-1, 1]) if len(stops) else begin, at + len(raw)
    if len(open_bins):
        bins.append(open_bins.astype(np.int32))
        counts.append(np.array([len(open_bins)], np.int32))
        extents.append(np.array([[begin, len(data)]]))
    if not sum(map(len, counts)):
        return np.zeros(0, np.int32), np.zeros(1, np.int32), np.array([[0, len(data)]])
    return np.concatenate(bins), np.concatenate(counts), np.concatenate(extents)


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))[np.concatenate(([0], np.cumsum(counts)))]
    return np.diff(ends)


@dataclass
class Model:
    """weights a bin, and the bias of a sentence; constant: the score where nothing could be learnt."""

    weights: np.ndarray
    bias: float
    constant: float | None = None

    def sentence_scores(self, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = self.bias + sums_by(self.weights[bins], counts)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))

    def score(self, text: str) -> tuple[float, np.ndarray, np.ndarray]:
        bins, counts, extents = features(text)
        if self.constant is not None:
            return self.constant, np.zeros(len(counts)), extents
        p = self.sentence_scores(bins, counts)
        return float(-np.expm1(np.sum(np.log1p(-np.minimum(p, 1 - 1e-12))))), p, extents


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], epochs: tuple[int, ...] = EPOCHS, rate: float = RATE, l1: float = L1) -> Model:
    """bags: label, bins and counts of each document; they are taken out of the list.

    epochs: steps of each round; after a round only the bins with a weight stay in, so later ones are short.
    """
    labels = np.array([y for y, _, _ in bags], np.float64)
    if not len(bags) or labels.min() == labels.max():
        return Model(np.zeros(BINS, np.float32), 0.0, float(labels.mean()) if len(bags) else 0.0)
    in_bags = np.zeros(BINS, np.int32)
    for _, b, _ in bags:
        in_bags[np.unique(b)] += 1
    keep = in_bags >= LEAST_BAGS
    size = np.array([len(c) for _, _, c in bags])
    of_bag = np.repeat(np.arange(len(bags), dtype=np.int32), size)
    # Only bins that may have a weight are gathered, and each document's goes as soon as it is.
    total = sum(int(keep[b].sum()) for _, b, _ in bags)
    bins, of_sentence, at, first = np.empty(total, np.int32), np.empty(total, np.int32), 0, 0
    for k, (_, b, c) in enumerate(bags):
        held = keep[b]
        n = int(held.sum())
        bins[at : at + n], of_sentence[at : at + n] = b[held], (first + np.repeat(np.arange(len(c), dtype=np.int32), c))[held]
        at, first, bags[k] = at + n, first + len(c), None
    share = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    weights, b = np.zeros(BINS), BIAS
    for n in epochs:
        if not keep.all():
            held = keep[bins]
            bins, of_sentence = bins[held], of_sentence[held]
        used = np.flatnonzero(np.bincount(bins, minlength=BINS))
        place = np.zeros(BINS, np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        local = place[bins]
        first = np.flatnonzero(np.diff(of_sentence, prepend=-1))  # sentences ascend
        counts = np.diff(first, append=len(local))
        bag = of_bag[of_sentence[first]]
        # Sums go over the bins in stretches of whole sentences, so what they need besides is small.
        cuts = np.unique(np.searchsorted(first, [*range(0, len(local), STRETCH), len(local)]))
        stretches = [(i, j, first[i], first[j] if j < len(first) else len(local)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        empty = size - np.bincount(bag, minlength=len(bags))  # sentences without a bin are alike
        z = np.empty(len(first))
        w, m, v, mb, vb = weights[used], np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
        for t in range(1, n + 1):
            for i, j, lo, hi in stretches:
                z[i:j] = b + np.add.reduceat(w[local[lo:hi]], first[i:j] - lo)
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
            plain = 1.0 / (1.0 + np.exp(-np.clip(b, -30, 30)))
            some = -np.expm1(np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags)) + empty * np.log1p(-min(plain, 1 - 1e-12)))
            # Towards larger z: -p in a clean bag, p (1 - P) / P in a toxic one.
            pull = share * np.where(labels > 0, (1 - some) / np.maximum(some, 1e-12), -1.0)
            push = pull[bag] * p
            g, s = np.zeros(len(used)), push.sum() + plain * (pull * empty).sum()
            for i, j, lo, hi in stretches:
                g += np.bincount(local[lo:hi], np.repeat(push[i:j], counts[i:j]), len(used))
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * s, 0.99 * vb + 0.01 * s * s
            step = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
            w = w + step * m / (1 - 0.9**t)
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0.0)
            b += rate * mb / (1 - 0.9**t) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
        weights[:] = 0.0
        weights[used] = w
        keep = weights != 0
    return Model(weights.astype(np.float32), float(b))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, rest: int = 2, per_label: int = PER_LABEL) -> Model:
    """Learn from the labelled documents of the learning fold."""

    @F.pandas_udf("bins binary, counts binary")
    def featured(texts: pd.Series) -> pd.DataFrame:
        made = [features(t or "") for t in texts]
        return pd.DataFrame({"bins": [b.tobytes() for b, _, _ in made], "counts": [c.tobytes() for _, c, _ in made]})

    rows = _fit.sampled_docs(docs, labels, label, modulus, rest, per_label).select("fit_id", "fit_label", featured("text").alias("f"))
    found = rows.select("fit_id", "fit_label", "f.bins", "f.counts").collect()
    found.sort(key=lambda r: (r[0], r[1], len(r[2]), zlib.crc32(r[2])))
    bags = []
    while found:
        _, y, b, c = found.pop()
        bags.append((int(y), np.frombuffer(b, np.int32), np.frombuffer(c, np.int32)))
    model = train(bags)
    give_back(0.0)
    return model


def scorer(model: Model, spark):
    """A column function: text to its score."""
    shared = spark.sparkContext.broadcast(model)  # BINS weights, whatever the corpus

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        m = shared.value
        out = pd.Series([m.score(t or "")[0] for t in texts], dtype="float64")
        give_back()
        return out

    return scored


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, score, and the offending sentences (first, last character, score) of half the threshold or more where the score reaches it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, sentences array<struct<first:long,last:long,score:double>>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        m, out = shared.value, []
        for t in texts:
            total, p, extents = m.score(t or "")
            found = []
            if total >= threshold and t:
                data = t.lower().encode("utf-8", "surrogatepass")
                at = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) if data else np.zeros(0, int)
                if len(t.lower()) != len(t):  # a few letters become several with their case
                    at = np.repeat(np.arange(1, len(t) + 1), [len(c.lower()) for c in t])[at - 1]
                char = lambda byte: int(at[byte - 1]) if byte else 0
                found = [(char(a), char(b), float(x)) for (a, b), x in zip(extents, p, strict=True) if x >= threshold / 2]
            out.append((total, found))
        give_back()
        return pd.DataFrame(out, columns=["score", "sentences"])

    return docs.select(F.col(id_col), scored(F.col(text_col)).alias("s")).select(id_col, "s.score", "s.sentences")


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, all columns."""
    return docs.where(scorer(model, docs.sparkSession)(F.col(text_col)) < threshold)


def rejected(score_col: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(score_col >= threshold, 1).otherwise(0)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    return found.select("doc_id", _fit.held_out("doc_id", 4, 2).alias("held_out"), "score", rejected(F.col("score")).alias("predicted"), "sentences")
