"""Periodic runs of words: suffix automata whose end-position sets are merged small to large.

A run is a stretch of words with smallest period q that no neighbouring word extends keeping q, of at least ``max(LEAST, TIMES * q)`` words.

Method.  A text's words become numbers, and a suffix automaton is built over them.  The states are taken from the longest to the shortest, each one's ordered end
positions going into those of its suffix link, the smaller set into the larger.  A position that comes next to another one at a distance d that the state's length
reaches ends a square of period d; the square is extended both ways to a run.  Every run of q is met: the state in which the positions j - q and j first meet holds
their longest common suffix, nothing lies between them there, and it is q words long or more.  A multiple of a run's smallest period gives the same stretch, which is kept
with the smallest period that was met.

Before that, stretches that hold no run are left out, exactly: in a run of ``n >= max(6, 4q)`` words each five words in a row come again q words further or before, so a
word in no such five, or in five whose like is more than a quarter of the stretch away, is in no run; the rest is judged again until nothing goes.

Every document is a row of its own: documents are dealt by Spark, and a task holds the automaton of one stretch of one text at a time (memory in proportion to the
stretch's words).  A null text has no words; texts without words have no run; equal rows give equal rows; the id may be null or repeat, it is only passed on; further
columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.llm._memory import give_back

#: A run has so many words at least, and so many times its period.
LEAST, TIMES = 6, 4
GRAM = 5
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_SPACES = str.maketrans("\t\n\x0b\x0c\r", " " * 5)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Maximal runs of characters that are not ASCII 9 to 13 or 32."""
    return [w for w in text.translate(_SPACES).split(" ") if w]


def numbers(words: list[str]) -> np.ndarray:
    """Equal words have equal numbers."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint stretches outside of which no run has a word."""
    n = len(ids) - GRAM + 1
    if n < 2:
        return []
    grams = np.zeros(n, np.uint64)
    for k in range(GRAM):  # equal fives have equal hashes; others that happen to agree only leave more to look at
        grams = (grams + ids[k : k + n].astype(np.uint64) + np.uint64(1)) * _MIX
        grams ^= grams >> np.uint64(29)
    todo, out = [(0, len(ids))], []
    while todo:
        start, end = todo.pop()
        if end - start < LEAST:
            continue
        part = grams[start : end - GRAM + 1]
        order = np.argsort(part, kind="stable")
        near = (np.diff(part[order]) == 0) & (np.diff(order) <= (end - start) // TIMES)
        again = np.zeros(len(part), bool)
        again[order[:-1][near]] = True
        again[order[1:][near]] = True
        edge = np.zeros(end - start + 1, np.int64)
        at = np.flatnonzero(again)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + GRAM, -1)
        inside = np.concatenate(([False], np.cumsum(edge)[:-1] > 0, [False]))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        found = [(start + int(a), start + int(b)) for a, b in zip(turns[::2], turns[1::2], strict=True)]
        if found == [(start, end)]:
            out.append((start, end))
        else:
            todo += found
    return out


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, lengths, and the state of each prefix."""
    link, length, goes, prefix, last = [-1], [0], [{}], [], 0
    for w in ids:
        state = len(link)
        length.append(length[last] + 1)
        link.append(0)
        goes.append({})
        p = last
        while p >= 0 and w not in goes[p]:
            goes[p][w] = state
            p = link[p]
        if p >= 0:
            q = goes[p][w]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(link)
                length.append(length[p] + 1)
                link.append(link[q])
                goes.append(goes[q].copy())
                while p >= 0 and goes[p].get(w) == q:
                    goes[p][w] = clone
                    p = link[p]
                link[q] = link[state] = clone
        prefix.append(state)
        last = state
    return link, length, prefix


def squares(ids: list[int]) -> list[tuple[int, int]]:
    """(period, last position) of squares, those of every run's smallest period among them."""
    link, length, prefix = automaton(ids)
    ends: list[list[int] | None] = [None] * len(link)
    for i, state in enumerate(prefix):
        ends[state] = [i]
    found = []
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        own, up = ends[state], link[state]
        ends[state] = None
        if up <= 0:  # at the root nothing is common
            continue
        held, most = ends[up], length[up]
        if held is None:
            ends[up] = own
            continue
        small, large = (own, held) if len(own) < len(held) else (held, own)
        for x in small:
            at = bisect_left(large, x)
            if at < len(large) and large[at] - x <= most:
                found.append((large[at] - x, large[at]))
            if at and x - large[at - 1] <= most:
                found.append((x - large[at - 1], x))
            large.insert(at, x)
        ends[up] = large
    return found


def extended(ids: np.ndarray, last: int, period: int) -> tuple[int, int]:
    """The stretch [start, end) around position ``last`` in which words ``period`` apart are equal; blocks grow as long as they agree."""
    end, width = last + 1, 16
    while end < len(ids):
        stop = min(len(ids), end + width)
        off = np.flatnonzero(ids[end:stop] != ids[end - period : stop - period])
        if len(off):
            end += int(off[0])
            break
        end, width = stop, width * 2
    start, width = last - period + 1, 16  # ids[start:] agrees with what lies a period before it from here on
    while start > period:
        stop = max(period, start - width)
        off = np.flatnonzero(ids[stop:start] != ids[stop - period : start - period])
        if len(off):
            start = stop + int(off[-1]) + 1
            break
        start, width = stop, width * 2
    return start - period, end


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    kept: dict[tuple[int, int], int] = {}
    for begin, stop in stretches(ids):
        known: dict[int, tuple[list[int], list[int]]] = {}
        for period, last in squares(ids[begin:stop].tolist()):
            starts, ends = known.setdefault(period, ([], []))
            at = bisect_right(starts, begin + last - 2 * period + 1)
            if at and begin + last < ends[at - 1]:
                continue
            start, end = extended(ids, begin + last, period)
            at = bisect_left(starts, start)
            starts.insert(at, start)
            ends.insert(at, end)
            if end - start >= max(LEAST, TIMES * period):
                kept[start, end] = min(period, kept.get((start, end), period))
    return sorted((s, e - s, q) for (s, e), q in kept.items())


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> str:
    """The words that no run holds behind its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return " ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep)])


def found_runs(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        words = words_of(text or "")
        runs = find_runs(numbers(words))
        rows.append((len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], collapsed(words, runs)))
    give_back()
    return pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, n_words, runs (start, length, period; by start, then period) and the collapsed text."""
    # Said to be nondeterministic, so that Spark evaluates it once and apart, however its columns are used.
    found = F.pandas_udf(found_runs, f"n_words long, runs {RUNS}, collapsed string").asNondeterministic()
    return docs.select(F.col(id_col), found(F.col(text_col)).alias("r")).select(id_col, "r.*")


def planted(hashes: pd.Series, texts: pd.Series) -> pd.Series:
    """The query's texts: where the id's crc32 leaves 0 modulo 10 the words from a on are made periodic, by the contract's a and p; the others as they are."""
    out = []
    for h, text in zip(hashes.fillna(1).astype("int64"), texts, strict=True):
        words = words_of(text or "") if h % 10 == 0 else []
        if words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[:a] + [words[a + i % p] for i in range(n - a)])
        out.append(text)
    return pd.Series(out, dtype="object")


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = F.pandas_udf(planted, "string").asNondeterministic()
    docs = docs.select("doc_id", made(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words", top.alias("top")).select(
        "doc_id", "n_runs", (-F.col("top.s")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.p")).alias("period"), F.floor(1000 * F.col("top.length") / -F.col("top.p")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words"
    )
