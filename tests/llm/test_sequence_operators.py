"""Periodic runs, repeated bytes and the prefix trie against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoscope.llm import repeats, runs, trie
from kairoscope.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_removed int, runs string, n_words string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts):
    """doc_id and text, with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", -1, "x", "y") for i, t in texts], SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# 11


def naive_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            s = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found.setdefault((s - q, i), q)  # the smallest period comes first
            i = max(i, s) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_runs_against_all_periods():
    rng = random.Random(4)
    for trial in range(1500):
        n, letters = rng.randrange(0, 70), rng.choice((1, 2, 2, 3, 5, 20))
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(4)):  # planted, also inside each other
            at, q = rng.randrange(n + 1), rng.randrange(1, 9)
            w[at:at] = (w[at : at + q] or [7]) * rng.randrange(3, 9)
        assert runs.find_runs(np.array(w, np.int64)) == naive_runs(w), w


def test_every_seed_is_met_without_the_filter():
    rng = random.Random(5)
    for _ in range(300):
        w = [rng.randrange(2) for _ in range(60)] + [0, 1, 1] * rng.randrange(5, 9)
        ids = np.array(w, np.int64)
        met = {(*runs.extended(ids, last, q), q) for q, last in runs.squares(w)}
        assert {(s, s + n, q) for s, n, q in naive_runs(w)} <= met


def rebuilt(i, text):
    w, h = SPACE.findall(text or ""), zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    return w


def run_row(i, text):
    w = rebuilt(i, text)
    found = naive_runs(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    return (i, len(found), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def by_text(rows):
    return sorted(rows, key=str)


def test_runs_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, "la " * 3000 + "x"), (None, "a b c d " * 9), (5, "a\x0bb\x0ca b\ra b a b a b"), (6, "é 😀 " * 8 + " "), (6, "é 😀 " * 8 + " ")]
    texts += [(k, " ".join(rng.choice("a b c the of it run day".split()) for _ in range(rng.randrange(120)))) for k in range(10, 150)]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r[c] for c in RUN_COLUMNS) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()]
    assert by_text(got) == by_text(run_row(*x) for x in texts)
    none = runs.periodic_runs(documents(spark, []))
    assert none.columns == ["doc_id", "n_words", "runs", "collapsed"] and none.count() == 0


def test_runs_query_on_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in RUN_COLUMNS) for r in QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    short = [r for r in docs if len(r["text"] or "") < 12_000]
    assert len(got) == len(docs) and len(short) > len(docs) * 0.8
    for r in short:
        assert got[r["doc_id"]] == run_row(r["doc_id"], r["text"])


# 12


def byte_rows(texts, size=200):
    raw = [(t or "").encode() for _, t in texts]
    seen = defaultdict(int)
    for b in raw:
        for k in range(len(b) - size + 1):
            seen[b[k : k + size]] += 1
    out = []
    for (i, _), b in zip(texts, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = True
        spans = int(np.count_nonzero(gone[:-1] & ~np.concatenate(([False], gone[:-2])))) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone, strict=False) if not g))))
    return out


BYTE_COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_the_cover_holds_every_difference():
    assert {(a - b) % repeats.MODULUS for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.MODULUS))
    assert repeats.SAMPLE + repeats.MODULUS - 1 == repeats.WINDOW


@pytest.mark.parametrize("chunk, bucket", [(repeats.CHUNK, repeats.BUCKET), (3000, 700)])
def test_repeated_bytes_against_all_windows(spark, monkeypatch, chunk, bucket):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, near, wide = noise(199), noise(200), noise(700)
    texts = [(1, None), (2, ""), (3, "x" * 199), (4, "y" * 200), (5, "z" * 201), (6, "z" * 1000), (None, noise(300)), (7, noise(250)), (7, noise(260))]
    texts += [(8, "same " * 50), (9, "same " * 50), (9, "same " * 50), (10, "short"), (11, "short"), (12, "日本語😀é" * 30), (13, "日本語😀é" * 30 + "!")]
    for k in range(20, 60):  # shared passages of every offset: just under, at and over the window
        part = rng.choice((shared, near, wide, wide[: 200 + rng.randrange(200)], wide[rng.randrange(400) :], near[1:]))
        texts.append((k, noise(rng.randrange(300)) + part + noise(rng.randrange(300))))
    texts.append((70, noise(100) + near + noise(10) + near + wide + wide))
    got = [tuple(r[c] for c in BYTE_COLUMNS) for r in repeats.repeated_bytes(documents(spark, texts)).collect()]
    assert by_text(got) == by_text(byte_rows(texts))


def test_repeated_bytes_of_no_rows(spark):
    assert repeats.repeated_bytes(documents(spark, [])).count() == 0
    few = repeats.repeated_bytes(documents(spark, [(1, None), (2, "a")])).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in few} == {1: (0, 0, sha("")), 2: (1, 0, sha("a"))}


def test_repeated_bytes_query_on_a_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r[c] for c in BYTE_COLUMNS) for r in QUERIES["op12_repeated_bytes"](spark, DATA).collect()]
    assert by_text(got) == by_text(byte_rows(docs))


# 13


def trie_rows(turns, lend=True):
    told = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            told[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in told.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if lend else 0
        base = c - int(np.fmod(c, 20))
        paths[c] = own.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in paths.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    below, children = defaultdict(list), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
        if node:
            children[node[:-1]] += 1
    saved = {n: (len(m) - 1) * len(SPACE.findall(n[-1][1])) if n else 0 for n, m in members.items()}
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], sum(children[x] == 0 for x in below[n]), sum(saved[x] for x in below[n]), sha(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(n))))
        for n, m in members.items()
    )


NODE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, d int, path string, n_convs double"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2.0) for r in rows], TURNS)


def odd_turns():
    rng = random.Random(8)
    rows = []
    for c in range(0, 400):
        if c % 40 != 20:  # some conversations that others begin with aren't there
            rows += [(c, t, ("user", "assistant")[t % 2], rng.choice(("hello there", "yes", "no  way", "", "a b c")) if t else "the first turn") for t in range(rng.choice((1, 1, 2, 3, 4, 7)))]
    rows += [(1000, t, "user", f"long {t}") for t in range(700)] + [(1001, t, "user", f"long {t}") for t in range(600)]  # over a stretch
    rows += [(1010, None, None, None), (1010, 0, "user", "behind null"), (None, 1, "user", "nobody"), (1017, 5, "user", None), (-3, 1, "user", "minus"), (-3, 2, "user", "one")]
    rows += [(5000 + k, 0, "user", "alone") for k in range(300)]
    return rows


def test_trie_against_all_prefixes(spark, monkeypatch):
    rows = odd_turns()
    read = turns_of(spark, rows)
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    got = sorted((tuple(r[c] for c in NODE_COLUMNS) for r in trie.prefix_trie(read, head=head, base=F.col("conv") - F.col("conv") % 20, most=3).collect()), key=lambda r: r[:2])
    assert got == sorted(trie_rows(rows), key=lambda r: r[:2])
    monkeypatch.setattr(trie, "STRETCH", 3)
    monkeypatch.setattr(trie, "PIECE_BITS", 2)
    plain = sorted((tuple(r[c] for c in NODE_COLUMNS) for r in trie.prefix_trie(read).collect()), key=lambda r: r[:2])
    assert plain == sorted(trie_rows(rows, lend=False), key=lambda r: r[:2])


def test_trie_of_repeated_turns_and_no_rows(spark):
    rows = [(7, 1, "user", "x"), (7, 1, "user", "x"), (7, 0, "user", "y")]
    assert [r["depth"] for r in trie.prefix_trie(turns_of(spark, rows)).orderBy("depth").collect()] == [0, 1, 2, 3]
    assert trie.prefix_trie(turns_of(spark, [])).count() == 0
    assert trie.prefix_trie(turns_of(spark, [(None, 1, "a", "b")])).count() == 0


def test_trie_with_a_hot_conversation_over_ranges(spark):
    rows = [(3, t, "user", f"w {t % 5}") for t in range(5000)] + [(c, t, "user", f"w {t % 5}") for c in range(10, 200) for t in range(2)]
    ranges = trie.numbered(turns_of(spark, rows), "conv_id", "turn", "role", "text")[1]
    assert ranges.where("conv = 3").count() > 1
    got = {(r["conv_id"], r["depth"]): (r["n_convs"], r["n_leaves"], r["saved_tokens"]) for r in trie.prefix_trie(turns_of(spark, rows)).collect()}
    assert len(got) == 5001 and got[3, 0] == (191, 1, 2 * 190 * 2) and got[3, 2] == (191, 1, 190 * 2) and got[3, 3] == (1, 1, 0)


def test_trie_query_against_its_sql(spark):
    got = QUERIES["op13_prefix_trie"](spark, DATA)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    found = con.execute(ORACLE_SQL["op13_prefix_trie"])
    names = [c[0] for c in found.description]
    want = sorted((tuple(str(r[names.index(c)]) for c in NODE_COLUMNS) for r in found.fetchall()))
    assert sorted(names) == sorted(got.columns)
    rows = sorted(tuple(str(r[c]) for c in NODE_COLUMNS) for r in got.collect())
    assert rows == want and len(rows) > 10
    turns = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows == sorted(tuple(str(x) for x in r) for r in trie_rows(turns))
