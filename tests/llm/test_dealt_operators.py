"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import json
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from kairoscope.llm import _hashing, bpe, chat, components, embeddings, fingerprints, language, mixing, quality, secrets, simhash, toxicity
from kairoscope.llm import shingles as exact
from kairoscope.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, label int"
LONG = "word " * 60_000 + "x" * 300_000


def documents(spark, rows):
    """doc_id, text, lang, source with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), 9.0, -1, 7) for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en", "a"), (2, "", None, "b"), (3, "  \t\n ", "fr", None), (4, LONG, "en", "a"), (5, "The same text twice, here and there.", "en", "b"), (6, "The same text twice, here and there.", "en", "c"), (7, "日本語 😀 ééé", None, "b"), (8, "one", "de", "a"), (8, "one", "de", "a"), (None, "no id at all", "en", "b")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


# 1


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + 0.18 * rng.normal(size=16)).tolist(), i % 2) for i in range(260)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(90)]  # one vector held very often
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, rows[0][1], None), (2004, [1.0, 2.0], 1), (2005, [2.0, 4.0], 1), (2006, [None] + [1.0] * 15, 1), (2007, [float("inf")] * 16, 1), (None, rows[0][1], 0)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(frame, block_rows=32).collect()}
    assert len(got) == len(rows)
    good = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    links = {r[0]: set() for r in good}
    for a in good:
        for b in good:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.93:
                    links[a[0]].add(b[0])
    assert sum(map(len, links.values())) > 5000
    low = {}
    for start in sorted(links):
        if start not in low:
            todo = [start]
            while todo:
                n = todo.pop()
                if n not in low:
                    low[n] = start
                    todo += links[n]
    for k in (r[0] for r in rows):
        want = (len(links.get(k, ())), low.get(k, k))
        assert got[k][:2] == want and got[k][2] == (k == want[1] or k is None)


def test_embeddings_of_any_length_and_repeated_ids(spark):
    schema = "vec_id long, embedding array<double>, label int"
    sizes = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1e200, 0.0], 1), (3, [1e-200, 0.0], 1), (4, [5e-324, 0.0], 1), (5, [0.0, 1e-200], 1)], schema)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(sizes).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    # 5 holds two vectors, of which the smallest ids differ; 9 and 8 hold two that are unlike all others.
    repeated = spark.createDataFrame([(1, a, 1), (5, a, 1), (5, b, 1), (9, b, 1), (9, c, 1), (9, c, 1), (8, [1.0, 1.0, 1.0], 1), (8, [1.0, -1.0, 0.0], 1)], schema)
    rows = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(repeated).collect())
    assert rows == [(1, 1, 1, True), (5, 1, 1, False), (5, 1, 1, False), (8, 0, 8, True), (8, 0, 8, True), (9, 1, 1, False), (9, 1, 1, False), (9, 1, 1, False)]


def test_embeddings_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(frame).collect() == []
    alone = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in embeddings.near_duplicates(alone).collect()] == [(1, 0, 1, True)]


# 2


@pytest.fixture(scope="module")
def tongues(spark):
    words = {"en": "the and of with house over there", "de": "der und von mit haus über schön", "fr": "le et de avec maison où élève"}
    rng = np.random.default_rng(0)
    return [(i, " ".join(rng.choice(words[g].split(), 12)), g, "s") for i in range(240) for g in [list(words)[i % 3]]]


def test_language_held_out(spark, tongues, odd):
    docs = documents(spark, tongues)
    model = language.fit(docs)
    assert model.labels == ["de", "en", "fr"] and 0.05 <= model.temperature <= 20 and (model.weights == 0).mean() > 0.5
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    out = [r for r in tongues if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in out]) == 1.0
    strange = language.predict(odd, model).collect()
    assert len(strange) == 10
    by_id = {r["doc_id"]: r for r in strange}
    assert all((by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0) for i in (1, 2, 3)) and 0 <= by_id[7]["score"] <= 1


def test_language_frequencies_cover_every_document(spark, tongues):
    model = language.fit(documents(spark, tongues), per_label=5)
    n = sum(zlib.crc32(str(r[0]).encode()) % 4 != 2 for r in tongues)
    seen = np.zeros(language.BINS)
    for i, text, _, _ in tongues:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            seen[language.counts_of(text)[0]] += 1
    assert model.idf == pytest.approx(np.log((1 + n) / (1 + seen)) + 1)


def test_language_leaves_no_label_out(spark, tongues, monkeypatch):
    docs = documents(spark, tongues)
    monkeypatch.setattr(language, "MOST_LABELS", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        language.fit(docs)
    monkeypatch.setattr(language, "MOST_LABELS", 3)
    assert language.fit(docs).labels == ["de", "en", "fr"]


def test_language_pieces_agree():
    text = "Ein langer Satz über Häuser. 12 " * 20_000
    bins, counts = language.counts_of(text)
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    clean = re.sub(" +", " ", letters)
    full = " " + clean
    assert counts.sum() == len(clean) + (len(full) - 1) + (len(full) - 2) and len(bins) < language.BINS


def test_language_of_nothing(spark, none):
    model = language.fit(none)
    assert language.predict(none, model).collect() == [] and model.predict("text") == ("und", 0.0)


# 3


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_of_texts(odd):
    for r in odd.where("doc_id <> 4 OR doc_id IS NULL").collect():
        assert int.from_bytes(simhash.fingerprint(r["text"] or ""), "big") == brute_print(r["text"])
    text = "Ä b\tc\x1fd " * 400_000  # several pieces
    once = list(simhash.shingle_hashes(text, 3))
    assert len(once) > 1
    w = text.encode().lower().split()
    assert np.concatenate(once).tolist() == [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(w, w[1:], w[2:])]


def linked(prints, ids, distance):
    low = {i: i for i in ids}
    changed = True
    near = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= distance]
    while changed:
        changed = False
        for a, b in near:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


@pytest.mark.parametrize("scheme", [simhash.EXACT, simhash.Scheme(3, 2, 3, tuple(tuple(range(32 * k, 32 * k + 32)) for k in range(4)))])
def test_links_against_all_pairs(spark, scheme):
    rng = np.random.default_rng(5)
    width = 64 * scheme.size
    base = [int.from_bytes(rng.bytes(width // 8), "big") for _ in range(60)]
    prints = {0}
    for k in range(500):
        x = base[0] if k % 2 else base[k % 60]  # half near one print: a hot front over many blocks
        for b in rng.integers(0, width, rng.integers(0, 7)):
            x ^= 1 << int(b)
        prints.add(x)
    order = rng.permutation(len(prints))
    of = {int(i): p for i, p in zip(order, sorted(prints))}
    frame = spark.createDataFrame([(i, bytearray(p.to_bytes(width // 8, "big"))) for i, p in of.items()], "node long, fp binary")
    got = {r["node"]: r["component"] for r in components.components(simhash.links(frame, scheme, 16)).collect()}
    want = linked(of, sorted(of), 3)
    assert {i: got.get(i, i) for i in of} == want and len(set(want.values())) < len(want) - 100


def test_near_duplicates(odd, none):
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8), (8, 8), (None, None)], key=str)
    assert simhash.near_duplicates(none).collect() == []


def test_wide_fingerprints_find_near_copies_and_leave_others(spark):
    rng = np.random.default_rng(2)
    rows, group = [], {}
    for g in range(40):
        words = [f"w{x}" for x in rng.integers(0, 100_000, 200)]
        for c in range(4):
            copy = list(words)
            for at in rng.integers(0, 200, 3):
                copy[at] = f"n{rng.integers(0, 1 << 30)}"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy if c else words), "en", "s"))
    kept = [r["doc_id"] for r in simhash.survivors(documents(spark, rows)).collect()]
    assert sorted(kept) == [4 * g for g in range(40)]


def near_at_least(texts, p=4, q=5):
    """The smallest id that each one reaches by pairs of a similarity of p / q or more, from all pairs."""
    sets = {i: shingles(t.lower()) for i, t in texts.items()}
    low, changed = {i: i for i in texts}, True
    ids = sorted(texts)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in near:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low, near


def test_survivors_against_all_pairs_around_the_threshold(spark):
    rng = np.random.default_rng(20)
    texts = {}
    for g in range(160):
        words = [f"w{x}" for x in rng.integers(0, 1 << 30, int(rng.integers(30, 400)))]
        n = len(words) - 4
        texts[2 * g] = " ".join(words)
        if g % 2:  # the end is cut off
            texts[2 * g + 1] = " ".join(words[: 4 + int(round(n * rng.uniform(0.76, 0.86)))])
        else:  # the end is another: so many shingles of n are common to both
            common = int(round(n * rng.uniform(0.865, 0.925)))
            texts[2 * g + 1] = " ".join([*words[: common + 4], *(f"n{x}" for x in rng.integers(0, 1 << 30, n - common))])
    want, near = near_at_least(texts)
    assert 60 < len(near) < 120
    kept = {r["doc_id"] for r in simhash.survivors(documents(spark, [(i, t, "en", "s") for i, t in texts.items()])).collect()}
    assert kept == {i for i in texts if want[i] == i}


@pytest.mark.parametrize("n", [1, 5000, 200_000, 10_000_000])
def test_wide_orders_find_pairs_at_the_threshold_however_many_rows(n):
    rng, scheme, found, all_pairs = np.random.default_rng(23), simhash.wide(n), 0, 0
    for size in (9, 20, 60, 400):
        for _ in range(150):
            both, own = rng.integers(0, 1 << 64, 8 * size, np.uint64), rng.integers(0, 1 << 64, (2, size), np.uint64)  # similarity 0.8
            a, b = (np.frombuffer(simhash.majority(iter((np.concatenate((both, x)),)), 4), ">u8").astype(np.uint64) for x in own)
            met = any(not ((a ^ b) & front).any() for front in scheme.masks)
            found += met and np.bitwise_count(a ^ b).sum() <= scheme.distance
            all_pairs += 1
    assert found >= 0.99 * all_pairs
    assert len(scheme.fronts[0]) == max(1, int(np.ceil(np.log2(n / simhash.FRONT_ROWS))))


def test_blocks_of_hot_fronts_and_ranges(spark):
    rng = np.random.default_rng(24)
    base = rng.integers(0, 1 << 64, 4, np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, (300, 4), np.uint64))  # a large group of near copies
    prints = {(r.astype(">u8").tobytes()): i for i, r in enumerate(np.concatenate((near, rng.integers(0, 1 << 64, (300, 4), np.uint64))))}
    frame = spark.createDataFrame([(bytearray(k), v) for k, v in prints.items()], "fp binary, node long").repartition(5)
    got = components.components(simhash.links(frame, simhash.wide(20_000), 16)).collect()
    assert {r["node"]: r["component"] for r in got} == dict.fromkeys([i for i in prints.values() if i < 300], 0)


def test_exact_groups_in_tiles(spark):
    rng = np.random.default_rng(21)
    texts, words = {}, [f"w{x}" for x in range(90)]
    for i in range(120):  # a chain whose ends have nothing in common, now and then broken
        texts[int(1000 - i)] = " ".join(words)
        cut = 30 if i % 17 == 16 else int(rng.integers(3, 9))
        words = [*words[cut:], *(f"w{x}" for x in rng.integers(0, 1 << 30, cut))]
    want, _ = near_at_least(texts)
    assert 7 < len(set(want.values())) < 60
    docs = documents(spark, [(i, t, "en", "s") for i, t in texts.items()])
    for size in (5, 512):
        assert {r["doc_id"]: r["component_id"] for r in exact.near_duplicates(docs, chunk_sets=size).collect()} == want


def test_exact_groups_of_odd_rows(odd, none):
    got = [(r["doc_id"], r["component_id"]) for r in exact.near_duplicates(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8), (8, 8), (None, None)], key=str)
    assert exact.near_duplicates(none).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 80)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000), (None, 1)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(81)} == {0} and {got[i] for i in range(1000, 1200)} == {1000} and 5000 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# 4


def test_quality_held_out(spark, odd):
    rng = np.random.default_rng(4)
    good = lambda: " ".join(rng.choice("calm plain words that read as prose does".split(), 30))
    bad = lambda: rng.choice([" ".join(["spam"] * 30), "BUY!! NOW!! " * 10, "a%%% b### " * 12])
    rows = [(i, good() if i % 2 else str(bad()), "en", "s") for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(240)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    out = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == bool(i % 2) for i in out]) == 1.0
    strange = quality.score(odd, model).collect()
    assert len(strange) == 10 and all(0 <= r["score"] <= 1 for r in strange)


def test_quality_without_labels(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, labels)
    assert {r["score"] for r in quality.score(odd, model).collect()} == {0.5}
    assert quality.score(none, model).collect() == []
    alike = quality.fit(odd, spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int"))
    assert alike.score("x") == 1.0


@pytest.mark.parametrize("size", [7, 16, 64])
def test_features_are_the_same_wherever_a_piece_ends(monkeypatch, size):
    rng = np.random.default_rng(41)
    alphabet = list("aab é.!\n\t日😀x ") + ["word ", "Longer words. ", "q" * 40, "\u2028", "İ"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 60)))) for _ in range(150)] + ["z" * 500, "z" * 500 + " end", "a" * size, "a" * size + ".", "ab\t" * 50, "."]
    whole = [(toxicity.features(t), quality.counted(t)) for t in texts]
    monkeypatch.setattr(_hashing, "PIECE", size)
    for t, (bags, bins) in zip(texts, whole, strict=True):
        for a, b in zip((*bags, *bins), (*toxicity.features(t), *quality.counted(t)), strict=True):
            assert a.tolist() == b.tolist(), t


def test_quality_features_by_brute_force():
    text = "A b  A\u3000b é\n日本 x"
    words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
    bins, counts = quality.counted(text)
    kinds = [counts[p].sum() for p in quality.kinds(bins)]
    assert kinds == [len(words), len(words) - 1, len(text) - 2]
    distinct = [len(bins[p]) for p in quality.kinds(bins)]
    assert distinct == [len(set(words)), len({*zip(words, words[1:], strict=False)}), len({text[i : i + 3] for i in range(len(text) - 2)})]


def test_features_come_in_pieces():
    text = "some words again " * 40_000
    bins, counts = quality.counted(text)
    assert [counts[p].sum() for p in quality.kinds(bins)] == [120_000, 119_999, len(text) - 2]
    assert len(toxicity.features("one sentence without an end " * 30_000)[1]) == 1
    bins, counts, extents = toxicity.features("Fine day. You fool! " * 20_000)
    assert len(counts) == 40_000 and counts.sum() == len(bins) and (np.diff(extents[:, 0]) > 0).all()


# 5


def test_every_code_point_splits_as_in_the_library():
    from tokenizers import pre_tokenizers

    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for first in range(0, 0x110000, 1 << 14):
        points = [chr(c) for c in range(first, min(first + (1 << 14), 0x110000)) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}b 1{c}2 !{c}?  {c}'s{c} {c}" for c in points)
        ends = [end for _, (_, end) in library.pre_tokenize_str(text)]
        at, own = 0, []
        for w in bpe.words_of(text):
            at += len(w)
            own.append(at)
        assert own == ends, hex(first)


def test_a_long_word_takes_bounded_memory():
    import resource

    encoder = bpe.tokenizer(bpe.VOCABULARY)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ids = np.frombuffer(encoder.encode("abcdefghij" * 400_000), "<u4")
    assert encoder.decode(ids.tobytes()) == "abcdefghij" * 400_000
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 30 * 4  # MB: 30 bytes a byte, decoding included


def test_bpe_equals_the_library(spark, odd):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.VOCABULARY)
    rng = np.random.default_rng(6)
    texts = [r["text"] or "" for r in odd.collect()]
    texts += ["<|endoftext|>x<|endoftext|>", "I'll don't  a\n\n b\t", "aaaa" * 500, "\x00\x7f", "=" * 200, "".join(map(chr, rng.integers(32, 0x2FFF, 4000)))]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in bpe.round_trip(docs).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == reference.decode(ids, skip_special_tokens=False)
    digest = {r["doc_id"]: r for r in bpe.digests(bpe.round_trip(docs)).collect()}
    assert digest[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_bpe_of_nothing(none):
    assert bpe.round_trip(none).collect() == []


# 6


def test_toxicity_held_out_and_located(spark, odd):
    rng = np.random.default_rng(8)
    clean = lambda n: [" ".join(rng.choice("a plain sentence of words without any edge".split(), 8)).capitalize() + "." for _ in range(n)]
    rows, labels = [], []
    for i in range(300):
        sentences = clean(6)
        if i % 3 == 0:
            sentences[2] = f"You {rng.choice(['idiot', 'moron', 'scum'])} go away."
        rows.append((i, " ".join(sentences), "en", "s"))
        labels.append((i, 1, int(i % 3 == 0)))
    docs = documents(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(None, 0, 1), (4, 0, None)], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    out = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i]["score"] >= 0.3) == (i % 3 == 0) for i in out)
    for i in out:
        if i % 3 == 0:
            text = rows[i][1]
            assert [text[s["first"] : s["last"]].strip() for s in got[i]["sentences"]] == [s.strip() + "." for s in text.split(".") if "You" in s]
    strange = toxicity.score(odd, model).collect()
    assert len(strange) == 10 and all(0 <= r["score"] < 0.3 for r in strange)
    assert toxicity.clean(docs, model).count() == 200 and toxicity.clean(docs, model).columns == docs.columns


def test_toxic_sentences_are_located_where_case_changes_lengths(spark):
    weights = np.zeros(toxicity.BINS, np.float32)
    weights[toxicity.features("scum")[0]] = 5.0
    model = toxicity.Model(weights, -7.0)
    texts = ["İİ one İ. É scum İ here! İ then.", "İscum. You scum", "You scum. And İ", "x. scum İ"]
    got = {r["doc_id"]: r for r in toxicity.score(documents(spark, [(i, t, "tr", "s") for i, t in enumerate(texts)]), model).collect()}
    found = {i: [texts[i][s["first"] : s["last"]].strip() for s in r["sentences"]] for i, r in got.items()}
    assert found == {0: ["É scum İ here!"], 1: ["You scum"], 2: ["You scum."], 3: ["scum İ"]}


def test_toxicity_without_labels(spark, odd, none):
    model = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in toxicity.score(odd, model).collect()} == {0.0} and toxicity.score(none, model).collect() == []


# 7


@pytest.mark.parametrize("chunk", [256, 3])
def test_chat_order_of_random_logs_by_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)  # with 3, conversations are cut into several chunks
    rng = np.random.default_rng(51)
    rows, want = [], {}
    for conv in range(40):
        n = int(rng.integers(1, 8))
        turns = rng.permutation(2 * n)
        needs = {i: sorted({int(j) for j in rng.integers(0, n + 1, int(rng.integers(0, 3)))}) for i in range(n)}  # n is nobody
        answered = {i: int(turns[2 * i + 1]) for i in range(n) if rng.random() < 0.8}
        for i in range(n):
            call = {"id": f"c{i}", "name": "reply", "arguments": {"prompt": "p", "turn": 1}, "depends_on": [f"c{j}" for j in needs[i]]}
            rows.append((conv, int(turns[2 * i]), "assistant", f"<tool_call>{json.dumps(call)}</tool_call>"))
            if i in answered:
                rows.append((conv, answered[i], "tool", json.dumps({"tool_call_id": f"c{i}", "content": "r"})))
        free = {}
        while more := [i for i in range(n) if i not in free and all(j in free or j == n for j in needs[i])]:
            for i in more:
                at = (int(turns[2 * i]), 0)
                for given in sorted(free[j][1] for j in needs[i] if j < n):
                    at = (given[0], given[1] + 1) if given >= at else at
                free[i] = (at, (answered[i], 0) if answered.get(i, -1) > at[0] else (at[0], at[1] + 1))
        for i in range(n):
            own = (int(turns[2 * i]), 0)
            at, answer = free.get(i, (own, (answered[i], 0) if answered.get(i, -1) > own[0] else (own[0], 1)))
            status = "cyclic" if i not in free else "linked" if i in answered else "unanswered"
            want[conv, "call", f"c{i}"] = (*at, status)
            if i in answered:
                want[conv, "result", f"c{i}"] = (*answer, status)
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    assert {(r["conv_id"], r["kind"], r["call_id"]): (r["after_turn"], r["level"], r["status"]) for r in got} == want
    assert sum(w[2] == "cyclic" for w in want.values()) > 20 and sum(w[1] > 1 for w in want.values()) > 20


def test_chat_long_late_chains(spark):
    """A chain of 700 calls, each needing the one before, whose head comes last; 700 in reverse; and 700 behind a cycle, without turns."""
    call = lambda i, needs: f'<tool_call>{json.dumps({"id": f"c{i}", "name": "reply", "arguments": {}, "depends_on": needs})}</tool_call>'
    n = 700
    rows = [(1, n if i == 0 else i, "assistant", call(i, [f"c{i - 1}"] if i else None)) for i in range(n)]
    rows += [(2, i, "assistant", call(i, [f"c{i + 1}"])) for i in range(n)]
    rows += [(3, None, "assistant", call(i, [f"c{i - 1}" if i else "c1"])) for i in range(n)]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).select("conv_id", "call_id", "after_turn", "level", "status").collect()
    at = {(r["conv_id"], int(r["call_id"][1:])): (r["after_turn"], r["level"], r["status"]) for r in got}
    assert all(at[1, i] == (n, 2 * i, "unanswered") for i in range(n))
    assert all(at[2, i] == (n - 1, 2 * (n - 1 - i), "unanswered") for i in range(n))
    assert all(at[3, i] == (chat.LAST, 0, "cyclic") for i in range(n))


def test_chat_linking(spark):
    call = lambda i, name="reply", more="": f'<tool_call>{{"id":"{i}","name":"{name}","arguments":{{"turn":1,"prompt":"p"}}{more}}}</tool_call>'
    needs = ',"depends_on":["c"]'
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", call("b", more=needs)), (1, 2, "assistant", call("c")), (1, 5, "tool", '{"tool_call_id":"c","content":"C"}'), (1, 3, "tool", '{"tool_call_id":"b","content":"B"}'), (1, 4, "tool", '{"tool_call_id":"z"}'), (1, 6, "assistant", call("c") + call("d", "nope")), (1, 7, "tool", "oops"), (2, 0, "assistant", call("x", more=',"depends_on":["y"]') + call("y", more=',"depends_on":["x"]')), (None, 0, "user", None), (3, None, "user", None)]
    frame = spark.createDataFrame([(*r, "?") for r in rows], "conv_id long, turn long, role string, text string, status string")
    out = chat.format_chat(frame).collect()
    at = {(r["conv_id"], r["turn"], r["place"]): r for r in out}
    assert len(out) == 13
    order = sorted((r for r in out if r["conv_id"] == 1), key=lambda r: (r["after_turn"], r["level"], r["turn"], r["place"]))
    spots = [(r["kind"], r["call_id"]) for r in order if r["status"] == "linked"]
    assert spots == [("call", "c"), ("result", "c"), ("call", "b"), ("result", "b")]
    assert at[1, 4, 0]["status"] == "orphan" and at[1, 6, 0]["status"] == "duplicate" and at[1, 6, 1]["errors"] == "unknown tool" and at[1, 6, 1]["status"] == "unanswered" and at[1, 7, 0]["status"] == "malformed"
    assert {at[2, 0, p]["status"] for p in (0, 1)} == {"cyclic"}
    assert at[1, 2, 0]["json"] == '{"arguments":{"prompt":"p","turn":1},"id":"c","name":"reply","type":"call"}' and at[1, 2, 0]["errors"] == ""
    wrong = spark.createDataFrame([(1, 0, "assistant", '<tool_call>{"id":"a","name":"reply","arguments":{"turn":1.5,"z":[1]}}</tool_call>')], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(wrong).first()["errors"] == "prompt: missing; turn: not of type integer; z: unexpected"
    assert chat.format_chat(frame.limit(0)).collect() == []


# 8


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not over:
            for s in open_:
                target[s] = left * weight[s] / w
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark, odd, none):
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(0, 40)), "en", s) for i in range(600) for s in [[None, "b", "ä", "Z", "big", "big", "big"][i % 7]]]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    size = {r[0]: len(r[1].split()) for r in rows}
    sizes = {}
    for i, _, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    target = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    source = {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s]) and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(taken[s] == int(target[s]) for s in sizes) and len(got) == 600
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    copies = mixing.repeated(docs).groupBy("doc_id").count().collect()
    per = {r["doc_id"]: r for r in got}
    assert {r["doc_id"]: r["count"] for r in copies} == {i: -(-r["taken"] // r["size"]) for i, r in per.items() if r["taken"]}
    assert len(mixing.mix(odd).collect()) == 10 and mixing.mix(none).collect() == [] and mixing.repeated(none).columns == none.columns
    still = mixing.mix(documents(spark, [(1, None, None, None), (2, " ", None, "a")])).collect()
    assert all(r["taken"] == 0 and r["target"] == 0 for r in still)


# 9


def test_secret_spans(spark, odd, none):
    live, example = "Zx9Kq2Lm8Vb4Nw7Rt1Yp5Hs3", "tok_EXAMPLEexample123"
    key = "AKIA" + "A1B2C3D4E5F6"
    texts = [(1, f'é PassWord = "{live}" and {key}.', "en", "o1"), (2, f"token: {example}", "en", "o1"), (3, f"token: {example}", "en", "o2"), (4, f"x token:{example} y", "en", "o3"), (5, "secret=short1 AKIA12 abcdef0123456789", "en", None), (6, "0123456789abcdef" * 2 + " TOKEN='" + "ab" * 20 + "'", "en", "o2"), (7, f"bare {live}", "en", "o1"), (8, "toKen=abcdefghij", "en", "o1")]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    spans = {i: [(s["kind"], s["first"], s["last"]) for s in r["base"]] for i, r in got.items()}
    assert spans[1] == [("assign", 2, 2 + len(f'PassWord = "{live}')), ("access", texts[0][1].index("AKIA"), texts[0][1].index("AKIA") + 16)]
    assert spans[5] == [] and [s[0] for s in spans[6]] == ["hex", "assign", "hex"] and spans[7] == [] and spans[8] == []
    kinds = {i: [m["kind"] for m in r["marked"]] for i, r in got.items()}
    assert kinds[2] == kinds[3] == kinds[4] == ["example"] and kinds[1] == ["live", "live"] and kinds[7] == ["live"]
    masked = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert masked[1]["text"] == 'é PassWord = "[SECRET]" and [SECRET].' and masked[1]["n_chars"] == len(masked[1]["text"]) and masked[3]["text"] == texts[2][1] and len(masked) == 8
    assert len(secrets.scan(odd).collect()) == 10 and secrets.scan(none).collect() == [] and secrets.redact(odd).count() == 10


def test_repositories_decide_where_two_owners_hold_a_value(spark):
    shared, own = "Zx9Kq2Lm8Vb4Nw7Rt1Yp5Hs3", "Qw8Er7Ty6Ui5Op4As3Df2Gh1"
    docs = documents(spark, [(i, f"token={shared}", "en", "o1" if i < 4 else "o2") for i in range(5)] + [(9, f"token={own}", "en", "o1"), (10, f"token={own} again", "en", "o1"), (10, f"token={own} again", "en", "o1")])
    for many, want in ((5, "example"), (6, "live"), (None, "live")):
        marked = {r["doc_id"]: r["marked"] for r in secrets.scan(docs, many=many).collect()}
        assert {m["kind"] for i in range(5) for m in marked[i]} == {want} and {(m["n_repos"], m["n_owners"]) for i in range(5) for m in marked[i]} == {(5, 2)}
        assert [(m["kind"], m["n_repos"], m["n_owners"]) for m in marked[9] + marked[10]] == [("live", 2, 1)] * 2
    assert all(r["text"].startswith("token=[SECRET]") for r in secrets.redact(docs).collect())


def test_nested_secrets_are_masked_once(spark):
    run = "0123456789abcdef" * 4
    texts = [
        (f"before secret=sk-{run} and clean text behind it, which stays", "before secret=[SECRET] and clean text behind it, which stays"),
        (f"api_key: AKIA{'Q7' * 10}=={run[::-1]}.x then {run[1:60]} end", "api_key: [SECRET] then [SECRET] end"),
        (f"token={run}0 {run}1 next", "token=[SECRET] [SECRET] next"),
        (f"é token={run[2:50]}", "é token=[SECRET]"),
    ]
    docs = documents(spark, [(i, t, "en", "s") for i, (t, _) in enumerate(texts)])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact(docs).collect()}
    assert got == {i: (m, len(m)) for i, (_, m) in enumerate(texts)}


def test_masks_against_brute_force(spark):
    rng = np.random.default_rng(31)
    run = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    values = [run(int(rng.integers(32, 50))) for _ in range(12)]
    makes = [lambda v: f"token=xyz_{v}", lambda v: v, lambda v: f"AKIA{v.upper()}", lambda v: f"Secret: '{v}-{v[:9]}'", lambda v: f"Ab{v}Cd", lambda v: "clean words here"]
    rows = []
    for i in range(120):
        parts = [makes[int(rng.integers(6))](values[int(rng.integers(12))]) for _ in range(int(rng.integers(0, 5)))]
        text = (" é " if rng.random() < 0.5 else "_").join(parts)
        rows.append((None if i % 7 == 0 else int(rng.integers(0, 40)), text, "en", f"o{rng.integers(0, 4)}"))
    docs = documents(spark, rows).withColumns({"live": F.lit(1), "live_id": F.lit(2), "text_key": F.lit(3), "of_key": F.lit(4), "live_spans": F.lit(5), "gone_id": F.lit(6)})
    owners = {}
    for _, t, _, o in rows:
        for h, a, b in secrets.found_in(t)[2]:
            owners.setdefault(t[a:b], set()).add(o)
    want = []
    for i, t, _, _ in rows:
        spans = sorted((a, b) for _, a, b in secrets.found_in(t)[2] if len(owners[t[a:b]]) < 3)
        out, at = "", 0
        while at < len(t):  # a new mask begins where a span does that none before it reaches into
            reach = max((b for a, b in spans if a == at), default=0)
            if not reach:
                out, at = out + t[at], at + 1
                continue
            while any(a < reach < b for a, b in spans):
                reach = max(b for a, b in spans if a < reach < b)
            out, at = out + "[SECRET]", reach
        want.append((i, out, len(out)))
    got = secrets.redact(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert any("[SECRET]" in w[1] for w in want) and simhash.survivors(docs).columns == docs.columns


def test_tokens_apart_from_spans():
    rng = np.random.default_rng(32)
    for _ in range(200):
        make = lambda n: sorted({(int(a), int(a + rng.integers(1, 9))) for a in rng.integers(0, 60, n)})  # noqa: E731, B023
        tokens, spans = make(int(rng.integers(0, 9))), make(int(rng.integers(0, 9)))
        assert secrets.apart(tokens, spans) == [x for x in tokens if not any(a < x[1] and x[0] < b for a, b in spans)]


# 10


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprint_pairs(spark, odd, none):
    rng = np.random.default_rng(10)
    rows = [(int(i), " ".join(rng.choice(["alpha", "bêta", "gamma", "delta", "eps"], int(rng.integers(0, 300)))), "en", "s") for i in rng.choice(100_000, 400, replace=False)]
    rows += [(200_000, rows[0][1], "en", "s"), (200_001, rows[0][1], "en", "s")]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in fingerprints.edited_pairs(docs).select("doc_id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch", fingerprints.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near"), fingerprints.likeness(F.col("sketch"), F.col("next_sketch")).alias("next")).collect()}
    order, error = sorted(rows), []
    for k, (i, t, _, _) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        assert got[i]["n_chars"] == len(t) and got[i]["edited"] == t[: len(t) - q] + following[:q]
        assert got[i]["next_sketch"] == got[order[(k + 1) % len(order)][0]]["sketch"]
        a, b = shingles(t), shingles(got[i]["edited"])
        error.append(abs(got[i]["near"] - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert np.mean(error) < 0.08 and got[200_000]["next"] == 1.0
    assert len(fingerprints.edited_pairs(odd).collect()) == 10 and fingerprints.edited_pairs(none).collect() == []
    one = fingerprints.edited_pairs(documents(spark, [(1, "abcdefgh", "en", "s")])).first()
    assert one["edited"] == "abcdefab"


def test_sketches_merge_and_contain(spark):
    rng = np.random.default_rng(11)
    big = [f"w{i}" for i in rng.integers(0, 1 << 30, 4000)]
    docs = documents(spark, [(1, " ".join(big), "en", "s"), (2, " ".join(big[:600]), "en", "s"), (3, " ".join(big[:2000]), "en", "s"), (4, " ".join(big[1996:]), "en", "s")])
    s = {r["doc_id"]: r["sketch"] for r in fingerprints.sketches(docs).collect()}
    row = spark.createDataFrame([(s[1], s[2], s[3], s[4])], "a array<long>, b array<long>, c array<long>, d array<long>").select(fingerprints.containment(F.col("b"), F.col("a")).alias("inside"), fingerprints.containment(F.col("a"), F.col("b")).alias("covers"), fingerprints.merge(F.col("c"), F.col("d")).alias("both")).first()
    assert row["inside"] == 1.0 and row["covers"] == pytest.approx(596 / 3996, abs=0.05) and row["both"] == s[1]
    assert len(s[1]) == pytest.approx(3996 * fingerprints.FRACTION, rel=0.1)


# all


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "secrets", "mixing", "tokens"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    frame = QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(frame.columns)
    assert sorted(str([r[n] for n in names]) for r in frame.collect()) == sorted(str(list(r)) for r in found.fetchall())


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, DATA)
        assert name == "tokens" or out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        before = spark.read.parquet(str(tmp_path / str(k)))
    run = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, before.collect())) and run.count() > 0


def test_pipeline_stages_on_odd_tables(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, none):
            out = stage(spark, table, DATA)
            assert (out.columns == table.columns) or name == "tokens"
            out.collect()


# The registered queries against the contract, by brute force


@pytest.fixture(scope="module")
def texts():
    import duckdb

    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()}


def got_of(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, DATA).collect()}


def test_query_folds_and_scores(spark, texts):
    for name, modulus, rest, least in (("op4_quality", 3, 1, 0.5), ("op6_toxicity", 4, 2, 0.3)):
        rows = got_of(spark, name)
        assert rows.keys() == texts.keys()
        for i, r in rows.items():
            assert r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == rest)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)
    rows, known = got_of(spark, "op2_language_id"), set()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        known |= {r["lang"]} if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 else set()
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in known if any(c.isalpha() for c in texts[i]) else r["lang_pred"] == "und"


def test_query_accuracy_on_what_was_held_out(spark):
    import duckdb

    labels = {i: (q, t) for i, q, t in duckdb.sql(f"SELECT doc_id, max(quality), max(toxic) FROM '{DATA}/labels.parquet' GROUP BY ALL").fetchall()}
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{DATA}/documents.parquet' WHERE lang IS NOT NULL").fetchall())
    rows = got_of(spark, "op2_language_id")
    held = [r for i, r in rows.items() if r["held_out"] and i in lang and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.8
    for name, k in (("op4_quality", 0), ("op6_toxicity", 1)):
        held = [(r["predicted"], labels[i][k]) for i, r in got_of(spark, name).items() if r["held_out"] and i in labels and labels[i][k] is not None]
        assert np.mean([a == b for a, b in held]) > 0.75, name


def test_query_secrets_by_other_patterns(spark, texts):
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    holders = {}
    for i, t in texts.items():
        for value in {t[a:b] for _, a, b in secrets.found_in(t)[2]}:
            holders.setdefault(value, set()).add(i)
    for i, r in got_of(spark, "op9_secret_scan").items():
        held = [tuple(map(int, x.split(":"))) for x in r["held_by"].split(",") if x]
        assert len(held) == r["n_live"] + r["n_example"] and all(repos == len(holders[texts[i][a:b]]) and 1 <= owners <= repos for a, b, repos, owners in held)
        t, base = texts[i], []
        base += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m.group(1)) >= 8]
        base += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
        base += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
        base.sort()
        shown = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in base)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in base) for k in range(3)]
        assert set(shown.split(",")) - {""} <= set(r["spans"].split(","))


def test_query_fingerprints_and_edits(spark, texts):
    rows, ids = got_of(spark, "op10_fingerprints"), sorted(texts)
    for k, i in enumerate(ids):
        t, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        q = len(t) // 4
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + following[:q]).encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
        assert (rows[i]["fingerprint"] == rows[ids[0]]["fingerprint"]) or t != texts[ids[0]]


def test_query_tokens(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.VOCABULARY)
    for i, r in got_of(spark, "op5_bpe").items():
        ids = library.encode(texts[i], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_simhash(spark, texts):
    rows = got_of(spark, "op3_simhash")
    prints = {}
    for i, t in texts.items():
        w = [x for x in re.split("[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t)) if x]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else [])]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert rows[i]["fingerprint"] == f"{prints[i]:016x}"
    low, changed = {i: i for i in prints}, True
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    while changed:
        changed = False
        for a, b in near:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    assert {i: r["component_id"] for i, r in rows.items()} == low
