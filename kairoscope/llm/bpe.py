"""Byte-level BPE by a backtracking encoder, and decoding by an offset table.

Encoding.  A word's tokens are looked up in an Aho-Corasick automaton over the vocabulary: one scan
gives, for each start, the longest token that begins there; the next shorter one is the longest that begins it (a table).
The encoder takes the longest one whose pair
with the token before it is compatible (the merges, undone from the seam outwards, never prefer
another pair across it); where none is, it drops the last token, marks the position as closed and
goes on with the next shorter one.  A position is closed once, so the work is linear, and the
result equals that of applying all merges in order of rank.

Decoding.  The bytes of all tokens lie in one array with a table of offsets; ids are gathered
from it without a lookup a token.

Texts.  A null text is empty: no ids and an empty decoded text.  Special tokens that stand in a text
become their own id, as the file says.  Texts are encoded whole; memory holds one text and its ids, and about 13 bytes more for each byte of
its longest word.  Repeated rows give repeated results, an empty table none.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.llm._memory import give_back

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The code points that are letters or numbers from Unicode 17 on; to the library, which knows Unicode 16, they are neither.
NEWER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9
11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128
1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e
2cea2-2cead 323b0-33479 3d000-3fc3f
"""
_NEWER = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER.split())


def splitter(letter: str, number: str, neither: str) -> regex.Pattern:
    return regex.compile(rf"""'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{neither}+|\s+(?!\S)|\s+""", regex.V1)


SPLIT = splitter(r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]")
SPLIT_NEWER = splitter(rf"[\p{{L}}--[{_NEWER}]]", rf"[\p{{N}}--[{_NEWER}]]", rf"[[^\s\p{{L}}\p{{N}}][{_NEWER}]]")
SOME_NEWER = regex.compile(f"[{_NEWER}]")
FIRST_NEWER = chr(int(NEWER.split()[0], 16))
#: Words that a worker keeps encoded, their greatest length and the seams it keeps; words beyond them are encoded again. Words that are looked up together.
KEPT_WORDS, KEPT_LENGTH, KEPT_SEAMS, BLOCK = 300_000, 64, 300_000, 20_000
#: Ids that are decoded together.
STRETCH = 1 << 16


def words_of(text: str) -> Iterator[str]:
    """The words that merges don't go across; one after the other where there are very many."""
    pattern = SPLIT if text.isascii() or max(text) < FIRST_NEWER or not SOME_NEWER.search(text) else SPLIT_NEWER
    if len(text) < 1 << 20:
        return iter(pattern.findall(text))
    return (m.group() for m in pattern.finditer(text))


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files of this kind, by rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in set(shown)):
        table[chr(256 + n)] = b
    return table


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda shown: bytes(alphabet[c] for c in shown)
        vocabulary = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # Inside, a token is its rank: the bytes first, then one rank a merge.
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        ranks, tokens = {bytes([b]): b for b in range(256)}, [bytes([b]) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in ((raw(a), raw(b)) for a, b in merges):
            pair = (ranks[left], ranks[right])
            self.merged.setdefault(pair, len(tokens))
            ranks.setdefault(left + right, len(tokens))
            self.parts.append(pair)
            tokens.append(left + right)
        self.ids = np.array([vocabulary[t] for t in tokens], np.uint32)
        self.lengths = [len(t) for t in tokens]
        # The longest token that begins a token, none of a byte.
        self.shorter = [next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), -1) for t in tokens]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, r in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        of_id = {i: t for t, i in vocabulary.items()} | {i: t.encode("utf-8") for t, i in special.items()}
        lengths = np.array([len(of_id.get(i, b"")) for i in range(max(of_id) + 1)], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.blob = np.frombuffer(b"".join(of_id.get(i, b"") for i in range(len(lengths))), np.uint8)
        self.seams: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave a seam between the two tokens where they stand side by side."""
        a, b, limit, ok = left, right, len(self.parts), None
        while ok is None:
            joint = self.merged.get((a, b))
            if joint is not None and joint < limit:
                ok = False
            elif a > b:  # the later merge of the two is undone first; the bytes last
                limit = a
                if a < 256:
                    ok = True
                else:
                    a = self.parts[a][1]
            elif b < 256:
                ok = True
            else:
                limit = b + 1
                b = self.parts[b][0]
        if len(self.seams) >= KEPT_SEAMS:
            self.seams.clear()
        self.seams[left << 32 | right] = ok
        return ok

    def encode_word(self, word: bytes) -> array:
        """The ranks of a word's tokens."""
        n, lengths, shorter, seams = len(word), self.lengths, self.shorter, self.seams
        if n == 1:
            return array("i", list(word))
        longest = [0] * n if n <= KEPT_LENGTH else array("i", bytes(4 * n))
        for last, rank in self.automaton.iter(word.decode("latin-1")):  # ends ascend, so what stays is the longest
            longest[last + 1 - lengths[rank]] = rank
        out, closed, at, rank, before = array("i"), bytearray(n + 1), 0, longest[0], -1
        while at < n:
            while rank >= 0:
                if not closed[at + lengths[rank]]:
                    if before < 0:
                        break
                    known = seams.get(before << 32 | rank)
                    if known or (known is None and self.compatible(before, rank)):
                        break
                rank = shorter[rank]
            if rank >= 0:
                out.append(rank)
                at += lengths[rank]
                before, rank = rank, longest[at] if at < n else -1
            else:
                closed[at] = 1
                last = out.pop()
                at -= lengths[last]
                before, rank = out[-1] if out else -1, shorter[last]
        return out

    def encode_plain(self, text: str) -> Iterator[bytes]:
        """The ids of a text's words, block by block."""
        found, words, ids = words_of(text), self.words, self.ids
        while block := list(islice(found, BLOCK)):
            out = list(map(words.get, block))
            for k in [k for k, packed in enumerate(out) if packed is None]:
                w = block[k]
                packed = words.get(w)
                if packed is None:
                    packed = ids[np.frombuffer(self.encode_word(w.encode("utf-8", "surrogatepass")), np.intc)].tobytes()
                    if len(w) <= KEPT_LENGTH:
                        words[w] = packed
                out[k] = packed
            if len(words) > KEPT_WORDS:
                # The words that came first are the frequent ones; they stay.
                kept = list(islice(words.items(), KEPT_WORDS // 2))
                words.clear()
                words.update(kept)
            yield b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.specials is None or not any(s in text for s in self.special):
            return b"".join(self.encode_plain(text))
        out: list[bytes] = []
        for part in self.specials.split(text):
            if part in self.special:
                out.append(np.uint32(self.special[part]).tobytes())
            else:
                out += self.encode_plain(part)
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4")
        if not len(ids):
            return ""
        parts = []
        for k in range(0, len(ids), STRETCH):
            part = ids[k : k + STRETCH].astype(np.int64)
            first = self.offsets[part]
            lengths = self.offsets[part + 1] - first
            ends = np.cumsum(lengths)
            at = np.arange(ends[-1]) + np.repeat(first - (ends - lengths), lengths)
            parts.append(self.blob[at].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


@lru_cache(4)
def tokenizer(path: str) -> ByteBPE:
    """One a worker and file."""
    return ByteBPE(path)


def encoder(path: str = VOCABULARY):
    """A column function: text to struct(n_tokens long, ids binary)."""

    @F.pandas_udf("n_tokens long, ids binary")
    def encoded(texts: pd.Series) -> pd.DataFrame:
        bpe = tokenizer(path)
        ids = [bpe.encode(t or "") for t in texts]
        return pd.DataFrame({"n_tokens": [len(x) // 4 for x in ids], "ids": ids})

    return encoded


def decoder(path: str = VOCABULARY):
    """A column function: ids binary to the decoded text."""

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        bpe = tokenizer(path)
        return pd.Series([bpe.decode(x or b"") for x in ids], dtype=object)

    return decoded


def encode_column(text: Column, path: str = VOCABULARY) -> Column:
    return encoder(path)(F.coalesce(text, F.lit("")))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """One row per document: the id, n_tokens, ids (packed) and decoded text; one Python worker a task does both."""

    @F.pandas_udf("n_tokens long, ids binary, decoded string")
    def both(texts: pd.Series) -> pd.DataFrame:
        bpe = tokenizer(path)
        ids = [bpe.encode(t or "") for t in texts]
        out = pd.DataFrame({"n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": [bpe.decode(x) for x in ids]})
        give_back()
        return out

    return docs.select(F.col(id_col), both(F.col(text_col)).alias("e")).select(id_col, "e.n_tokens", "e.ids", "e.decoded")


def digests(trip: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return trip.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet")))
