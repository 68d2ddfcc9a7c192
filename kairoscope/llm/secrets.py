"""Secret scans with corpus-wide ownership frequency.

Pass 1 reads every whole text once and finds the base spans (assignments, access keys and long
hexadecimal runs) and the candidates: the value of each base span and every mixed token of
``MIN_TOKEN`` characters or more with an entropy of ``MIN_ENTROPY`` bits or more a character.
Candidates are hashed, and the hashes are counted over the whole corpus by distinct repository and
distinct owner (pre-aggregated before the shuffle, so that a value that a third of all documents
copy is one row per task).  A value that ``WIDE`` owners or more hold is a copied example, and so is one
that two owners or more hold in ``MANY`` repositories or more; the others are owner-specific and look live, in however many repositories of one owner they lie.
``redact`` asks for ``WIDE`` owners whatever the repositories, so that in doubt it masks.  The verdicts go back to the occurrences
(by the reversed hash, so that both sides are dealt for that join alone and adaptive execution can split a value that very many documents hold), and each document
gets its base spans plus one span a candidate: ``live`` or ``example``.

Nulls and ties.  A null text is empty: no spans.  A null owner or repository counts as one owner of its own.  Rows that
share an id are scanned each for itself.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.llm._memory import give_back
from kairoscope.llm._names import fresh
from kairoscope.session import cut

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{24,}")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
MIN_VALUE, MIN_ACCESS, MIN_TOKEN, MIN_ENTROPY = 8, 16, 24, 3.5
#: Owners from which on a value counts as a copied example.
WIDE = 3
#: Distinct repositories that make a value of two owners an example.
MANY = 100
FOUND = "n_chars long, base array<struct<kind:string,first:long,last:long>>, candidates array<struct<hash:string,first:long,last:long>>"


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """The base spans by kind, and the extent of each one's value."""
    spans, values = [], []
    lower = text.lower() if text.isascii() else text.encode("utf-8").lower().decode("utf-8")
    if any(w in lower for w in WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_VALUE:
                spans.append(("assign", m.start(), m.end()))
                values.append((m.start(2), m.end(2)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                spans.append(("access", m.start(), m.end()))
                values.append((m.start(), m.end()))
    for m in HEX.finditer(text):
        spans.append(("hex", m.start(), m.end()))
        values.append((m.start(), m.end()))
    return spans, values


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def mixed_tokens(text: str) -> list[tuple[int, int]]:
    """Long tokens of upper case, lower case and digits that look random."""
    found = []
    for m in TOKEN.finditer(text):
        v = m.group()
        if any(c.isdigit() for c in v) and v.lower() != v and v.upper() != v and entropy(v) >= MIN_ENTROPY:
            found.append((m.start(), m.end()))
    return found


def apart(tokens: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The tokens that overlap none of the spans, which ascend."""
    firsts, furthest, top = [a for a, _ in spans], [], 0
    for _, b in spans:
        top = max(top, b)
        furthest.append(top)
    out = []
    for a, b in tokens:
        before = bisect_right(firsts, b - 1)  # the spans that begin before the token ends
        if not before or furthest[before - 1] <= a:
            out.append((a, b))
    return out


def found_in(text: str) -> tuple[int, list, list]:
    spans, values = base_spans(text)
    covered = sorted(set(values))
    marks = [(hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest(), a, b) for a, b in [*covered, *apart(mixed_tokens(text), covered)]]
    order = {k: i for i, k in enumerate(KINDS)}
    return len(text), sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])), marks


def scan_text(text: Column) -> Column:
    """struct(n_chars, base, candidates) of a text."""

    @F.pandas_udf(FOUND)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([found_in(t or "") for t in texts], columns=["n_chars", "base", "candidates"])
        give_back()
        return out

    return scanned.asNondeterministic()(F.coalesce(text, F.lit("")))  # so that a filter behind it doesn't scan again


def judged(seen: DataFrame, row: str, repo: str, owner: str, wide: int, many: int | None = None) -> DataFrame:
    """row, m: each occurrence of a candidate of ``seen`` with its verdict (first, last, kind, n_repos, n_owners)."""
    marks = seen.where(F.size("candidates") > 0).select(F.col(row).alias("row"), F.col(repo).alias("r"), F.col(owner).alias("o"), F.explode("candidates").alias("c"))
    marks = marks.select("row", "r", "o", F.reverse("c.hash").alias("turned"), F.col("c.first").alias("first"), F.col("c.last").alias("last"))
    absent = F.lit("\x00")
    held = marks.select(F.reverse("turned").alias("hash"), F.coalesce("o", absent).alias("o"), F.coalesce("r", absent).alias("r")).distinct()
    by_owner = held.groupBy("hash", "o").agg(F.count("*").alias("repos"))
    verdicts = by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))
    verdicts = verdicts.select(F.reverse("hash").alias("of"), "n_repos", "n_owners")
    copied = F.col("n_owners") >= wide
    if many is not None:
        copied = copied | ((F.col("n_owners") >= 2) & (F.col("n_repos") >= many))
    kind = F.when(copied, "example").otherwise("live").alias("kind")
    return marks.join(verdicts, F.col("turned") == F.col("of")).select("row", F.struct("first", "last", kind, "n_repos", "n_owners").alias("m"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str = "source", wide: int = WIDE, many: int | None = MANY) -> DataFrame:
    """One row per document: id, n_chars, base and marked spans.

    marked: array of (kind, first, last, n_repos, n_owners) with kind ``live`` or ``example``.
    repo_col: what counts as a repository, the document itself where it is None.
    wide, many: owners that make an example, and repositories that do with two owners or more (None: none do).
    """
    repo = F.col(repo_col) if repo_col else F.col(id_col)
    # The row number tells rows that share an id apart; the checkpoint fixes it.
    seen = docs.select(F.col(id_col).alias("scan_id"), repo.cast("string").alias("scan_repo"), F.col(owner_col).cast("string").alias("scan_owner"), scan_text(F.col(text_col)).alias("found"))
    seen = cut(seen.select("scan_id", "scan_repo", "scan_owner", "found.*").withColumn("scan_row", F.monotonically_increasing_id()))
    by_row = judged(seen, "scan_row", "scan_repo", "scan_owner", wide, many).groupBy("row").agg(F.array_sort(F.collect_list("m")).alias("marked"))
    out = seen.join(by_row, F.col("scan_row") == F.col("row"), "left")
    none = F.array().cast("array<struct<first:long,last:long,kind:string,n_repos:long,n_owners:long>>")
    return out.select(F.col("scan_id").alias(id_col), "n_chars", "base", F.coalesce("marked", none).alias("marked"))


def joined(spans: str) -> str:
    """SQL: ``kind:first:last`` of an array of spans, comma-joined."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.first, ':', s.last)), ',')"


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The spans of every document; held_by tells of each marked one first:last:repositories:owners, comma-joined."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs)
    count = lambda kind: F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as long)")
    rank = "case s.kind when 'assign' then 0 when 'access' then 1 when 'hex' then 2 when 'live' then 3 else 4 end"
    every = f"transform(array_sort(concat(transform(base, s -> struct(s.first as first, {rank} as rank, s.last as last, s.kind as kind)), transform(marked, s -> struct(s.first as first, {rank} as rank, s.last as last, s.kind as kind)))), s -> struct(s.kind as kind, s.first as first, s.last as last))"
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.expr(f"sha2({joined('base')}, 256)").alias("base_sha256"),
        F.expr(joined(every)).alias("spans"),
        F.expr("cast(size(filter(marked, s -> s.kind = 'live')) as long)").alias("n_live"),
        F.expr("cast(size(filter(marked, s -> s.kind = 'example')) as long)").alias("n_example"),
        F.expr("array_join(transform(marked, s -> concat(s.first, ':', s.last, ':', s.n_repos, ':', s.n_owners)), ',')").alias("held_by"),
    )


def disjoint(spans: Column) -> Column:
    """Sorted spans (first, last) with those that overlap made one: a value may hold another of its own extent."""

    def add(done: Column, s: Column) -> Column:
        top = F.try_element_at(done, F.lit(-1))
        joined = F.struct(top["first"].alias("first"), F.greatest(top["last"], s["last"]).alias("last"))
        return F.when(s["first"] < top["last"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<first:bigint,last:bigint>>"), add)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", wide: int = WIDE, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the values that look live replaced by ``mask``, overlapping ones by one; copied examples stay as they are.

    What is masked depends on the text alone, as a value has one verdict in the corpus.  So the spans are kept by the
    text's SHA-256, and each row is masked by those of its own text, whether its id is null, shared or not.
    n_chars, where there is one, follows the new text.
    """
    whole = F.coalesce(F.col(text_col), F.lit(""))
    seen = docs.select(F.sha2(whole, 256).alias("key"), F.col(id_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), scan_text(F.col(text_col)).alias("found"))
    seen = cut(seen.where(F.size("found.candidates") > 0).select("key", "repo", "owner", "found.candidates"))
    live = judged(seen, "key", "repo", "owner", wide).where("m.kind = 'live'").select("row", "m.first", "m.last").distinct()
    spans = live.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    key, of, cuts = fresh(docs, "text_key", "of_key", "live_spans")
    out = docs.withColumn(key, F.sha2(whole, 256)).join(spans.select(F.col("row").alias(of), disjoint(F.col("spans")).alias(cuts)), F.col(key) == F.col(of), "left")
    # From the last span to the first, so that the positions before a span stay as they were.
    masked = F.aggregate(F.reverse(cuts), F.col(text_col), lambda t, s: F.concat(F.substring(t, F.lit(1), s["first"].cast("int")), F.lit(mask), F.substring(t, (s["last"] + 1).cast("int"), F.length(t))))
    out = out.withColumn(text_col, F.when(F.col(cuts).isNull(), F.col(text_col)).otherwise(masked))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast("long")))
    return out.select(*docs.columns)
