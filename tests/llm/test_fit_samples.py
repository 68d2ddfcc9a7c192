"""What classifiers learn from: repeated ids and rows, texts that are all long, and texts cut at any place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoscope.llm import _fit, language, quality, toxicity

TEXTS = {"en": "the cat sat on the mat and the dog looked on", "de": "der Hund schlief unter dem Tisch und die Katze sah zu"}


@pytest.mark.parametrize("many", [4, 5, 11])
def test_rows_of_one_id_are_one_row_of_the_language_sample(spark, many, monkeypatch):
    seen = []
    train = language.train
    monkeypatch.setattr(language, "train", lambda rows, *a: seen.append(rows) or train(rows, *a))
    hot = spark.range(60_000).select(F.lit(many).cast("long").alias("doc_id"), F.lit(TEXTS["en"]).alias("text"), F.lit("en").alias("lang"))
    other = spark.createDataFrame([(100 + k, f"{TEXTS['de']} {k}", "de") for k in range(60)], "doc_id long, text string, lang string")
    more = spark.range(3000).select(F.lit(many).cast("long").alias("doc_id"), F.concat(F.lit(TEXTS["en"] + " "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    docs = hot.union(other).union(more)
    if not spark.range(1).select(_fit.held_out("id", 4, 2)).first()[0] and docs.where(F.col("lang") == "en").where(~_fit.held_out("doc_id", 4, 2)).isEmpty():
        pytest.skip("the id is held out")
    model = language.fit(docs)
    count = {y: sum(r[0] == y for r in seen[0]) for y in ("en", "de")}
    assert count["en"] == language.PER_LABEL and 30 <= count["de"] <= 60
    assert model.predict(TEXTS["en"])[0] == "en" and model.predict(TEXTS["de"])[0] == "de"


def test_every_label_is_learnt_from_a_single_row(spark):
    rows = [(k, t, y) for k, (y, t) in enumerate(TEXTS.items(), 3)]
    fold = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string").where(~_fit.held_out("doc_id", 4, 2))
    assert set(language.fit(fold).labels) == {r["lang"] for r in fold.select("lang").distinct().collect()}


def test_text_counts_alike_wherever_it_is_cut(monkeypatch):
    for text in ("ΟΔΟΣΑ", "ΟΔΟΣ ΑΣ, ΣΣ.", "İI ǅ ß ΑΣ" * 3):
        monkeypatch.setattr(language, "_PIECE", 1 << 16)
        whole = language.counts_of(text)
        for piece in range(1, len(text) + 2):
            monkeypatch.setattr(language, "_PIECE", piece)
            assert all(np.array_equal(a, b) for a, b in zip(language.counts_of(text), whole, strict=True)), (text, piece)


def labelled(spark, rows, label):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame(sorted({(i, y) for i, _, y in rows}), f"doc_id long, {label} int")


def test_sampled_texts_of_repeated_ids(spark):
    rows = [(1, f"text {k}", 1) for k in range(5000)] + [(k, f"other {k}", 0) for k in range(2, 60)]
    docs, labels = labelled(spark, rows, "quality")
    got = _fit.sampled_docs(docs.union(docs), labels, "quality", 3, 1, 20).collect()
    ids = [r["fit_id"] for r in got]
    assert len(ids) == len(set(ids)) and len(ids) < 60
    again = _fit.sampled_docs(docs.union(docs).repartition(7), labels, "quality", 3, 1, 20).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_labels_with_long_texts_alone_are_learnt(spark):
    rows = [(k, ("good words in a long text. " if k % 2 else "bad awful noise here. ") * 20, k % 2) for k in range(80)]
    docs, labels = labelled(spark, rows, "quality")
    got = _fit.sampled_docs(docs, labels, "quality", 3, 1, 1000, chars=100).collect()
    kept = labels.where(~_fit.held_out("doc_id", 3, 1)).count()
    assert len(got) == kept and {len(r["text"]) for r in got} == {100} and {r["fit_label"] for r in got} == {0, 1}
    assert all(r["text"] in dict((i, t) for i, t, _ in rows)[r["fit_id"]] for r in got)
    mixed = _fit.sampled_docs(docs.union(spark.createDataFrame([(1, "short")], docs.schema)), labels, "quality", 3, 1, 1000, chars=100).collect()
    assert [r["text"] for r in mixed if r["fit_label"] == 1] == (["short"] if any(r["fit_id"] == 1 for r in mixed) else [r["text"] for r in mixed if r["fit_label"] == 1])


def test_classifiers_take_repeated_and_long_texts(spark):
    rows = [(k, ("kind and useful words. " if k % 2 else "buy cheap pills now. ") * (1 + 1200 * (k % 5 == 0)), k % 2) for k in range(120)]
    docs, labels = labelled(spark, rows + [(7, rows[7][1], 1)] * 200, "quality")
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).where("score IS NULL OR score < 0 OR score > 1").count() == 0
    toxic = toxicity.fit(docs, labels.select("doc_id", (1 - F.col("quality")).alias("toxic")))
    assert toxic is not None
