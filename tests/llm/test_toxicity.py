"""Toxicity learned from labels, measured on the fold that isn't learned from."""

import numpy as np
from pyspark.sql import functions as F

from voltledger.llm import toxicity, weak_labels


def test_toxic_texts_of_every_language_are_found(spark):
    draw = np.random.default_rng(7)
    stems = {"en": "grumph", "de": "widerl", "fr": "abjec", "es": "despre"}
    docs, labels = [], []
    for i in range(1200):
        lang = list(stems)[i % 4]
        bad = i % 10 < 2
        words = [f"{lang}w{draw.integers(400)}" for _ in range(60)]
        for _ in range(4 if bad else 0):
            words[draw.integers(60)] = stems[lang] + "".join(draw.choice(list("aeiounrst"), 3))
        docs.append((i, " ".join(words), lang))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = weak_labels.classify(docs, labels=labels).withColumnRenamed("toxic", "found")
    rows = got.join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    for lang in stems:
        own = [r for r in rows if r.lang == lang]
        assert np.mean([r.found for r in own if r.toxic]) > 0.9
        assert np.mean([r.found for r in own if not r.toxic]) < 0.02
    assert not any(r.kept for r in rows if r.found)


def test_without_labels_only_insults_are_toxic(spark):
    docs = spark.createDataFrame([(1, "you idiot you moron " * 3), (2, "a fine day")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (None, none):
        assert {r.doc_id: r.toxic for r in weak_labels.classify(docs, labels=labels).collect()} == {1: True, 2: False}


def test_clashing_labels_and_repeated_ids_are_taught_alike(spark):
    texts = [(i, f"{'foulish' if i % 2 else 'fair'} word{i % 7} filler") for i in range(200)]
    marks = [(i, i % 2) for i in range(200)]
    again = [(i, f"other text of {i}") for i in range(0, 200, 3)]
    clash = [(i, 1 - i % 2) for i in range(0, 200, 5)]
    docs = lambda rows, n: spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
    labels = lambda rows, n: spark.createDataFrame(rows, "doc_id long, toxic int").repartition(n)
    want = toxicity.learn(docs(texts + again, 2), labels(marks + clash, 2))
    got = toxicity.learn(docs((texts + again)[::-1], 7), labels((marks + clash)[::-1], 5))
    assert vars(got) == vars(want)
    # Ids whose labels clash teach nothing.
    left = {i for i, _ in clash}
    rest = [m for m in marks if m[0] not in left]
    assert vars(toxicity.learn(docs(texts + again, 2), labels(rest, 2))) == vars(want)


def test_reruns_agree(spark):
    rows = [(i, f"text {i % 37} of words , and more words . {'!' * (i % 3)}") for i in range(300)] + [(7, "same row")] * 200
    docs = lambda rows, n: spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
    of = lambda df: sorted(map(tuple, weak_labels.classify(df, sample=100).collect()))
    assert of(docs(rows, 2)) == of(docs(rows[::-1], 7))
