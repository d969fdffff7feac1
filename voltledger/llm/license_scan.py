"""Licence scans with a positional index of rare words.

Licence notices are templates. Each template's words with the highest inverse
document frequency in the scanned corpus are filed in an index with their places.
A file's occurrences of those words are looked up; every posting proposes a start
of the template, and postings that agree on it are intersected. A start holds if
the template's mandatory key phrases stand at their places and the words found
there carry enough of the template's IDF weight.

The short base phrases are templates of their own, indexed by their rarest word
and verified word by word. The vocabulary is that of the templates, so document
frequencies (counted over all files), index and templates are of fixed size.
Only built-in expressions are used.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_keys, stored, terms, text_of

#: The base phrases of the contract and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices as (label, words, key phrases). Words as the scan takes them: lower case, no punctuation.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge", "person obtaining a copy")),
    ("mit", "released under the mit license", ("under the mit license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("free software", "gnu general public license")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "you should have received a copy of the gnu affero general public license", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)

RARE = 4  # indexed words of a notice
AGREE = 2  # index words that must propose the same start
COVER = 0.75  # least share of a notice's IDF weight found in place
PART = 256  # words in a part of a text


def _find(words: list[str], phrase: str) -> int:
    part = phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(part)] == part)


def vocabulary() -> list[str]:
    texts = [*BASE, *(n[1] for n in NOTICES)]
    return sorted({w for t in texts for w in t.split()})


def reach() -> int:
    """How far from a word of a template its other words can stand."""
    return max(len(t.split()) for t in [*BASE, *(n[1] for n in NOTICES)]) - 1


def parts_of(rows: DataFrame, *keys: str) -> DataFrame:
    """Texts cut into parts of ``PART`` words: keys, words, first (place in the text of the first one), own.

    A part also has the words around it that a template can reach; of its places those
    from ``own`` on, ``PART`` of them, are its own. So each place is owned once and no row has more
    than a part of a text, whatever the text's length.
    """
    near = reach()
    first = lambda c: F.greatest(c - near, F.lit(0))
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(PART)),
        lambda c: F.struct(
            first(c).alias("first"),
            (c - first(c)).alias("own"),
            F.slice("words", first(c) + 1, c - first(c) + PART + near).alias("words"),
        ),
    )
    return rows.select(*keys, F.explode_outer(cut).alias("part")).select(*keys, "part.*")


def idf(files: DataFrame) -> dict[str, float]:
    """Inverse document frequency of the template words over ``files`` (column ``known``: distinct ones)."""
    n = files.count()
    rows = files.select(F.explode("known").alias("word")).groupBy("word").count().collect()
    seen = {r["word"]: r["count"] for r in rows}
    return {w: log((n + 1) / (seen.get(w, 0) + 0.5)) for w in vocabulary()}


def index(weights: dict[str, float]) -> list[tuple]:
    """Postings (word, template, place, label, base, words, weights, keys, least) of the rarest words."""
    out = []
    templates = [(label, phrase, (phrase,), True) for phrase, label in BASE.items()]
    templates += [(label, text, keys, False) for label, text, keys in NOTICES]
    for t, (label, text, keys, base) in enumerate(templates):
        words = text.split()
        total = sum(weights[w] for w in words)
        order = sorted(range(len(words)), key=lambda i: (-weights[words[i]], i))
        must = sorted({_find(words, k) + j for k in keys for j in range(len(k.split()))})
        for place in order[: 1 if base else RARE]:
            out.append(
                (words[place], t, place, label, base, words, [weights[w] / total for w in words], must, 1 if base else AGREE)
            )
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null texts are empty: no words, empty labels, score 0. The score is the
    largest IDF-weighted share of a held notice or phrase; a base phrase has 1. Equal rows
    give equal rows, one each; time grows with a text's length, however long.
    """
    spark = docs.sparkSession
    k1, k2 = row_keys(docs)
    base = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), text_of(docs).alias("text")
    )
    known = F.array(*[F.lit(w) for w in vocabulary()])
    files = stored(
        base.select("doc_id", "k1", "k2", terms(F.col("text")).alias("words")).select(
            "doc_id",
            "k1",
            "k2",
            F.size("words").cast("long").alias("n_words"),
            F.array_intersect("words", known).alias("known"),
        ),
        "files",
    )
    filed = index(idf(files))
    rare = sorted({p[0] for p in filed})
    postings = spark.createDataFrame(
        filed,
        "word string, template int, place int, label string, base boolean, notice array<string>, "
        "weight array<double>, must array<int>, least int",
    )
    words, start = F.col("words"), F.col("start")
    places = F.when(
        F.exists("words", lambda w: w.isin(rare)),
        F.filter(
            F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))),
            lambda x: x.word.isin(rare) & (x.at >= F.col("own")) & (x.at < F.col("own") + PART),
        ),
    )
    hits = (
        parts_of(base.select("k1", "k2", terms(F.col("text")).alias("words")), "k1", "k2")
        .select("k1", "k2", "words", "first", F.explode_outer(places).alias("on"))  # outer: no filter is inferred
        .join(F.broadcast(postings), F.col("on.word") == F.col("word"))  # a row per indexed word
        .withColumn("start", F.col("on.at") - F.col("place"))
        .where(
            F.forall("must", lambda i: F.coalesce(F.get(words, start + i) == F.get("notice", i), F.lit(False)))
        )
    )
    share = F.aggregate(
        F.transform(
            "notice",
            lambda w, i: F.when(F.get(words, start + i) == w, F.get("weight", i)).otherwise(0.0),
        ),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    starts = (
        hits.select(
            "k1", "k2", "template", (F.col("first") + start).alias("began"), "place", "label", "base", "least", share.alias("share")
        )  # not named start, which would be taken for the one in the share's lambda
        .where(F.col("base") | (F.col("share") >= COVER))
        .groupBy("k1", "k2", "template", "began", "label", "base", "least")
        .agg(F.countDistinct("place").alias("agree"), F.max("share").alias("share"))
        .where("agree >= least")
    )
    own = F.col("base")
    found = starts.groupBy("k1", "k2").agg(
        F.count_if(own).alias("n_base"),
        F.min(F.when(own, F.col("began"))).cast("long").alias("first_word"),
        F.max(F.when(own, F.col("began"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(own, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(F.when(own, 1.0).otherwise(F.least("share", F.lit(1.0)))).alias("score"),
    )
    return files.join(found, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )
