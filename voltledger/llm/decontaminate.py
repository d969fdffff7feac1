"""Benchmark decontamination by spaced seeds.

A seed is a window of words hashed through a fixed mask that ignores some places,
so a substituted word there doesn't hide the match. Seeds of the test items and
of the documents are joined by hash; around every hit the item is laid over the
document on that diagonal, and the overlap is verified: some ``OVERLAP``
consecutive item words (all of a shorter item) of which at least ``AGREE`` are the
same.

Documents are turned into seeds and meet the items' seeds without a shuffle; only
the few that have hits are read again to verify them. Item seeds are counted and
broadcast in blocks of bounded size; more items mean more blocks, i.e. more
passes, not larger broadcasts.

Items of fewer than ``SEEDED`` words match verbatim only: their one seed is the hash of all their words.
One of fewer than ``WITHIN`` words is no evidence inside a longer text, and matches a document that is
nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, fresh, row_keys, stored, terms, text_of, union_all

#: Fixed masks: 1 takes a word, 0 ignores it. Found by search: whichever fifth of 10 to 20 words is
#: substituted, one of them still fits between the substitutions.
MASKS = ("110111", "1101011", "101000111")
SEEDED = 10  # words from which on an item is seeded by masks
WITHIN = 5
SPAN = max(SEEDED - 1, *map(len, MASKS))
OVERLAP = 20
AGREE = 0.8
PART = 64  # places handled together
BLOCK_SEEDS = 200_000
BLOCK_ITEMS = 5_000

def _exploded(rows: DataFrame, *keys: str, lengths: Sequence[int] = (), items: bool = False) -> DataFrame:
    """A row per mask and place of column ``words`` where the mask fits: keys, place, seed.

    ``lengths`` are those of the short items: their masks take every word. Of ``items`` themselves
    short ones have that seed only, and long ones the others.

    Texts are cut into overlapping parts first, so that no step carries a long
    text at each of its places. The outer forms, because Spark infers a filter for
    the inner ones and pushes it below ``words``, which would then be made anew.
    """
    masks = [*MASKS, *("1" * n for n in lengths)]
    n = F.size("words")
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(PART)),
        lambda c: F.struct(c.alias("from"), F.slice("words", c + 1, PART + SPAN - 1).alias("words")),
    )
    parts = rows.select(*keys, n.alias("long"), F.explode_outer(cut).alias("part")).select(
        *keys, "long", F.col("part.from").alias("from"), F.col("part.words").alias("words")
    )
    last = F.least(F.lit(PART - 1), n - min(map(len, masks)))
    places = parts.select(
        *keys, "long", "from", "words", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("i")
    )

    def fits(mask: str) -> Column:
        inside = F.col("i") + len(mask) <= n
        if "0" in mask:
            return inside & (F.col("long") >= SEEDED) if items else inside
        return inside & (F.col("long") == len(mask)) if items or len(mask) < WITHIN else inside

    seeds = [
        F.when(
            fits(mask),
            F.xxhash64(F.lit(mask), *[F.get("words", F.col("i") + j) for j, c in enumerate(mask) if c == "1"]),
        )
        for mask in masks
    ]
    return places.select(
        *keys, (F.col("from") + F.col("i")).alias("place"), F.explode_outer(F.array(*seeds)).alias("seed")
    ).where(F.col("seed").isNotNull())


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, words and row hash of the items with a word; equal rows are one item."""
    words = terms(text_of(benchmark))
    own = benchmark["item_id"].cast("long")
    return (
        benchmark.select(own.alias("item_id"), words.alias("words"))
        .where(F.size("words") > 0)
        .withColumn("row", F.xxhash64("item_id", "words"))
        .distinct()
    )


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(k1, k2, item_id, agree): item overlaps verified in rows of ``docs``.

    agree: the largest share of equal words in an overlap. One row per document
    and item. Items without an id are matched under a null id.
    """
    items = stored(items_of(benchmark), "items")
    short = items.where(F.size("words") < SEEDED).select(F.size("words").alias("n")).distinct()
    lengths = sorted(r.n for r in short.collect())  # nine at most
    seeds = stored(
        _exploded(items, "row", lengths=lengths, items=True).withColumnRenamed("place", "at").distinct(), "seeds"
    )
    k1, k2 = row_keys(docs)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), text_of(docs).alias("text"))
    probes = _exploded(rows.select("k1", "k2", terms(F.col("text")).alias("words")), "k1", "k2", lengths=lengths)
    diagonals = stored(
        union_all(
            [
                probes.join(s, "seed").select("k1", "k2", "row", (F.col("place") - F.col("at")).alias("start"))
                for s in blocks(seeds, "seed", BLOCK_SEEDS)
            ]
        ).distinct(),
        "diagonals",
    )
    laid = stored(
        diagonals.groupBy("k1", "k2").agg(F.collect_list(F.struct("row", "start")).alias("laid")),
        "laid",
    )
    # Stored, so that Spark knows the size and broadcasts below its threshold.
    found = rows.join(laid, ["k1", "k2"]).select(
        "k1", "k2", terms(F.col("text")).alias("words"), F.explode("laid").alias("on")
    )
    verified = union_all(
        [
            _verified(found.join(i.select("row", "item_id", F.col("words").alias("item")), F.col("on.row") == F.col("row")))
            for i in blocks(items, "row", BLOCK_ITEMS)
        ]
    )
    return verified.groupBy("k1", "k2", "item_id").agg(F.max("agree").alias("agree"))


def _verified(laid: DataFrame) -> DataFrame:
    """Items laid over a document's words that hold, with the share of equal words."""
    words, start = F.col("words"), F.col("on.start")
    same = F.transform(
        "item", lambda w, j: F.coalesce(F.get(words, start + j) == w, F.lit(False)).cast("int")
    )
    need = F.least(F.size("item"), F.lit(OVERLAP))
    share = F.when(F.size("item") < SEEDED, 1.0).otherwise(AGREE)

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda n, x: n + x)

    windows = F.transform(
        F.sequence(F.lit(1), F.size("item") - need + 1),
        lambda i: total(F.slice(F.col("same"), i, need)),
    )
    return (
        laid.select("k1", "k2", "item_id", "item", same.alias("same"))
        # An overlap can't hold where the whole diagonal agrees in too few words.
        .where(total(F.col("same")) >= share * need)
        .select("k1", "k2", "item_id", (F.array_max(windows) / need).alias("agree"), share.alias("share"))
        .where(F.col("agree") >= F.col("share"))
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, n_items, item_ids (sorted, comma-joined), agree.

    Null and empty texts are clean.
    """
    found = matches(docs, benchmark)
    per_doc = found.groupBy("k1", "k2").agg(
        F.count("*").alias("n_items"),
        F.sort_array(F.collect_set("item_id")).alias("ids"),
        F.max("agree").alias("agree"),
    )
    k1, k2 = row_keys(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"))
    return rows.join(per_doc, ["k1", "k2"], "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.array_join(F.col("ids").cast("array<string>"), ",").alias("item_ids"),
        F.round("agree", 6).alias("agree"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item was found."""
    gone = matches(docs, benchmark).select("k1", "k2").distinct().toDF("g1", "g2")
    k1, k2 = fresh(docs, "k1", "k2")
    a, b = row_keys(docs)
    return (
        docs.withColumns({k1: a, k2: b})
        .join(gone, (F.col(k1) == gone.g1) & (F.col(k2) == gone.g2), "left_anti")
        .select(*docs.columns)
    )
