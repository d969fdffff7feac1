"""Mixing sources to target weights along a curriculum that changes over time.

Targets: sources share all words by weight; what a source would get beyond
``MOST`` times its size is shared anew among the others until none is above.

Every source has a weight schedule over training time t in [0, 1], a straight line
from ``1 - slope`` to ``1 + slope`` times its target. Integrated, it says which
share of the target is demanded by time t; inverted, it gives every word of the
source's stream the time at which it is trained on. The stream runs over the
source's documents in an order of hashes: whole passes, then the documents that
the rest of the target still holds. Documents are range-sorted by time.

A source's running totals don't need its rows in one task: rows are dealt into
buckets of hash ranges, as many as the root of the source's row count, bucket totals
are added up first, and within a bucket rows are added up by a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, numbered, row_keys, stored, text_of, union_all

MOST = 3.0
WEIGHTS = (1.0, 2.0, 3.0)  # by source in code-point order, repeating
SLOPES = (-0.5, 0.0, 0.5)  # early, even and late sources, repeating


def shares(sources: DataFrame, most: float = MOST) -> DataFrame:
    """``sources``, a stored table (source, size, weight), with ``target``: words by weight, ``most`` times the size at most.

    What is shared out per unit of weight rises from round to round, as sources are found full; it is the
    same for all that aren't, so a round is one sum over the sources and the driver holds one number.
    """
    total = sources.agg(F.sum("size").alias("n")).first().n or 0
    full, before = F.lit(False), None
    while True:
        sums = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("size"))), F.lit(0)).alias("size"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        left = total - most * sums["size"]
        share = F.lit(float(left)) * F.col("weight") / F.lit(sums["weight"] or 1.0)
        if (sums["size"], sums["weight"]) == before:
            return sources.withColumn("target", F.when(full, most * F.col("size")).otherwise(share))
        before = (sums["size"], sums["weight"])
        full = share > most * F.col("size")


def _when(slope: Column, x: Column) -> Column:
    """Time by which the share ``x`` of the target is demanded: the root of (1 - slope) t + slope t^2 = x."""
    curved = (slope - 1 + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * x)) / (2 * slope)
    return F.when(F.abs(slope) < 1e-12, x).otherwise(curved)


def plan(docs: DataFrame, most: float = MOST) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, positions, k1, k2.

    copies: how often the document is trained on; positions: the times, ascending.
    Null texts have size 0; documents of size 0 are trained on in whole passes
    only. Equal rows are told apart by nothing, so which of them gets a copy more
    is open, but not how many do.
    """
    k1, k2 = row_keys(docs)
    rows = stored(
        docs.select(
            docs["doc_id"].cast("long").alias("doc_id"),
            docs["source"].cast("string").alias("source"),
            F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size"),
            k1.alias("k1"),
            k2.alias("k2"),
        ),
        "sizes",
    )
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    # Spark orders strings by their bytes, that is by code point.
    ranked = numbered(stored(totals, "sources"), [F.asc_nulls_last("source")], "place")

    def nth(values: Sequence[float]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("place") % len(values) + 1).cast("int"))

    ranked = stored(ranked.withColumn("weight", nth(WEIGHTS)), "weights")
    # Stored, so that Spark knows its size: it broadcasts sources below its threshold, and beyond splits hot ones.
    sources = stored(
        shares(ranked, most).select(
            F.col("source").alias("s"), F.col("size").alias("source_size"), "target", nth(SLOPES).alias("slope"),
            (F.floor(F.sqrt("n")) + 1).alias("buckets"),
        ),
        "targets",
    )
    mixed = F.shiftrightunsigned(F.xxhash64("k2", "k1"), 32)
    dealt = rows.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn(
        "mixed", mixed
    ).withColumn("bucket", F.shiftright(F.col("mixed") * F.col("buckets"), 32))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        sums.select(
            F.col("source").alias("s"),
            F.col("bucket").alias("b"),
            F.coalesce(F.sum("words").over(before), F.lit(0)).alias("bucket_start"),
        ),
        "starts",
    )
    within = Window.partitionBy("source", "bucket").orderBy("mixed", "k1", "k2", "size")
    running = (
        dealt.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("upto", F.col("bucket_start") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("upto") - F.col("size"))
    )
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    # The rest takes documents whose middle lies before its end, so it is met to half a document.
    more = (F.col("size") > 0) & (F.col("start") + F.col("size") / 2 < F.col("rest"))
    counted = (
        running.withColumn("passes", passes.cast("long"))
        .withColumn("rest", rest)
        .withColumn("copies", F.col("passes") + more.cast("long"))
    )
    at = F.transform(
        F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(
            F.array().cast("array<bigint>")
        ),
        lambda i: _when(
            F.col("slope"),
            F.least(
                F.lit(1.0),
                (i * F.col("source_size") + F.col("start") + F.col("size") / 2) / F.col("target"),
            ),
        ),
    )
    return counted.select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), at.alias("positions"), "k1", "k2",
    )


def mix(docs: DataFrame, most: float = MOST) -> DataFrame:
    """The rows of ``docs`` as often as they are trained on, range-sorted by ``position``.

    Adds ``position`` (time in [0, 1]) and ``copy`` (from 0); a column of ``docs``
    with such a name keeps it, and the added one gets an underscore.
    """
    k1, k2, position, copy, nth, order, p1, p2, p, pn = fresh(
        docs, "k1", "k2", "position", "copy", "nth", "row_hash", "p1", "p2", "p", "pn"
    )
    a, b = row_keys(docs)
    # The source goes into the second key, as rows of two sources may have equal keys.
    mine = docs.withColumns({k1: a, k2: F.xxhash64(b, docs["source"].cast("string"))})
    times = stored(
        plan(docs, most).select(
            F.col("k1").alias(p1), F.xxhash64("k2", "source").alias(p2), F.col("positions").alias(p), F.col("copies").alias(pn)
        ),
        "positions",
    )
    twice = stored(times.groupBy(p1, p2).count().where("count > 1").select(p1, p2), "repeated")
    same = (F.col(k1) == F.col(p1)) & (F.col(k2) == F.col(p2))
    # Rows that nothing tells apart are numbered on both sides, so that each gets the copies of one.
    one = Window.partitionBy(k1, k2).orderBy(order)
    alike = Window.partitionBy(p1, p2).orderBy(F.desc(pn), p)
    repeated = mine.join(twice, same, "left_semi").withColumn(order, F.xxhash64(*[docs[c] for c in docs.columns]))
    repeated = repeated.withColumn(nth, F.row_number().over(one))
    numbers = times.join(twice, [p1, p2], "left_semi").withColumn(pn, F.row_number().over(alike))
    alone = times.join(twice, [p1, p2], "left_anti")
    joined = [mine.join(alone, same), repeated.join(numbers, same & (F.col(nth) == F.col(pn)))]
    copies = union_all([j.select(*docs.columns, F.posexplode(p).alias(copy, position)) for j in joined])
    return copies.repartitionByRange(F.col(position)).sortWithinPartitions(position)
