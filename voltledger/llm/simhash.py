"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint takes, bit by bit, the majority over the XXH64 hashes of its
word shingles. Fingerprints within ``distance`` bits are linked. Their 64 bits
are cut into segments, so that two linked ones differ by at most
``distance // segments`` bits in some segment: each fingerprint enumerates the
small Hamming balls around its segment values, fetches the fingerprints filed
under them, and the complete distance is then verified. Linked fingerprints form
components.

Equal fingerprints are one node, whatever the number of copies. A pair is only
taken in the first segment that finds it, so no pair occurs twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fresh, row_keys, stored

BITS = 64


def shingles(data: bytes | None, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """Hashes of a text's word shingles in order; a shorter text is one shingle, none without words."""
    words = data.lower().split() if data else []
    if not words:
        return np.zeros(0, "<u8")
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.array([xxhash.xxh64_intdigest(p, seed) for p in parts], dtype="<u8")


def simhash(data: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of UTF-8 text; 0 for a text without words or None."""
    return majority(shingles(data, shingle, seed))


def majority(hashes: np.ndarray) -> int:
    """Signed long of the bits that most hashes have; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 65536):
        block = hashes[start : start + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """The fingerprint of a string column as a long."""

    @pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([simhash(x, shingle) for x in s], dtype="int64")

    return of(text.cast("binary"))


def _segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m segments that cover 64 bits."""
    widths = [BITS // m + (i < BITS % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def links(prints: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct longs in ``prints.fp`` within ``distance`` bits."""
    radius = distance // segments
    parts = _segments(segments)

    def value(fp: Column, shift: int, width: int) -> Column:
        return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))

    def key(k: int, v: Column) -> Column:
        return v.bitwiseOR(F.lit(k << 56))

    def asks(k: int, v: Column, width: int) -> Column:
        masks = F.array(
            *[
                F.lit(sum(1 << b for b in bits))
                for r in range(radius + 1)
                for bits in combinations(range(width), r)
            ]
        )
        if radius == 1:  # of two values that differ in one bit, the one without it asks
            masks = F.filter(masks, lambda x: v.bitwiseAND(x) == 0)
        return F.transform(masks, lambda x: key(k, v.bitwiseXOR(x)))

    fp = F.col("fp")
    filed = [key(k, value(fp, *part)) for k, part in enumerate(parts)]
    probes = [asks(k, value(fp, *part), part[1]) for k, part in enumerate(parts)]
    table = prints.select(fp.alias("b"), F.explode(F.array(*filed)).alias("slot"))
    asked = prints.select(fp.alias("a"), F.explode(F.flatten(F.array(*probes))).alias("slot"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    near = F.bit_count(differ) <= distance
    # The pair belongs to the first segment whose values are within the radius.
    first = F.lit(None)
    for k in reversed(range(segments)):
        first = F.when(F.bit_count(value(differ, *parts[k])) <= radius, k).otherwise(first)
    mine = F.shiftright(F.col("slot"), 56) == first
    if radius == 1:
        # Equal segment values meet from both sides, others from one.
        same = F.lit(False)
        for k, part in enumerate(parts):
            same = same | ((first == k) & (value(differ, *part) == 0))
        once = ~same | (F.col("a") < F.col("b"))
    else:
        once = F.col("a") < F.col("b")
    found = asked.join(table, (asked.slot == table.slot) & (F.col("a") != F.col("b")) & near)
    return (
        found.select("a", "b", asked.slot.alias("slot"))
        .where(mine & once)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); the root is the smallest node reachable.

    Alternates two steps that hang neighbours below the smallest one around each
    node, and ends when nothing changes. Every round is stored, so lineage stays
    short; a hub's rows are reduced to a minimum before they are shuffled.
    """
    step = stored(edges.select("a", "b"), "links")

    def hang(pairs: DataFrame, at: str, other: str, keep_own: bool) -> DataFrame:
        least = pairs.groupBy(F.col(at).alias("hub")).agg(F.min(other).alias("least"))
        least = least.select("hub", F.least("hub", "least").alias("least"))
        out = pairs.join(least, pairs[at] == least.hub).select(
            F.col(other).alias("a"), F.col("least").alias("b")
        )
        if keep_own:
            out = out.unionByName(least.select(F.col("hub").alias("a"), F.col("least").alias("b")))
        return out.where("a != b")

    before = None
    while True:
        both = step.select("a", "b").unionByName(
            step.select(F.col("b").alias("a"), F.col("a").alias("b"))
        )
        # Larger neighbours go below the smallest of the neighbourhood ...
        large = both.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("least"))
        large = large.select("hub", F.least("hub", "least").alias("least"))
        up = (
            both.join(large, both.a == large.hub)
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .distinct()
        )
        # ... then smaller ones, the node itself included.
        down = hang(up, "a", "b", keep_own=True).select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
        step = stored(down.distinct(), "links")
        now = step.agg(
            F.count("*").alias("n"),
            F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x"),
        ).first()
        if before is not None and (now.n, now.x) == before:
            break
        before = (now.n, now.x)
    roots = step.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return step.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def near_duplicates(
    docs: DataFrame, shingle: int = 4, distance: int = 4, segments: int = 3
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id and its row keys k1, k2.

    component_id is the smallest doc_id reachable over links; null where no row
    of the component has an id. Null and empty texts have fingerprint zero.
    Other columns of ``docs`` aren't touched.
    """
    k1, k2 = row_keys(docs)
    rows = stored(
        docs.select(
            docs["doc_id"].cast("long").alias("doc_id"),
            k1.alias("k1"),
            k2.alias("k2"),
            fingerprint(docs["text"].cast("string"), shingle).alias("fp"),
        ),
        "fingerprints",
    )
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(prints, distance, segments))
    named = stored(
        prints.join(roots, prints.fp == roots.node, "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        ),
        "roots",
    )
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "root").select("fp", "component_id", "root")
    return rows.join(of, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "root",
        "k1",
        "k2",
    )


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4, segments: int = 3) -> DataFrame:
    """The rows of ``docs`` without all but one row of each component.

    The row with the smallest id stays, nulls last; among equal ids the one whose
    text hash is smallest, and of fully equal rows one.
    """
    return one_of_each(docs, near_duplicates(docs, shingle, distance, segments))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which ``found`` (doc_id, root, k1, k2) puts no better row in their component."""
    stay = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id"), "k1", "k2")).alias("m"))
    stay = stay.select(F.col("m.k1").alias("s1"), F.col("m.k2").alias("s2"))
    k1, k2, nth, order = fresh(docs, "k1", "k2", "nth", "row_hash")
    a, b = row_keys(docs)
    keyed = docs.withColumns({k1: a, k2: b, order: F.xxhash64(*[docs[c] for c in docs.columns])})
    one = Window.partitionBy(k1, k2).orderBy(order)
    return (
        keyed.join(stay, (keyed[k1] == stay.s1) & (keyed[k2] == stay.s2), "left_semi")
        .withColumn(nth, F.row_number().over(one))
        .where(F.col(nth) == 1)
        .select(*docs.columns)
    )
