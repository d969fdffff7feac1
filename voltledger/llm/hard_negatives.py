"""Hard-negative mining with rotated one-bit codes.

Vectors become whole numbers, and a row's score is its integer inner product with an
anchor. Scoring every pair is avoided by codes: a vector is rotated (random signs and
a Hadamard transform, twice) and described by a short chain of sign vectors. Each takes
the signs of what the ones before it leave, and is stored as bits together with its
alignment, the inner product of the code and that rest; the norms of the vector and
of the last rest are stored too. From two chains follow

* an estimate of the inner product: alignments times code products, which are popcounts;
* an interval that holds for certain: by Cauchy-Schwarz the rests move the product by
  at most |rest of q| |x| + |q| |rest of x|.

A pair is scored only if its interval reaches a place that is still to be had.
Intervals are widened by the rounding error of their arithmetic, so results are exact.

Anchors are dealt into blocks of bounded size; each block is broadcast and meets all rows
in Arrow tasks, which keep the best of each anchor as they read on. Spark ranks the tasks'
best by anchor. First come the positives (rows of the anchor's label), whose
scores bound the negatives that the second pass looks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, union_all

ROW_CODES = 4
ANCHOR_CODES = 7
BLOCK_BYTES = 16_000_000  # of anchors that are broadcast at once
TILE = 64  # anchors in a step of a task
MOST_SCORE = (2**63 - 1) // 100  # scores beyond it are clipped, so that 100 times a score is a long


class Codes(NamedTuple):
    """Coded vectors: ``bits`` rows x codes x words, ``along`` rows x codes, norms of rows and rests."""

    bits: np.ndarray
    along: np.ndarray
    norm: np.ndarray
    rest: np.ndarray

    def of(self, at) -> Codes:
        return Codes(*(a[at] for a in self))


def rotate(x: np.ndarray, seed: int = 1) -> np.ndarray:
    """Rows of ``x`` (a power of two wide) under a random rotation that keeps inner products."""
    draw = np.random.default_rng(seed)
    n, width = x.shape
    for _ in range(2):
        x = x * draw.choice((-1.0, 1.0), width)
        half = 1
        while half < width:
            pairs = x.reshape(n, -1, 2, half)
            x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, width)
            half *= 2
        x = x / np.sqrt(width)
    return x


def encode(x: np.ndarray, codes: int) -> Codes:
    """The chain of one-bit codes of each row of ``x``; zeros fill up to a power of two, 64 at least."""
    width = max(64, 1 << max(0, x.shape[1] - 1).bit_length())
    rest = rotate(np.pad(x, ((0, 0), (0, width - x.shape[1]))))
    norm = np.sqrt((rest * rest).sum(axis=1))
    bits, along = [], []
    for _ in range(codes):
        up = rest >= 0
        sign = np.where(up, 1.0, -1.0)
        along.append((rest * sign).sum(axis=1) / np.sqrt(width))
        rest = rest - along[-1][:, None] * sign / np.sqrt(width)
        bits.append(np.packbits(up, axis=1, bitorder="little").view("<u8"))
    return Codes(np.stack(bits, axis=1), np.stack(along, axis=1), norm, np.sqrt((rest * rest).sum(axis=1)))


def intervals(q: Codes, x: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of every vector of ``q`` with every one of ``x``."""
    words = x.bits.shape[2]
    total = q.along.sum(axis=1)[:, None]
    middle = np.zeros((len(q.norm), len(x.norm)))
    for k in range(x.bits.shape[1]):
        differ = np.zeros_like(middle)
        for m in range(q.bits.shape[1]):
            count = np.bitwise_count(q.bits[:, m, None, 0] ^ x.bits[None, :, k, 0])
            for w in range(1, words):
                count = count + np.bitwise_count(q.bits[:, m, None, w] ^ x.bits[None, :, k, w]).astype(np.int32)
            differ += q.along[:, m, None] * count
        middle += x.along[None, :, k] * (total - differ / (32 * words))
    both = q.norm[:, None] * x.norm
    slack = q.rest[:, None] * x.norm + q.norm[:, None] * x.rest + 1e-9 * both + 1e-6
    return middle - slack, middle + slack


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of paired rows of whole numbers, clipped to ``MOST_SCORE``."""
    most = np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(1, q.shape[1])
    if most < 2.0**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(q, x, strict=True)]
    return np.array([max(-MOST_SCORE, min(MOST_SCORE, s)) for s in exact], np.int64)


class Best:
    """The first ``most`` rows of each list by score, ties by id, rows without an id last."""

    def __init__(self, most: int, least: np.ndarray):
        self.most, self.least = most, least  # least: what a row must score to enter a list
        self.rows = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))]

    def add(self, at: np.ndarray, score: np.ndarray, no_id: np.ndarray, ident: np.ndarray) -> None:
        if len(at):
            self.rows.append((at, score, no_id, ident))

    def settle(self) -> tuple[np.ndarray, ...]:
        """Cut every list to its first rows and raise what the full ones ask for."""
        at, score, no_id, ident = (np.concatenate(p) for p in zip(*self.rows, strict=True))
        if len(self.rows) > 1:
            order = np.lexsort((ident, no_id, -score, at))
            at = at[order]
            first = np.r_[True, at[1:] != at[:-1]]
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            stay = place < self.most
            at, score, no_id, ident = at[stay], *(a[order][stay] for a in (score, no_id, ident))
            full = place[stay] == self.most - 1
            self.least[at[full]] = score[full]
            self.rows = [(at, score, no_id, ident)]
        return at, score, no_id, ident


def _ints(cells: pd.Series, dims: int) -> np.ndarray:
    """Rows of whole numbers, as doubles; stored in four bytes where they fit, else in eight."""
    out = np.zeros((len(cells), dims))
    for row, cell in zip(out, cells, strict=True):
        if len(cell) == 4 * dims:
            row[:] = np.frombuffer(cell, "<i4")
        else:
            row[:] = np.frombuffer(cell, "<f8")
    return out


def _codes(cells: pd.Series, codes: int, words: int) -> Codes:
    flat = np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), -1)
    cut = codes * words * 8
    bits = np.ascontiguousarray(flat[:, :cut]).view("<u8").reshape(len(cells), codes, words)
    floats = np.ascontiguousarray(flat[:, cut:]).view("<f8")
    return Codes(bits, floats[:, :codes], floats[:, codes], floats[:, codes + 1])


def coded(vectors: DataFrame, anchor: Column, vector: str = "embedding", scale: int = 256) -> tuple[DataFrame, int]:
    """The rows that take part, stored with their codes (row, vec_id, no_id, label, anchor, ints, code), and their width.

    A row without a label or vector, or with a null or non-finite component, takes no
    part. Shorter vectors are filled up with zeros.
    """
    x = vectors[vector].cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(vectors["label"].isNotNull() & x.isNotNull() & sound).select(
        F.coalesce(vectors["vec_id"].cast("long"), F.lit(0)).alias("vec_id"),
        vectors["vec_id"].isNull().alias("no_id"),
        vectors["label"].cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        x.alias("x"),
    )
    dims = rows.agg(F.max(F.size("x")).alias("d")).first().d or 1

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            whole = np.zeros((len(batch), dims))
            for row, cell in zip(whole, batch.pop("x"), strict=True):
                row[: len(cell)] = cell
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(scale * whole), -1e150, 1e150)
            small = np.abs(whole).max(axis=1) < 2**31
            code = encode(whole, ROW_CODES)
            floats = np.column_stack((code.along, code.norm, code.rest)).astype("<f8")
            batch["ints"] = [(w.astype("<i4") if s else w.astype("<f8")).tobytes() for w, s in zip(whole, small, strict=True)]
            batch["code"] = [b.tobytes() + f.tobytes() for b, f in zip(code.bits, floats, strict=True)]
            yield batch

    done = rows.mapInPandas(step, "vec_id long, no_id boolean, label long, anchor boolean, ints binary, code binary")
    return stored(done.withColumn("row", F.monotonically_increasing_id()), "codes"), dims


def _blocks(anchors: DataFrame, dims: int) -> list[DataFrame]:
    """``anchors``, a stored table, in parts of about ``BLOCK_BYTES``; more anchors make more parts."""
    n = max(1, -(-anchors.count() * (dims + 64) * 8 // BLOCK_BYTES))
    return [anchors.where(F.pmod(F.xxhash64("row"), F.lit(n)) == i) for i in range(n)]


def _tiles(rows: int) -> Iterator[slice]:
    """Rows of a batch in steps that grow, so that the first ones tell the others what to beat."""
    start, size = 0, 256
    while start < rows:
        yield slice(start, start + size)
        start, size = start + size, min(2048, 2 * size)


def positives(rows: DataFrame, dims: int, most: int = 5) -> DataFrame:
    """(row, place, positive_id, positive_score): each anchor's first other rows of its label."""
    words = max(64, 1 << max(0, dims - 1).bit_length()) // 64
    found = []
    for block in _blocks(rows.where("anchor"), dims):
        a = block.select("row", "label", "ints").toPandas()
        if not len(a):
            continue
        q = _ints(a.ints, dims)
        sent = rows.sparkSession.sparkContext.broadcast(
            (a.row.to_numpy(), a.label.to_numpy(), q, encode(q, ANCHOR_CODES))
        )

        def step(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            row, label, q, codes = sent.value
            best = Best(most, np.full(len(row), -MOST_SCORE - 1, np.int64))
            for batch in batches:
                x, code = _ints(batch.ints, dims), _codes(batch.code, ROW_CODES, words)
                ident, no_id = batch.vec_id.to_numpy(), batch.no_id.to_numpy()
                own, of = batch.row.to_numpy(), batch.label.to_numpy()
                for name in np.intersect1d(of, label):
                    mine, theirs = np.flatnonzero(label == name), np.flatnonzero(of == name)
                    for tile in _tiles(len(theirs)):
                        j = theirs[tile]
                        for s in range(0, len(mine), TILE):
                            i = mine[s : s + TILE]
                            _, high = intervals(codes.of(i), code.of(j))
                            u, v = np.nonzero(~(high < best.least[i][:, None]) & (row[i][:, None] != own[j]))
                            u, v = i[u], j[v]
                            best.add(u, scores(q[u], x[v]), no_id[v], ident[v])
                        best.settle()
            yield _frame(row, best, "row", "positive_id", "positive_score")

        tasks = rows.select("row", "vec_id", "no_id", "label", "ints", "code")
        found.append(stored(tasks.mapInPandas(step, "row long, positive_id long, positive_score long"), "positives"))
        sent.destroy()
    if not found:
        return rows.sparkSession.createDataFrame([], "row long, place int, positive_id long, positive_score long")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    return union_all(found).select("row", F.row_number().over(order).alias("place"), "positive_id", "positive_score").where(
        F.col("place") <= most
    )


def _frame(keys: np.ndarray, best: Best, key: str, ident: str, score: str) -> pd.DataFrame:
    at, s, no_id, i = best.settle()
    ids = pd.array(i, dtype="Int64")
    ids[no_id] = pd.NA
    return pd.DataFrame({key: keys[at], ident: ids, score: s})


def mine(
    vectors: DataFrame,
    anchor: Column,
    vector: str = "embedding",
    scale: int = 256,
    n_positives: int = 5,
    n_negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row of ``vectors`` (vec_id, label, ``vector``) where ``anchor`` holds and each of its
    ``n_positives`` best other rows of the same label: the first ``n_negatives``
    rows of other labels whose score lies between ``low`` and ``high`` percent of
    the positive's, best first. Ties go to the smaller vec_id, rows without one
    last. Components become floor(scale * x); who takes no part says ``coded``. Repeated rows are rows of
    their own, so a repeated anchor is its copy's positive and answers twice. An
    anchor without positives, or a positive without such negatives, gives no rows. Scores are clipped
    to ``MOST_SCORE``. Other columns aren't touched.
    """
    rows, dims = coded(vectors, anchor, vector, scale)
    pairs = stored(positives(rows, dims, n_positives), "pairs")
    words = max(64, 1 << max(0, dims - 1).bit_length()) // 64
    per_anchor = pairs.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("pairs")
    )  # n_positives at most each
    anchors = stored(rows.where("anchor").select("row", "vec_id", "no_id", "label", "ints").join(per_anchor, "row"), "anchors")
    found = []
    for block in _blocks(anchors, dims):
        a = block.toPandas()
        if not len(a):
            continue
        # One list per anchor and positive: who it belongs to, and 100 times the scores it takes.
        lists = [
            (i, None if r.no_id else r.vec_id, p.place, p.positive_id, p.positive_score)
            for i, r in enumerate(a.itertuples(index=False))
            for p in r.pairs
        ]
        lists = pd.DataFrame(lists, columns=["at", "anchor_id", "place", "positive_id", "positive_score"]).astype(
            {"anchor_id": "Int64", "positive_id": "Int64"}
        )
        lists["row"] = a.row.to_numpy()[lists["at"]]
        q = _ints(a.ints, dims)
        sent = rows.sparkSession.sparkContext.broadcast((lists, a.label.to_numpy(), q, encode(q, ANCHOR_CODES)))

        def step(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            lists, label, q, codes = sent.value
            of_list = lists["at"].to_numpy()
            start = np.searchsorted(of_list, np.arange(len(label)))  # lists of an anchor lie together
            ps = lists.positive_score.to_numpy()
            least, most = -(-low * ps // 100), high * ps // 100  # whole scores that satisfy both bounds
            best = Best(n_negatives, least.copy())
            top = np.maximum.reduceat(most, start)
            for batch in batches:
                x, code = _ints(batch.ints, dims), _codes(batch.code, ROW_CODES, words)
                ident, no_id = batch.vec_id.to_numpy(), batch.no_id.to_numpy()
                of = batch.label.to_numpy()
                for tile in _tiles(len(of)):
                    j = np.arange(len(of))[tile]
                    enter = np.minimum.reduceat(best.least, start)
                    for s in range(0, len(label), TILE):
                        i = np.arange(s, min(len(label), s + TILE))
                        below, above = intervals(codes.of(i), code.of(j))
                        reach = ~(above < enter[i][:, None]) & ~(below > top[i][:, None])
                        u, v = np.nonzero(reach & (label[i][:, None] != of[j]))
                        u, v = i[u], j[v]
                        score = scores(q[u], x[v])
                        n = np.bincount(of_list, minlength=len(label))[u]
                        for k in range(n_positives):
                            has = np.flatnonzero(k < n)
                            at = start[u[has]] + k
                            fits = (score[has] >= best.least[at]) & (score[has] <= most[at])
                            has, at = has[fits], at[fits]
                            best.add(at, score[has], no_id[v[has]], ident[v[has]])
                    best.settle()
            out = _frame(np.arange(len(ps)), best, "list", "negative_id", "negative_score")
            yield lists.drop(columns="at").take(out.pop("list")).reset_index(drop=True).join(out)

        schema = (
            "anchor_id long, place int, positive_id long, positive_score long, row long, "
            "negative_id long, negative_score long"
        )
        tasks = rows.select("vec_id", "no_id", "label", "ints", "code")
        found.append(stored(tasks.mapInPandas(step, schema), "negatives"))
        sent.destroy()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not found:
        return vectors.sparkSession.createDataFrame([], result)
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    return union_all(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
