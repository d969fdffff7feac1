"""Toxicity learned from the labels table: a linear scorer over hashed words and their prefixes.

At most ``TAUGHT`` labelled texts are drawn by a hash of their id; one fold of
five (``held_out``) is never drawn, so that it can measure the scorer. Of all
prefixes those stay that are clearly more frequent in toxic texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 18
TAUGHT = 4096
COLUMNS = 512  # prefixes and words that the scorer has at most
MOST = 4  # occurrences that count
CLEAR = 15.0  # squared distance from chance, in variances


def slots(word: bytes) -> set[int]:
    """Of a lower-case word: itself and its prefixes of 3 to 9 bytes."""
    return {crc32(word[:k]) % SLOTS for k in range(3, 10) if len(word) >= k} | {crc32(b"= " + word) % SLOTS}


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the fold that is never learned from."""
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(5)) == 0


class Scorer:
    """Weights of the chosen slots; without any, nothing is toxic."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def toxic(self, text: bytes) -> bool:
        if not self.weights:
            return False
        seen: dict[int, int] = {}
        for word, n in Counter(text.lower().split()).items():
            own = self.memo.get(word)
            if own is None:
                if len(self.memo) > 300_000:
                    self.memo.clear()
                own = self.memo[word] = tuple(s for s in slots(word) if s in self.weights)
            for s in own:
                seen[s] = seen.get(s, 0) + n
        return bool(seen) and self.bias + sum(self.weights[s] * min(n, MOST) / MOST for s, n in seen.items()) > 0


def fit(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, rounds: int = 300) -> Scorer:
    """Logistic regression on (slots, counts) rows, over the slots that speak for toxicity."""
    n1 = int(toxic.sum())
    n0 = len(toxic) - n1
    if not n1 or not n0:
        return Scorer({}, 0.0)
    best = np.zeros(SLOTS)
    for least in range(1, MOST):
        has = np.zeros((2, SLOTS))
        for (slot, n), t in zip(rows, toxic, strict=True):
            has[int(t), slot[n >= least]] += 1
        chance = has.sum(axis=0) * n1 / (n0 + n1)
        clear = np.where(has[1] > chance, (has[1] - chance) ** 2 / (chance * n0 / (n0 + n1) + 1), 0)
        best = np.maximum(best, clear)
    top = np.argsort(-best, kind="stable")[:COLUMNS]
    top = top[best[top] > CLEAR]
    column = np.full(SLOTS, -1)
    column[top] = np.arange(len(top))
    x = np.zeros((len(rows), len(top)))
    for i, (slot, n) in enumerate(rows):
        use = column[slot] >= 0
        x[i, column[slot[use]]] = np.minimum(n[use], MOST) / MOST
    balance = np.where(toxic == 1, 0.5 / n1, 0.5 / n0)
    weights, bias, seen, seen_bias = np.zeros(len(top)), 0.0, np.full(len(top), 1e-8), 1e-8
    for _ in range(rounds):
        off = balance * (1 / (1 + np.exp(-np.clip(x @ weights + bias, -50, 50))) - toxic)
        gradient = x.T @ off + 1e-5 * weights
        seen += gradient**2
        seen_bias += off.sum() ** 2
        weights -= 0.5 * gradient / np.sqrt(seen)
        bias -= 0.2 * off.sum() / np.sqrt(seen_bias)
    return Scorer(dict(zip(top.tolist(), weights.tolist(), strict=True)), float(bias))


def learn(docs: DataFrame, labels: DataFrame) -> Scorer:
    """The scorer of ``labels`` (doc_id, toxic) on the texts of ``docs``.

    Ids whose labels clash teach nothing. Of several texts of one id that with the smallest hash is
    taught, so that reruns agree whatever the partitions.
    """
    given = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    given = given.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    given = given.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most")
    drawn = given.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(TAUGHT)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, t in zip(batch.doc_id, batch.text, batch.toxic, strict=True):
                seen: Counter = Counter()
                for word, n in Counter((text or b"").lower().split()).items():
                    for s in slots(word):
                        seen[s] += n
                slot, n = np.array(sorted(seen.items()), "<i4").reshape(-1, 2).T
                out.append((doc_id, np.ascontiguousarray(slot).tobytes(), np.ascontiguousarray(np.minimum(n, 127)).astype("i1").tobytes(), t))
            yield pd.DataFrame(out, columns=["doc_id", "slot", "n", "toxic"])

    taught = (
        texts.join(F.broadcast(drawn), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
        .select("doc_id", "least.text", "toxic")
        .mapInPandas(encode, "doc_id long, slot binary, n binary, toxic int")
        .toPandas()
        .sort_values("doc_id")
    )
    rows = [(np.frombuffer(s, "<i4"), np.frombuffer(n, "i1")) for s, n in zip(taught.slot, taught.n, strict=True)]
    return fit(rows, taught.toxic.to_numpy(np.int64))
