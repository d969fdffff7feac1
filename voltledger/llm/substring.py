"""Substring dedup by matching statistics on suffix automata of reference shards.

A word goes if a window of ``WINDOW`` consecutive words that covers it has a word
sequence that starts anywhere else in the corpus too.

Streaming every document through automata of the whole corpus would cost corpus
times shards. Instead each window is owned by its minimizer, the word ``GRAM``-gram
with the smallest hash in it: equal windows have equal minimizers at the same
place, so a window can only recur among the windows of an equal anchor. The words
around an anchor that its windows cover are its segment.

* Anchors and segments are counted by hash, with map-side combine. A segment that
  occurs twice settles all its windows; an anchor that occurs once has none.
* What is left, anchors with different segments, is the reference: one copy of
  each distinct segment, packed by anchor into shards of about ``SHARD`` words.
  Every shard gets one suffix automaton with occurrence counts; its open segments
  are streamed through it, and places whose match is ``WINDOW`` words long or
  longer, in a state that occurs twice, are covered.
* Anchors with more than ``CROWD`` distinct segments (a passage quoted everywhere)
  don't fit a shard. Their windows are counted by their words, spread over all tasks.

Documents meet the covered places by row keys; nothing is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_keys, stored

WINDOW = 35
GRAM = 8
SHARD = 20_000
CROWD = 300
_MEMO = 300_000  # word hashes that a task remembers


def _hash_words(words: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    if len(memo) > _MEMO:
        memo.clear()
    out = []
    for w in words:
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)


def anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, first window, windows) for the word hashes of one text."""
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none
    grams = np.zeros(n - gram + 1, np.uint64)
    for i in range(gram):
        grams = grams * np.uint64(0x2545F4914F6CDD1D) + hashes[i : n - gram + 1 + i]
    grams = _mixed(grams)
    # Leftmost smallest gram of each window, by doubling.
    span, best, have = window - gram + 1, np.arange(len(grams)), 1
    while have < span:
        step = min(have, span - have)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[left] <= grams[right], left, right)
        have += step
    first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    count = np.diff(np.r_[first, len(best)])
    sums = np.r_[np.uint64(0), np.add.accumulate(_mixed(hashes) * _powers(n, _BASE))]
    end = first + count + window - 1
    segment = _mixed((sums[end] - sums[first]) * _powers(n, _INVERSE)[first])
    return grams[best[first]].view(np.int64), segment.view(np.int64), first, count


class Automaton:
    """Suffix automaton over words, with the weight of the places where each state's words end."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.weight = [-1], [0], [0]

    def _state(self, length: int, nxt: dict[int, int], link: int, weight: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.weight.append(weight)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], 0)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[int], weight: int) -> None:
        """Take in a text of its own."""
        last = 0
        for c in words:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                self.weight[last] += weight
                continue
            new = self._state(self.length[last] + 1, {}, 0, weight)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = new

    def finish(self) -> None:
        """Pass weights down to the suffixes."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.weight[self.link[v]] += self.weight[v]

    def repeated(self, words: list[int], window: int) -> int:
        """Bit i is set if the window that starts at word i ends in a state of weight 2 or more."""
        bits, v, size = 0, 0, 0
        for i, c in enumerate(words):
            while v and c not in self.next[v]:
                v = self.link[v]
                size = self.length[v]
            if c in self.next[v]:
                v, size = self.next[v][c], size + 1
            while self.length[self.link[v]] >= window if v else False:
                v = self.link[v]
                size = self.length[v]
            if size >= window and self.weight[v] >= 2:
                bits |= 1 << (i - window + 1)
        return bits


def _match(rows: list[tuple], window: int) -> list[tuple[int, int, int]]:
    """(anchor, segment, bits) of the open rows of one shard; rows: (anchor, segment, n, words)."""
    ids: dict[bytes, int] = {}
    coded = [[ids.setdefault(w, len(ids)) for w in words.split()] for _, _, _, words in rows]
    automaton = Automaton()
    for (_, _, n, _), words in zip(rows, coded, strict=True):
        automaton.add(words, min(n, 2))
    automaton.finish()
    return [
        (a, s, bits)
        for (a, s, n, _), words in zip(rows, coded, strict=True)
        if n == 1 and (bits := automaton.repeated(words, window))
    ]


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, spans) of the rows of ``docs`` that lose words; spans: arrays of [start, end)."""
    k1, k2 = row_keys(docs)
    rows = docs.select(
        k1.alias("k1"), k2.alias("k2"), docs["text"].cast("string").cast("binary").alias("text")
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for a, b, text in zip(batch.k1, batch.k2, batch.text, strict=True):
                words = text.split() if text else []
                if len(words) >= window:
                    anchor, segment, first, count = anchors(_hash_words(words, memo), window)
                    m = len(anchor)
                    out.append((np.full(m, a), np.full(m, b), anchor, segment, first, count))
                if len(out) >= 500:
                    yield _frame(out)
                    out = []
            yield _frame(out)

    def _frame(parts: list[tuple]) -> pd.DataFrame:
        names = ("k1", "k2", "anchor", "segment", "first", "count")
        if not parts:
            return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
        return pd.DataFrame({n: np.concatenate(x) for n, x in zip(names, zip(*parts, strict=True), strict=True)})

    places = stored(
        rows.mapInPandas(cut, "k1 long, k2 long, anchor long, segment long, first int, count int"),
        "anchors",
    )
    segments = stored(
        places.groupBy("anchor", "segment").agg(
            F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "count")).alias("at")
        ),
        "segments",
    )
    repeated = (
        segments.groupBy("anchor")
        .agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), F.min("n").alias("least"))
        .where("all >= 2")
    )
    settled = segments.where("n >= 2").select(
        "anchor", "segment", F.lit(-1).cast("long").alias("bits")
    )
    # Distinct segments of anchors with an open one, fetched from one of their texts.
    reference = segments.join(repeated.where("kinds > 1 and least = 1"), "anchor").select(
        F.col("at.k1").alias("r1"), F.col("at.k2").alias("r2"),
        F.struct("anchor", "segment", "n", "kinds", "at.first", "at.count").alias("s"),
    )
    wanted = stored(reference.groupBy("r1", "r2").agg(F.collect_list("s").alias("wanted")), "wanted")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, want in zip(batch.text, batch.wanted, strict=True):
                words = text.split()
                for s in want:
                    part = words[s["first"] : s["first"] + s["count"] + window - 1]
                    out.append((s["anchor"], s["segment"], s["n"], s["kinds"], b" ".join(part)))
            yield pd.DataFrame(out, columns=["anchor", "segment", "n", "kinds", "words"])

    # Equal rows fetch the same words; one of them is enough.
    text = stored(
        rows.join(wanted, (rows.k1 == wanted.r1) & (rows.k2 == wanted.r2))
        .select("text", "wanted")
        .mapInPandas(fetch, "anchor long, segment long, n long, kinds long, words binary"),
        "reference",
    )

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard: list[tuple] = []
        group: list[tuple] = []
        size = 0

        def done(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(_match(rows, window), columns=["anchor", "segment", "bits"]).astype("int64")

        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if group and row[0] != group[0][0]:
                    shard += group
                    size += sum(r[3].count(b" ") + 1 for r in group)
                    group = []
                    if size >= SHARD:
                        yield done(shard)
                        shard, size = [], 0
                if not group or row[1] != group[-1][1]:
                    group.append(row)
        yield done(shard + group)

    few = (
        text.where(F.col("kinds") <= CROWD)
        .select("anchor", "segment", "n", "words")
        .repartition("anchor")
        .sortWithinPartitions("anchor", "segment")
        .mapInPandas(shards, "anchor long, segment long, bits long")
    )
    crowd = text.where(F.col("kinds") > CROWD).dropDuplicates(["anchor", "segment"])
    words = F.split(F.col("words").cast("string"), " ")
    windows = crowd.select(
        "anchor", "segment", "n", words.alias("w"),
    ).select(
        "anchor", "segment", "n",
        F.posexplode_outer(
            F.transform(
                F.sequence(F.lit(1), F.size("w") - window + 1),
                lambda i: F.sha2(F.array_join(F.slice("w", i, window), " ").cast("binary"), 256),
            )
        ).alias("i", "window"),
    )
    # The recurring windows join back, one row each, so a hot one is split like any skewed key.
    twice = windows.groupBy("anchor", "window").agg(F.sum("n").alias("all")).where("all >= 2")
    many = (
        windows.where("n = 1")
        .join(twice.select("anchor", "window"), ["anchor", "window"])
        .groupBy("anchor", "segment")
        .agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("bits"))
    )
    outcome = stored(settled.unionByName(few).unionByName(many), "outcome")
    found = places.join(outcome, ["anchor", "segment"])
    return stored(
        found.groupBy("k1", "k2").agg(
            F.collect_set(F.struct("first", "count", "bits")).alias("spans")
        ),
        "covered",
    )


def removed(n: int, spans: Iterator[dict] | None, window: int = WINDOW) -> np.ndarray:
    """Which of n words the covered windows take."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans if spans is not None else ():
        first, count, bits = s["first"], s["count"], s["bits"]
        for i in range(count):
            if bits >> i & 1:
                edge[first + i] += 1
                edge[first + i + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept (text), k1, k2.

    ``kept`` is the text itself where nothing went (null stays null), otherwise the
    words that stay, joined by spaces. Null and empty texts have no words. Equal
    rows each repeat the other.
    """
    k1, k2 = row_keys(docs)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"),
        docs["text"].cast("string").cast("binary").alias("text"),
    )
    spans = covered(docs, window).toDF("g1", "g2", "spans")
    met = rows.join(spans, (rows.k1 == spans.g1) & (rows.k2 == spans.g2), "left").drop("g1", "g2")

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, a, b, text, span in batch.itertuples(index=False, name=None):
                words = text.split() if text else []
                gone = removed(len(words), span, window)
                left = [w for w, g in zip(words, gone, strict=True) if not g] if gone.any() else words
                kept = b" ".join(left)
                out.append(
                    (i, len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(),
                     text if len(left) == len(words) else kept, a, b)
                )
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "k1", "k2"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return met.select("doc_id", "k1", "k2", "text", "spans").mapInPandas(
        strip,
        "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary, k1 long, k2 long",
    )


def strip_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated spans taken out of ``text``, and ``n_chars``, where there is one, counted anew.

    Rows that lose all their words go: nothing is left to train on.
    """
    k1, k2, g1, g2, found = fresh(docs, "k1", "k2", "g1", "g2", "found")
    spans = covered(docs, window).toDF(g1, g2, found)
    a, b = row_keys(docs)
    met = docs.withColumns({k1: a, k2: b}).join(
        spans, (F.col(k1) == F.col(g1)) & (F.col(k2) == F.col(g2)), "left"
    )

    @F.pandas_udf("binary")
    def left(text: pd.Series, span: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, span, strict=True):
            if t is None or s is None:  # Spark calls it on rows that the condition spares, too
                out.append(None)
                continue
            words = t.split()
            gone = removed(len(words), s, window)
            out.append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g))
        return pd.Series(out)

    text = F.when(
        F.col(found).isNotNull(), left(F.col("text").cast("string").cast("binary"), F.col(found)).cast("string")
    ).otherwise(F.col("text"))
    out = met.withColumn("text", text).where(F.col(found).isNull() | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        n = F.when(F.col(found).isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
