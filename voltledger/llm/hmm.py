"""Language-model scores from a hidden Markov model trained with Baum-Welch.

The states emit word classes, a class emits its words: frequent words are classes
of their own, all others share classes by their CRC-32. So emissions are of fixed
size however many words the corpus has, while the probability of a word within its
class comes from the counts of all words. The likelihood of a text is exact: the
scaled forward recursion over its classes, times its words given their classes.

* Words are counted over all training texts; the counts are a table of any size.
* The most frequent words, ``HEAD`` at most, travel with the tasks; every other word of a
  text meets its count in a join, so nothing that grows is broadcast.
* Texts are stored once as class numbers. A round of Baum-Welch adds up expected
  counts in every task, over the texts cut into pieces of ``PIECE`` classes, and
  Spark sums them by parameter; the driver gets one row per parameter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

STATES = 6
OWN = 8192
SHARED = 2048
HEAD = 131_072
ROUNDS = 5
PIECE = 64
PRIOR = 2000.0  # tokens that a state's emissions are smoothed with
END = b""  # no word is empty
_CLASSES = OWN + SHARED + 1  # the last one is the end


class Model(NamedTuple):
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states


def counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the texts of ``docs``, the end included; words are bytes, A-Z lowered."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"word": list(seen.keys()), "c": np.fromiter(seen.values(), np.int64, len(seen))})
            seen.clear()
            return out

        for batch in batches:
            for text in batch.text:
                seen.update(text.lower().split() if text else ())
                seen[END] += 1
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    text = docs.select(docs["text"].cast("string").cast("binary").alias("text"))
    return text.mapInPandas(tally, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The most frequent rows of ``words`` (word, c), ``most`` at the most.

    A histogram of the counts, with steps of about one percent, says from which count on the words are as many; so
    words are filtered where they are, and neither sorted nor gathered to be cut.
    """
    step = F.floor(F.log2("c") * 64)
    bins = words.groupBy(step.alias("step")).count().toPandas().sort_values("step", ascending=False)
    fits = bins["step"][bins["count"].cumsum() <= most]
    return words.where(step >= int(fits.min())) if len(fits) else words.limit(0)


def forward(model: Model, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each class sequence flat[start:start+length], by scaled forward recursion."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
    total = np.zeros(len(length))
    alpha = None
    for t, n in enumerate(active):
        seen = model.emit[flat[start[:n] + t]]
        alpha = (model.start * seen) if t == 0 else (alpha[:n] @ model.move) * seen
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty_like(total)
    out[order] = total
    return out


def expected(model: Model, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple:
    """Expected counts of starts, moves and emissions over the sequences."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")
    alphas, scales, seens, xs = [], [], [], []
    for t, n in enumerate(active):
        x = flat[start[:n] + t]
        seen = model.emit[x]
        alpha = (model.start * seen) if t == 0 else (alphas[-1][:n] @ model.move) * seen
        scale = alpha.sum(axis=1, keepdims=True)
        alphas.append(alpha / scale)
        scales.append(scale)
        seens.append(seen)
        xs.append(x)
    k = len(model.start)
    move = np.zeros((k, k))
    gammas: list[np.ndarray] = [None] * len(active)
    beta = np.ones((active[-1], k))
    gammas[-1] = alphas[-1] * beta
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        ahead = seens[t + 1] * beta / scales[t + 1]
        move += alphas[t][:n].T @ ahead
        beta = np.ones((active[t], k))
        beta[:n] = ahead @ model.move.T
        gammas[t] = alphas[t] * beta
    gamma, x = np.concatenate(gammas), np.concatenate(xs)
    emit = np.stack([np.bincount(x, gamma[:, s], _CLASSES) for s in range(k)], axis=1)
    return gammas[0].sum(axis=0), move * model.move, emit


def train(encoded: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the stored class sequences ``encoded.classes``; ``unigram``: share of each class."""
    draw = np.random.default_rng(1)
    emit = unigram[:, None] * np.exp(0.5 * draw.standard_normal((_CLASSES, states)))
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    model = Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    sizes = (states, states * states, _CLASSES * states)
    spark = encoded.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(tuple(model))

        def step(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            total = np.zeros(sum(sizes))
            for batch in batches:
                flat, start, length = _flat(batch.classes)
                # Pieces, and of those so many at once that memory stays bounded.
                at = [np.arange(s, s + n, PIECE) for s, n in zip(start, length, strict=True)]
                left = [s + n - a for s, n, a in zip(start, length, at, strict=True)]
                at, left = np.concatenate(at), np.minimum(np.concatenate(left), PIECE)
                for i in range(0, len(at), 2048):
                    parts = expected(Model(*sent.value), flat, at[i : i + 2048], left[i : i + 2048])
                    total += np.concatenate([p.ravel() for p in parts])
            slot = np.flatnonzero(total)
            yield pd.DataFrame({"slot": slot.astype(np.int32), "value": total[slot]})

        summed = encoded.select("classes").mapInPandas(step, "slot int, value double")
        rows = summed.groupBy("slot").agg(F.sum("value").alias("value")).toPandas()
        total = np.zeros(sum(sizes))
        total[rows.slot.to_numpy()] = rows.value.to_numpy()
        first, moves, emits = np.split(total, np.cumsum(sizes)[:2])
        first = first + 1
        moves = moves.reshape(states, states) + 1
        emits = emits.reshape(_CLASSES, states) + PRIOR * unigram[:, None]
        model = Model(first / first.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    return model


def _flat(sequences: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(s) // 2 for s in sequences], np.int64)
    flat = np.frombuffer(b"".join(sequences), "<i2")
    return flat, np.r_[0, np.cumsum(length)[:-1]], length


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose CRC-32 of the id, as text, leaves 1 modulo 5 are held out; rows
    without an id are trained on. Null and empty texts are one end. Without any
    training row every class is equally likely.
    """
    spark = docs.sparkSession
    own = docs["doc_id"].cast("long")
    held = F.coalesce(F.pmod(F.crc32(own.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    rows = docs.select(
        own.alias("doc_id"), held.alias("held_out"), docs["text"].cast("string").cast("binary").alias("text")
    )
    vocabulary = stored(counts(rows.where(~F.col("held_out"))), "vocabulary")
    words = vocabulary.where(F.col("word") != F.lit(bytearray(END)))
    everything = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = everything.n or 0, everything.v
    ends = n - (words.agg(F.sum("c").alias("n")).first().n or 0)
    head = frequent(words, HEAD).toPandas().sort_values(["c", "word"], ascending=[False, True])
    shared = words.groupBy(F.pmod(F.crc32("word"), F.lit(SHARED)).cast("int").alias("k")).agg(
        F.sum("c").alias("n"), F.count("*").alias("v")
    ).toPandas()
    # Tokens and words of each shared class, without the words that are classes of their own.
    head_words = [bytes(w) for w in head.word]
    head_c = head.c.to_numpy(np.int64)
    hashed = np.array([crc32(w) % SHARED for w in head_words], np.int64)
    class_n, class_v = np.zeros(SHARED), np.zeros(SHARED)
    class_n[shared.k] = shared.n
    class_v[shared.k] = shared.v
    np.subtract.at(class_n, hashed[:OWN], head_c[:OWN])
    np.subtract.at(class_v, hashed[:OWN], 1)
    of_head = np.where(np.arange(len(head_c)) < OWN, np.arange(len(head_c)), OWN + hashed).astype(np.int16)
    unigram = np.full(_CLASSES, 0.5)
    unigram[: min(OWN, len(head_c))] += head_c[:OWN]
    unigram[OWN : OWN + SHARED] += class_n
    unigram[-1] += ends
    unigram /= unigram.sum()

    def base(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (n + 0.5 * (v + 1)))

    room = class_n + 0.5 * (class_v + 1)
    inside = np.log10((head_c + 0.5) / room[hashed])  # given the class
    inside[:OWN] = 0.0
    sent = spark.sparkContext.broadcast(
        ({w: i for i, w in enumerate(head_words)}, of_head, base(head_c), inside, float(base(np.array(ends))))
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, classes, bases, insides, end = sent.value
        get = known.get
        for batch in batches:
            out = []
            for doc_id, held_out, text in batch.itertuples(index=False, name=None):
                words = text.lower().split() if text else []
                at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                hit = at >= 0
                rare = [words[i] for i in np.flatnonzero(~hit)]
                seq = np.empty(len(words) + 1, "<i2")
                seq[:-1][hit] = classes[at[hit]]
                seq[:-1][~hit] = [OWN + crc32(w) % SHARED for w in rare]
                seq[-1] = _CLASSES - 1
                out.append(
                    (doc_id, held_out, len(words) + 1, int(hit.sum()) + (ends > 0), bases[at[hit]].sum() + end,
                     insides[at[hit]].sum(), rare, seq.tobytes())
                )
            frame = pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "known", "base", "inside", "rare", "classes"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    encoded = stored(
        rows.mapInPandas(
            encode,
            "doc_id long, held_out boolean, n_tokens long, known long, base double, inside double, "
            "rare array<binary>, classes binary",
        ).withColumn("row", F.monotonically_increasing_id()),
        "encoded",
    )  # the row numbers are fixed once they are stored
    model = train(encoded.where(~F.col("held_out")), unigram, states, rounds) if n else Model(
        np.full(states, 1 / states), np.full((states, states), 1 / states), np.repeat(unigram[:, None], states, axis=1)
    )
    classes = spark.createDataFrame(
        [(i, float(room[i])) for i in range(SHARED)], "k int, room double"
    )  # of fixed size
    rare = encoded.select("row", F.explode("rare").alias("word")).join(vocabulary, "word", "left")
    rare = rare.withColumn("k", F.pmod(F.crc32("word"), F.lit(SHARED)).cast("int")).join(F.broadcast(classes), "k")
    c = F.coalesce("c", F.lit(0))
    per_row = rare.groupBy("row").agg(
        F.count("c").alias("rare_known"),
        F.sum(F.log10((c + 0.5) / (n + 0.5 * (v + 1)))).alias("rare_base"),
        F.sum(F.log10((c + 0.5) / F.col("room"))).alias("rare_inside"),
    )
    trained = spark.sparkContext.broadcast(tuple(model))

    def recursion(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["score"] = forward(Model(*trained.value), *_flat(batch.classes)) / np.log(10)
            yield batch.drop(columns="classes")

    flat = encoded.select("row", "classes").mapInPandas(recursion, "row long, score double")
    zero = F.lit(0.0)
    return (
        encoded.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "inside")
        .join(flat, "row")
        .join(per_row, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
            F.round(F.col("score") + F.col("inside") + F.coalesce("rare_inside", zero), 6).alias("score"),
        )
    )
