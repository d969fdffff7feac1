"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. How
accurate each is, is estimated by expectation maximisation over all texts: votes
are counted by pattern (3 ** labellers at most), so the estimation sees every row
and costs the same at any size. The posteriors label a sample of at most
``SAMPLE`` texts, on which a linear scorer over hashed words and word shapes is
fitted; it then scores every text. A scorer learned from labels, where there are any
(``toxicity``), and a short list of English insults mark toxic texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import toxicity
from .common import row_keys, stored

BUCKETS = 1 << 16
SAMPLE = 4096  # texts that the scorer is fitted on
GOOD, BAD, NONE = 1, 0, 2
LABELLERS = ("length", "symbols", "capitals", "variety", "shouting", "function_words", "word_length", "runs", "insults", "toxicity")
#: Everyday function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    b"the and of to a in is it that for on with as be by this are was from or an at not der die das und ist den von zu "
    b"mit ein eine im auf le la les des un une et est que qui pour dans en du au pas el los las de una con por del se".split()
)
INSULTS = frozenset(
    b"idiot idiots moron morons stupid pathetic worthless loser losers scum trash disgusting clown clowns dumb imbecile "
    b"filth vermin".split()
)
TOXIC = 2  # insults that make a text toxic
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_EDGES = b".,;:!?\"'()[]#*$%&|<>"


def votes(text: bytes, scorer: toxicity.Scorer | None = None) -> tuple[list[int], int]:
    """A vote of every labeller, and the insults found. Without a scorer the last one says nothing."""
    lower = text.lower().split()
    n = len(lower)
    if not n:
        return [BAD] + [NONE] * (len(LABELLERS) - 1), 0
    insults = sum(w.strip(_EDGES) in INSULTS for w in lower) if any(w in text.lower() for w in INSULTS) else 0
    size = len(text) - text.count(b" ")
    upper = len(text) - len(text.translate(None, _UPPER))
    letters = upper + len(text) - len(text.translate(None, _LOWER))

    def between(x: float, good: float, bad: float) -> int:
        """Good up to ``good``, bad from ``bad`` on; the other way round if bad is smaller."""
        if bad < good:
            x, good, bad = -x, -good, -bad
        return GOOD if x <= good else BAD if x >= bad else NONE

    return [
        between(n, 20, 3),
        between((len(text) - len(text.translate(None, _SYMBOLS))) / n, 0.03, 0.2),
        between(upper / max(1, letters), 0.15, 0.4),
        between(len(set(lower)) / n, 0.45, 0.25) if n >= 30 and n < 2000 else NONE,
        between(text.count(b"!!") / n, 0.01, 0.08),
        between(sum(w in FUNCTION_WORDS for w in lower) / n, 0.12, 0.04) if n >= 20 else NONE,
        between(size / n, 9.0, 14.0) if size / n >= 3 else BAD,
        between(sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / n, 0.03, 0.15),
        BAD if insults >= TOXIC else NONE,
        BAD if scorer is not None and scorer.toxic(text) else NONE,
    ], insults


def estimate(patterns: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each pattern, accuracy of each labeller) by expectation maximisation.

    patterns: votes by row. For either true class every labeller that speaks has
    its own chance of saying bad, so one that only knows a single kind of bad text
    still counts when it does; an abstention says nothing. The start says that
    good texts are more common and that bad votes are rare on them.
    """
    m = patterns.shape[1]
    prior, says_bad = 0.85, np.array([[0.30] * m, [0.02] * m])  # by true class: bad, good
    bad_votes, good_votes = (patterns == BAD).astype(float), (patterns == GOOD).astype(float)
    posterior = np.full(len(count), prior)
    for _ in range(rounds):
        log = [bad_votes @ np.log(s) + good_votes @ np.log(1 - s) for s in says_bad]
        odds = log[0] + np.log(1 - prior) - log[1] - np.log(prior)
        posterior = 1 / (1 + np.exp(np.clip(odds, -700, 700)))
        for c, weight in ((0, (1 - posterior) * count), (1, posterior * count)):
            said = weight @ bad_votes + 0.5
            says_bad[c] = np.clip(said / (said + weight @ good_votes + 5), 1e-4, 0.95)
        says_bad[1] = np.minimum(says_bad[1], says_bad[0])  # a vote never means its opposite
        prior = np.clip((posterior * count).sum() / max(count.sum(), 1), 0.05, 0.99)
    right = ((1 - posterior) * count) @ bad_votes + (posterior * count) @ good_votes
    return posterior, right / np.maximum(count @ (bad_votes + good_votes), 1)


_SHAPES = bytes(65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i >= 128 else 48 if 48 <= i <= 57 else i for i in range(256))


def features(word: bytes) -> tuple[int, int]:
    """Buckets of a word: of itself and of its shape."""
    shape = word.translate(_SHAPES)
    return crc32(word) % BUCKETS, crc32(b"shape " + shape[:2] + shape[-2:]) % BUCKETS


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on (buckets, shares, posterior) rows: weights and bias."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return weights, bias
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    bucket, share = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    y = np.array([r[2] for r in rows])
    # Both classes weigh the same, so a rare one isn't drowned.
    balance = y * 0.5 / max(y.mean(), 1e-6) + (1 - y) * 0.5 / max(1 - y.mean(), 1e-6)
    seen = np.full(BUCKETS, 1e-8)
    seen_bias = 1e-8
    for _ in range(rounds):
        z = np.bincount(row, weights[bucket] * share, len(rows)) + bias
        off = balance * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(rows)
        gradient = np.bincount(bucket, off[row] * share, BUCKETS) + 1e-7 * weights
        seen += gradient**2
        seen_bias += off.sum() ** 2
        weights -= 2.0 * gradient / np.sqrt(seen)
        bias -= 0.2 * off.sum() / np.sqrt(seen_bias)
    return weights, bias


def classify(
    docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5, labels: DataFrame | None = None
) -> DataFrame:
    """Per row of ``docs``: doc_id, posterior, score, insults, toxic, kept.

    posterior: of the labellers alone; score: of the fitted scorer, 0 to 1. A row
    is kept if both say good on average and it isn't toxic. Null and empty texts have no words
    and aren't kept. ``labels`` (doc_id, toxic) teach toxicity; insults count without them.
    Equal rows give equal rows; what is taught and in what order doesn't depend on partitions.
    """
    k1, k2 = row_keys(docs)
    spark = docs.sparkSession
    rows = docs.select(
        k1.alias("k1"),
        k2.alias("k2"),
        docs["doc_id"].cast("long").isNull().alias("no_id"),
        F.xxhash64(k1, k2).alias("draw"),
        docs["text"].cast("string").cast("binary").alias("text"),
    )

    learned = spark.sparkContext.broadcast(toxicity.learn(docs, labels) if labels is not None else None)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [votes(t or b"", learned.value) for t in batch.text]
            code = [sum(v * 3**i for i, v in enumerate(vs)) for vs, _ in out]
            toxic = [vs[-1] == BAD or insults >= TOXIC for vs, insults in out]
            found = {"code": code, "insults": [insults for _, insults in out], "toxic": toxic}
            yield batch[["k1", "k2", "draw"]].assign(**found)

    voted = stored(
        rows.select("k1", "k2", "draw", "text").mapInPandas(
            vote, "k1 long, k2 long, draw long, code int, insults long, toxic boolean"
        ),
        "votes",
    )
    tally = voted.groupBy("code").count().toPandas().sort_values("code")  # 3 ** labellers rows at most
    patterns = tally.code.to_numpy(np.int64)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    posterior, _ = estimate(patterns.reshape(-1, len(LABELLERS)), tally["count"].to_numpy(float))
    sent = spark.sparkContext.broadcast(dict(zip(tally.code.tolist(), posterior.tolist(), strict=True)))
    edge = voted.select("draw").orderBy("draw").limit(sample).agg(F.max("draw")).first()[0]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch.text:
                words = (text or b"").split()
                of = np.array([b for w in words for b in features(w)], np.int64)
                bucket, times = np.unique(of, return_counts=True)
                code = sum(v * 3**i for i, v in enumerate(votes(text or b"", learned.value)[0]))
                share = times / max(1, len(words))
                out.append((bucket.astype("<i4").tobytes(), share.astype("<f4").tobytes(), sent.value[code]))
            yield pd.DataFrame(out, columns=["bucket", "share", "y"]).assign(draw=batch.draw.to_numpy())

    # Rows at the edge are equal, so it doesn't matter which of them are taught.
    edge_row = F.col("draw") == F.lit(edge).cast("long")
    more = sample - voted.where(F.col("draw") < F.lit(edge).cast("long")).count()
    drawn = rows.where(F.col("draw") < F.lit(edge).cast("long")).unionAll(rows.where(edge_row).limit(more))
    taught = (
        drawn.select("draw", "text")
        .mapInPandas(encode, "draw long, bucket binary, share binary, y double")
        .toPandas()
        .sort_values("draw", kind="stable")
    )
    weights, bias = fit(
        [
            (np.frombuffer(b, "<i4"), np.frombuffer(s, "<f4").astype(float), y)
            for b, s, y in taught[["bucket", "share", "y"]].itertuples(index=False)
        ]
    )
    model = spark.sparkContext.broadcast((weights, bias))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias = model.value
        memo: dict[bytes, float] = {}
        for batch in batches:
            out = []
            for text in batch.text:
                words = (text or b"").split()
                if len(memo) > 300_000:
                    memo.clear()
                total = 0.0
                for w in words:
                    x = memo.get(w)
                    if x is None:
                        a, b = features(w)
                        x = memo[w] = weights[a] + weights[b]
                    total += x
                z = total / max(1, len(words)) + bias
                out.append((float(1 / (1 + np.exp(-min(50.0, max(-50.0, z))))) if words else 0.0, len(words)))
            frame = pd.DataFrame(out, columns=["score", "n_words"], index=batch.index)
            yield batch[["k1", "k2", "no_id"]].join(frame)

    # Votes and scores meet by the rows' keys, a few numbers a row; of equal rows one vote is enough.
    own = voted.groupBy("k1", "k2").agg(*[F.min(c).alias(c) for c in ("code", "insults", "toxic")])
    believed = spark.createDataFrame(
        list(zip(tally.code.tolist(), posterior.tolist(), strict=True)), "code int, posterior double"
    )  # 3 ** labellers rows at most
    scored = (
        rows.select("k1", "k2", "no_id", "text")
        .mapInPandas(score, "k1 long, k2 long, no_id boolean, score double, n_words long")
        .join(own, ["k1", "k2"])
        .join(F.broadcast(believed), "code")
        .withColumn("doc_id", F.when(~F.col("no_id"), F.col("k1")))
    )
    return scored.select(
        "doc_id",
        F.round("posterior", 6).alias("posterior"),
        F.round("score", 6).alias("score"),
        "insults",
        "toxic",
        (
            (F.col("n_words") > 0) & (F.col("posterior") + F.col("score") >= 2 * threshold) & ~F.col("toxic")
        ).alias("kept"),
    )
