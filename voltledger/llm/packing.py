"""Lexical retrieval packing: sequences of a window's length filled with texts that share rare tokens.

A document is its token ids and an end. Its whole windows are sequences of their own; what is
left of it (its tail) is packed with tails that resemble it:

* Tails are indexed by token in shards, each an inverted index with BM25 weights. Document
  frequencies and the mean length come from all tails; the vocabulary bounds what is broadcast.
* A tail's shard follows from its signature, the token with the smallest hash among its ``RARE``
  rarest ones, so that tails which share rare tokens tend to meet. Signatures lie on a line, each as long
  as its tails have tokens, and shards cut the line into equal lengths: a frequent signature
  spreads over many shards, rare ones share one.
* In a shard the longest unused tail is the seed. The index returns its unused neighbours; those that
  fit fill the window, best first, then the best of the others is cut to fill it to the end; its
  rest stays unused. A seed without neighbours takes the next longest tails instead.
* A shard's last window is cut into sequences whose lengths are powers of two. So none is padded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 1024
SHARD = 1 << 20  # tokens
QUERY = 32  # rarest tokens of a seed that are looked up
RARE = 8
K1, B = 1.2, 0.75
END = 0
SPECIAL = {"<|endoftext|>": 50256}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # on every executor


def tokenizer(vocabulary: str = VOCABULARY):
    """Byte-level BPE from a file of base64 tokens and ranks; special tokens are taken as such.

    The same vocabulary under the same pattern gives the ids of the ``tokenizers`` library in a sixth
    of its time.
    """
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """(row, doc_id, no_id, tokens, whole, tail): a stored row per row of ``docs``.

    whole: CRC-32 of the ids of each whole window; tail: the ids after them, two bytes each.
    """
    own = docs["doc_id"].cast("long")
    rows = docs.select(
        F.coalesce(own, F.lit(0)).alias("doc_id"), own.isNull().alias("no_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            whole, tail, tokens = [], [], []
            for text in batch.pop("text"):
                ids = np.append(bpe.encode_to_numpy(text, allowed_special="all"), END).astype("<u4")
                cut = len(ids) // window * window
                whole.append([crc32(part.tobytes()) for part in ids[:cut].reshape(-1, window)])
                tail.append(ids[cut:].astype("<u2").tobytes())
                tokens.append(len(ids))
            yield batch.assign(tokens=tokens, whole=whole, tail=tail)

    done = rows.mapInPandas(step, "doc_id long, no_id boolean, tokens long, whole array<long>, tail binary")
    return stored(done.withColumn("row", F.monotonically_increasing_id()), "encoded")


def _distinct(tails: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which tail, which token and how often, sorted by both; and the lengths."""
    length = np.fromiter((len(t) // 2 for t in tails), np.int64, len(tails))
    codes = np.repeat(np.arange(len(tails)) << 16, length) | np.frombuffer(b"".join(tails), "<u2")
    codes, n = np.unique(codes, return_counts=True)
    return codes >> 16, codes & 0xFFFF, n, length


def frequencies(tails: DataFrame) -> DataFrame:
    """(token, df, tokens): tails with the token, and under token -1 their number and length in all."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, tokens = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            if len(batch):
                _, token, _, length = _distinct(batch["tail"])
                df += np.bincount(token, minlength=1 << 16)
                n, tokens = n + len(batch), tokens + length.sum()
        seen = np.flatnonzero(df)
        yield pd.DataFrame({"token": np.r_[-1, seen], "df": np.r_[n, df[seen]], "tokens": np.r_[tokens, 0 * seen]})

    counted = tails.select("tail").mapInPandas(tally, "token long, df long, tokens long")
    return counted.groupBy("token").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))


def _hash(token: np.ndarray) -> np.ndarray:
    """A fixed mix of a token's bits."""
    x = token.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def signatures(tails: pd.Series, idf: np.ndarray) -> np.ndarray:
    """Per tail the token with the smallest hash among its ``RARE`` rarest tokens; -1 if all are common."""
    of, token, _, _ = _distinct(tails)
    use = idf[token] > 0
    of, token = of[use], token[use]
    order = np.lexsort((token, -idf[token], of))
    of, token = of[order], token[order]
    first = np.searchsorted(of, of)  # where the tail's tokens begin
    rare = np.arange(len(of)) - first < RARE
    of, token = of[rare], token[rare]
    order = np.lexsort((_hash(token), of))
    of, token = of[order], token[order]
    out = np.full(len(tails), -1, np.int64)
    new = np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, bool)
    out[of[new]] = token[new]
    return out


class Index:
    """Inverted index of a shard: BM25 weights of its tails by token."""

    def __init__(self, tails: pd.Series, idf: np.ndarray, mean: float):
        self.n, self.idf = len(tails), idf
        of, token, times, self.length = _distinct(tails)
        use = idf[token] > 0
        of, token, times = of[use], token[use], times[use]
        weight = idf[token] * times * (K1 + 1) / (times + K1 * (1 - B + B * self.length[of] / mean))
        self.tokens, self.at = token, np.searchsorted(of, np.arange(self.n + 1))
        order = np.argsort(token, kind="stable")
        self.of, self.weight = of[order], weight[order]
        self.posting = np.searchsorted(token[order], np.arange((1 << 16) + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused tails that share rare tokens with the seed, best first, ties by place."""
        token = self.tokens[self.at[seed] : self.at[seed + 1]]
        if len(token) > QUERY:
            token = token[np.argpartition(-self.idf[token], QUERY - 1)[:QUERY]]
        lists = [slice(self.posting[t], self.posting[t + 1]) for t in token]
        if not lists:
            return np.zeros(0, np.int64)
        score = np.bincount(
            np.concatenate([self.of[p] for p in lists]), np.concatenate([self.weight[p] for p in lists]), self.n
        )
        score[~unused] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack(tails: pd.Series, idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (tail, start in it, length) that hold every token of ``tails`` once."""
    index = Index(tails, idf, mean)
    left, begin = index.length.copy(), np.zeros(index.n, np.int64)
    unused = left > 0
    order = np.argsort(-left, kind="stable")
    pieces, room = [], window

    def take(i: int, most: int) -> None:
        nonlocal room
        n = min(int(left[i]), most)
        pieces.append((int(i), int(begin[i]), n))
        begin[i] += n
        left[i] -= n
        unused[i] = left[i] > 0
        room -= n

    for seed in order:
        while unused[seed]:  # again where it was cut
            take(seed, room)
            near = index.neighbours(seed, unused) if room else ()
            while room and len(near):
                fits = near[left[near] <= room]
                if not len(fits):
                    take(near[0], room)  # cut
                    break
                take(fits[0], room)
                near = near[near != fits[0]]
            if not room:
                yield pieces
                pieces, room = [], window
            # Without neighbours the next seed goes on in this window.
    size = window
    while pieces:
        size //= 2
        if window - room < size:
            continue
        part, need = [], size
        while need:
            i, start, n = pieces.pop(0)
            if n > need:
                pieces.insert(0, (i, start + need, n - need))
                n = need
            part.append((i, start, n))
            need -= n
        room += size
        yield part


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end alone. Rows are told apart by their place, so repeated rows are
    packed each for itself, and rows without an id keep none. Reruns over the same files agree. Sequences of
    whole windows have negative ids. An empty table gives no rows. Other columns aren't touched.
    """
    rows = encoded(docs, vocabulary, window)
    tails = rows.where(F.length("tail") > 0)
    counts = frequencies(tails).toPandas()  # a row per token of the vocabulary
    total = counts[counts.token == -1]
    n, tokens = int(total.df.sum()), int(total.tokens.sum())
    counts = counts[counts.token >= 0]
    idf = np.zeros(1 << 16)
    idf[counts.token] = np.maximum(0.0, np.log((n - counts.df + 0.5) / (counts.df + 0.5)))
    spark = docs.sparkSession
    sent, mean = spark.sparkContext.broadcast(idf), max(1.0, tokens / max(1, n))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(signature=signatures(batch["tail"], sent.value))

    signed = stored(
        tails.select("row", "doc_id", "no_id", "tokens", "tail").mapInPandas(
            sign, "row long, doc_id long, no_id boolean, tokens long, tail binary, signature long"
        ),
        "signed",
    )
    length = F.floor(F.length("tail") / 2)
    lines = signed.groupBy("signature").agg(F.sum(length).alias("line")).toPandas().sort_values("signature")
    begin = np.cumsum(lines.line) - lines.line
    lines = spark.createDataFrame(
        [(int(s), int(b), int(m)) for s, b, m in zip(lines.signature, begin, lines.line, strict=True)],
        "signature long, begin long, line long",
    )  # no more rows than the vocabulary has tokens
    spread = F.shiftrightunsigned(F.xxhash64("row"), 11) / float(1 << 53)
    shards = signed.join(F.broadcast(lines), "signature").withColumn(
        "shard", F.floor((F.col("begin") + spread * F.col("line")) / shard)
    )

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        ids = [np.frombuffer(t, "<u2").astype("<u4") for t in pdf["tail"]]
        out = []
        for k, pieces in enumerate(pack(pdf["tail"], sent.value, mean, window)):
            offset = 0
            for i, start, m in pieces:
                out.append((i, start, m, crc32(ids[i][start : start + m].tobytes()), (int(key[0]) << 32) + k, offset))
                offset += m
        out = pd.DataFrame(out, columns=["i", "start", "length", "ids_crc32", "sequence_id", "offset"])
        of = pdf.take(out.pop("i")).reset_index(drop=True)
        out["start"] += of.tokens // window * window  # the tail's place in the document
        return out.assign(doc_id=of.doc_id, no_id=of.no_id, doc_tokens=of.tokens)

    columns = "start long, length long, ids_crc32 long, sequence_id long, offset long, doc_id long, no_id boolean, doc_tokens long"
    short = shards.select("shard", "row", "doc_id", "no_id", "tokens", "tail").groupBy("shard").applyInPandas(fill, columns)
    long = rows.select("doc_id", "no_id", "tokens", F.posexplode("whole").alias("k", "ids_crc32")).select(
        (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        "doc_id", "no_id", F.col("tokens").alias("doc_tokens"),
    )
    return short.unionByName(long).select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"),
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
    )
