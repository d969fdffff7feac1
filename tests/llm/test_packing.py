"""Packing: round trip over odd rows, ids of the tokenizers library, neighbours against brute force."""

from collections import defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

from voltledger.llm import packing

TEXTS = ["", " x<|endoftext|>y <|endoftext|><|endoftext|> z", "I'LL  go\r\n\n İ ſ's 😀 １２", " " * 3000, "ab" * 4000, "<|endoftext|"]


def reference(text):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_round_trip(spark, odd, odd_rows, none):
    rows = [*odd_rows, *((8000 + i, t, "en", "s", 0, *"abcdefghi") for i, t in enumerate(TEXTS))]
    more = spark.createDataFrame(rows[len(odd_rows) :], odd.schema)
    got = packing.packed(odd.unionByName(more), shard=4096).collect()
    # Pieces of a document, and whole documents from them: repeated rows can't be told apart, so count their tokens.
    want, have = defaultdict(list), defaultdict(list)
    for doc_id, text, *_ in rows:
        want[doc_id].append(reference(text))
    for p in got:
        have[doc_id := p.doc_id].append(p)
        ids = [x for x in want[doc_id] if len(x) == p.doc_tokens]
        assert any(crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in ids)
    assert have.keys() == want.keys()
    for doc_id, pieces in have.items():
        places = sorted(i for p in pieces for i in range(p.start, p.start + p.length))
        assert places == sorted(i for x in want[doc_id] for i in range(len(x)))
    sequences = defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end and length > 0
            end += length
        assert end <= 1024 and end & (end - 1) == 0  # none is padded
    assert packing.packed(none).count() == 0


def test_whole_windows_only(spark):
    """Documents of exactly 1024 tokens leave no tails."""
    text = "<|endoftext|>" * 1023
    got = packing.packed(spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3, 4] and len({r.sequence_id for r in got}) == 5
    assert {(r.start, r.length, r.offset, r.doc_tokens) for r in got} == {(0, 1024, 0, 1024)}


def test_neighbours_are_the_best_by_bm25():
    draw = np.random.default_rng(2)
    tails = [draw.zipf(1.4, draw.integers(1, 200)) % 500 for _ in range(120)]
    df = np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=1 << 16)
    idf = np.where(df > 0, np.maximum(0, np.log((120 - df + 0.5) / (df + 0.5))), 0)
    mean = np.mean([len(t) for t in tails])
    index = packing.Index(pd.Series([t.astype("<u2").tobytes() for t in tails]), idf, mean)
    unused = draw.random(120) < 0.7
    for seed in range(120):
        terms = sorted({t for t in tails[seed] if idf[t] > 0}, key=lambda t: -idf[t])
        edge = idf[terms[packing.QUERY - 1]] if len(terms) > packing.QUERY else 0
        if len(terms) > packing.QUERY and idf[terms[packing.QUERY]] == edge:
            continue  # which of equally rare tokens are asked for is open
        score = np.zeros(120)
        for i, t in enumerate(tails):
            for term in terms[: packing.QUERY]:
                n = int((t == term).sum())
                room = n + packing.K1 * (1 - packing.B + packing.B * len(t) / mean)
                score[i] += idf[term] * n * (packing.K1 + 1) / room
        got = index.neighbours(seed, unused)
        assert set(got) == set(np.flatnonzero((score > 0) & unused))
        assert (np.diff(score[got]) <= 1e-9).all()


def test_seeds_meet_their_neighbours(spark):
    """Texts of one topic share sequences."""
    draw = np.random.default_rng(3)
    topics = [[f"{a}{t}{b}" for a in "qzxw" for b in "jkvy"] for t in ("ora", "umi", "ent", "ill", "asp", "ogg")]
    rows = [(i, " ".join(draw.choice(topics[i % 6], 60)) + f" the and of {i}") for i in range(240)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), shard=1 << 14).toPandas()
    shares = [g.groupby(g.doc_id % 6).length.sum().max() / g.length.sum() for _, g in got.groupby("sequence_id")]
    assert np.mean(shares) > 0.8
