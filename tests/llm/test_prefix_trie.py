"""The conversation trie against brute force, and list ranking on lists in any order."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest

from voltledger.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, k1 long, block string, v string, id string, d string"


def tree(rows):
    """Nodes of the rebuilt conversations; rows of equal turn must be equal."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = set()
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(path))
        out.add((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children[path]),
            sum(not children[p] for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def of(df):
    rows = [tuple(r)[:8] for r in prefix_trie.conversation_trie(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def talks():
    draw = random.Random(5)
    rows = []
    for c in [*range(40), 50, 52, 53, 1000003, -3, -10, -12, 2**60 + 1]:
        for t in range(draw.choice([0, 1, 2, 5, 9, 14])):
            rows.append((c, t, draw.choice(["user", None]), draw.choice(["a", "é", "", None, "hello you"])))
    rows += [(7, None, "user", "before all")] * 3 + [(None, 1, "user", "nobody's")] + [(60, 4, "user", "again")] * 30
    rows += [(61, t, "user", "x" * 50_000) for t in range(3)]
    return [(*r, 1, "a", "b", "c", "d") for r in rows]


def test_trie(spark, talks):
    assert of(spark.createDataFrame(talks, SCHEMA).repartition(3)) == tree(talks)


def test_trie_in_small_blocks(spark, talks, monkeypatch):
    """Every key, a conversation, a parent and a node's members among them, reaches over many blocks."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    few = [r for r in talks if r[0] is None or r[0] < 8 or r[0] == 60]
    assert of(spark.createDataFrame(few, SCHEMA).repartition(3)) == tree(few)


def test_given_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert of(df) == tree([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_no_rows(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    nobody = spark.createDataFrame([(None, 1, "user", "a", 1, "", "", "", "")], SCHEMA)
    assert prefix_trie.conversation_trie(nobody).count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_rank(spark, shuffled):
    n = 400
    order = list(range(n))
    if shuffled:  # numbers say nothing, so blocks hardly shrink
        random.Random(1).shuffle(order)
    rows = [(a, b, 1, a % 3, a * 7) for a, b in zip(order, [*order[1:], None], strict=True)]
    arcs = spark.createDataFrame(rows, "id long, succ long, step long, leaf long, saved long")
    want, sums = {}, (0, 0, 0)
    for a in order:
        want[a] = sums
        sums = (sums[0] + 1, sums[1] + a % 3, sums[2] + a * 7)
    got = {r.id: (r.step, r.leaf, r.saved) for r in prefix_trie.rank(arcs, block=32).collect()}
    assert got == want
