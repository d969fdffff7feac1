"""Conversation prefix trie by the Euler-tour technique.

Conversations that begin with the same turns share those nodes of a trie. A node is known by a
hash of its path: every turn is hashed with its depth, and the path is the sum of
those hashes (four sums of 32 bits each, 128 bits in all), so paths come from prefix sums.

The trie becomes a list of arcs: each node is entered and left; entering leads to the
first child or straight to leaving, leaving leads to the next sibling or to leaving the
parent. The list is ranked in parallel: nodes are numbered by smallest member
and depth, so that most arcs follow one with a number close by. Blocks of numbers
shrink their stretches of the list to one arc each, again and again until one arc is
left; where numbers say little and blocks hardly shrink, arcs chosen by coin absorb their
successors, which shrinks any list. Undone in reverse, this gives every arc its position
and the sums of what lies before it, and a subtree's total is the difference between a
node's two arcs.

No task holds what belongs to one conversation, node or parent: turns and siblings are
numbered by range partitions and joined in blocks, prefix sums are taken within and across
blocks, and members of a node are hashed from pieces of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored

BLOCK = 1 << 14  # arcs, turns or siblings handled together
PIECE = 4096  # conversation ids in a piece
GROUP = 5  # consecutive ids whose conversations share turns of the first one
_LANES = ("s1", "s2", "s3", "s4")
_WEIGHTS = ("step", "leaf", "saved")


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, i, a, b, bytes; i from 0 in each conversation), and (conv, n) of each conversation."""
    text = F.coalesce(conversations["text"].cast("string"), F.lit(""))
    role = F.coalesce(conversations["role"].cast("string"), F.lit(""))
    turns = stored(
        conversations.where(conversations["conv_id"].isNotNull()).select(
            conversations["conv_id"].cast("long").alias("conv"),
            conversations["turn"].cast("long").alias("turn"),
            F.xxhash64(role, text).alias("a"),
            F.xxhash64(F.lit(1), text, role).alias("b"),
            F.octet_length(text).cast("long").alias("bytes"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "turns",
    )
    rows = numbered(turns, [F.col("conv"), F.asc_nulls_first("turn"), F.col("a"), F.col("b"), F.col("row")], "g")
    convs = stored(rows.groupBy("conv").agg(F.min("g").alias("first"), F.count("*").alias("n")), "conversations")
    return _with_block(rows, "g").join(_blocked(convs, "first", "n"), ["conv", "block"]).select(
        "conv", (F.col("g") - F.col("first")).alias("i"), "a", "b", "bytes"
    ), convs.select("conv", "n")


def _with_block(rows: DataFrame, number: str) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col(number) / BLOCK))


def _blocked(keys: DataFrame, first: str, n: str) -> DataFrame:
    """A row of ``keys`` for each block that its numbers from ``first`` on reach into."""
    last = F.floor((F.col(first) + F.col(n) - 1) / BLOCK)
    return keys.withColumn("block", F.explode(F.sequence(F.floor(F.col(first) / BLOCK), last)))


def shared_heads(turns: DataFrame, convs: DataFrame, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Each conversation c after the first h turns of c - c % 5 replaced its own first h.

    h is the CRC-32 of the decimal c modulo ``most``. Returns the turns (conv, d, a, b, bytes; d
    from 1) and (conv, n) as rebuilt, conversations without a turn included.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most))
    base = F.col("conv") - F.col("conv") % GROUP
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plan = stored(
        convs.select("conv", "n", h.alias("h"), base.alias("base"))
        .join(bases, "base", "left")
        .withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0)))),
        "heads",
    )
    own = _with_block(turns, "i").join(
        _blocked(plan.withColumn("zero", F.lit(0)), "zero", "n").select("conv", "block", "h", "head"), ["conv", "block"]
    )
    own = own.where(F.col("i") >= F.col("h")).withColumn("d", F.col("i") - F.col("h") + F.col("head") + 1)
    heads = turns.where(F.col("i") < most - 1).withColumnRenamed("conv", "base").join(
        plan.select("base", "conv", "head"), "base"
    ).where(F.col("i") < F.col("head")).withColumn("d", F.col("i") + 1)
    columns = ("conv", "d", "a", "b", "bytes")
    rebuilt = own.select(*columns).unionByName(heads.select(*columns))
    length = F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return rebuilt, plan.select("conv", length.alias("n"))


def _key(depth: Column, lanes: list[Column]) -> tuple[Column, Column]:
    return F.xxhash64(depth, *lanes), F.xxhash64(F.lit(1), *reversed(lanes), depth)


def paths(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, d, k1, k2, q1, q2, bytes, last): each turn with the keys of its node and of the parent."""
    turns = turns.withColumn("block", F.floor((F.col("d") - 1) / BLOCK))
    x, y = F.xxhash64("d", "a", "b"), F.xxhash64("b", "d", F.lit(1), "a")
    low = F.lit(2**32 - 1)
    own = [x.bitwiseAND(low), F.shiftrightunsigned(x, 32), y.bitwiseAND(low), F.shiftrightunsigned(y, 32)]
    turns = stored(turns.withColumns(dict(zip(_LANES, own, strict=True))), "rebuilt")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = turns.groupBy("conv", "block").agg(*[F.sum(s).alias(s) for s in _LANES])
    starts = sums.select("conv", "block", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in _LANES])
    ends = _blocked(lengths.where("n > 0").withColumn("zero", F.lit(0)), "zero", "n").select("conv", "block", "n")
    within = Window.partitionBy("conv", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    here = [F.col(f"{s}_before") + F.sum(s).over(within) for s in _LANES]
    summed = turns.join(starts, ["conv", "block"]).join(ends, ["conv", "block"]).select(
        "conv", "d", "bytes", "n", *_LANES, *[c.alias(f"{s}_here") for s, c in zip(_LANES, here, strict=True)]
    )
    k1, k2 = _key(F.col("d").cast("long"), [F.col(f"{s}_here") for s in _LANES])
    q1, q2 = _key((F.col("d") - 1).cast("long"), [F.col(f"{s}_here") - F.col(s) for s in _LANES])
    return stored(
        summed.select(
            "conv", F.col("d").cast("long").alias("d"), "bytes", (F.col("d") == F.col("n")).alias("last"),
            k1.alias("k1"), k2.alias("k2"), q1.alias("q1"), q2.alias("q2"),
        ),
        "paths",
    )


def nodes_of(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row per node, numbered from 0 by smallest member and depth: v, conv_id, depth, n_convs, bytes, keys."""
    inner = steps.groupBy("k1", "k2").agg(
        F.min("conv").alias("conv_id"), F.max("d").alias("depth"), F.count("*").alias("n_convs"),
        F.max("bytes").alias("bytes"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
    )
    nothing = F.lit(0).cast("long")
    k1, k2 = _key(nothing, [nothing] * 4)
    root = lengths.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        k1.alias("k1"), k2.alias("k2"), "conv_id", nothing.alias("depth"), "n_convs", nothing.alias("bytes"),
        F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"),
    )
    return numbered(stored(inner.unionByName(root), "nodes"), [F.col("conv_id"), F.col("depth")], "v")


def tree_of(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_children, child (the first one's number), next (sibling), parent and parent_conv_id."""
    sibs = numbered(nodes.where(F.col("q1").isNotNull()).select("q1", "q2", "v"), [F.col(c) for c in ("q1", "q2", "v")], "s")
    families = sibs.groupBy("q1", "q2").agg(
        F.count("*").alias("n_children"), F.min("v").alias("child"), F.min("s").alias("first")
    )
    families = families.withColumnsRenamed({"q1": "k1", "q2": "k2"})
    grown = stored(nodes.join(families, ["k1", "k2"], "left"), "families")
    parents = _blocked(grown.where("n_children > 0"), "first", "n_children").select(
        F.col("k1").alias("q1"), F.col("k2").alias("q2"), "block",
        F.col("v").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
    )
    after = sibs.select((F.col("s") - 1).alias("s"), F.col("q1").alias("r1"), F.col("q2").alias("r2"), F.col("v").alias("next"))
    next_of = sibs.join(after, "s", "left").withColumn(
        "next", F.when((F.col("q1") == F.col("r1")) & (F.col("q2") == F.col("r2")), F.col("next"))
    )
    found = _with_block(next_of, "s").join(parents, ["q1", "q2", "block"]).select("v", "next", "parent", "parent_conv_id")
    return stored(
        grown.drop("first", "q1", "q2").withColumn("n_children", F.coalesce("n_children", F.lit(0))).join(found, "v", "left"),
        "tree",
    )


def arcs_of(tree: DataFrame) -> DataFrame:
    """The tour: arc 2v enters node v, 2v + 1 leaves it; succ is the next arc, null for the last one."""
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    zero = F.lit(0).cast("long")
    enter = F.struct(
        (2 * F.col("v")).alias("id"),
        F.coalesce(2 * F.col("child"), 2 * F.col("v") + 1).alias("succ"),
        F.lit(1).cast("long").alias("step"),
        (F.col("n_children") == 0).cast("long").alias("leaf"),
        saved.alias("saved"),
    )
    leave = F.struct(
        (2 * F.col("v") + 1).alias("id"),
        F.coalesce(2 * F.col("next"), 2 * F.col("parent") + 1).alias("succ"),
        F.lit(1).cast("long").alias("step"), zero.alias("leaf"), zero.alias("saved"),
    )
    return tree.select(F.inline(F.array(enter, leave)))


def _stretches(arcs: pd.DataFrame) -> pd.DataFrame:
    """Arcs of a group with the first arc of their stretch (owner) and the sums before them in it.

    ``succ`` becomes, at the last arc of a stretch, where the stretch leads; elsewhere it is -1.
    """
    arcs = arcs.sort_values("id", ignore_index=True)
    ids, succ = arcs["id"].to_numpy(), arcs["succ"].fillna(-1).to_numpy(np.int64)
    at = np.minimum(np.searchsorted(ids, succ), len(ids) - 1)
    here = ids[at] == succ
    owner = np.arange(len(ids))
    owner[at[here]] = np.flatnonzero(here)
    weights = arcs[list(_WEIGHTS)].to_numpy(np.int64)
    sums = np.where((owner != np.arange(len(ids)))[:, None], weights[owner], 0)
    while True:  # each arc looks twice as far back as before
        further = owner[owner]
        if (further == owner).all():
            break
        sums = sums + sums[owner]
        owner = further
    out = pd.DataFrame(sums, columns=list(_WEIGHTS))
    out.insert(0, "id", ids)
    out.insert(1, "owner", ids[owner])
    out["last"] = ~here
    out["succ"] = pd.array(np.where(here, -1, succ), dtype="Int64")
    out.loc[out["succ"] == -1, "succ"] = pd.NA
    for k, name in enumerate(_WEIGHTS):
        out[f"{name}_all"] = sums[:, k] + weights[:, k]
    return out


def _shrink_blocks(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stretches within ``arcs.grp`` become one arc each: (arcs left, absorbed arcs with owner and sums)."""
    types = "id long, owner long, step long, leaf long, saved long, last boolean, succ long"
    types += "".join(f", {w}_all long" for w in _WEIGHTS)
    columns = ("grp", "id", "succ", *_WEIGHTS)
    done = stored(arcs.select(*columns).groupBy("grp").applyInPandas(lambda pdf: _stretches(pdf), types), "stretches")
    left = done.where("last").select(F.col("owner").alias("id"), "succ", *[F.col(f"{w}_all").alias(w) for w in _WEIGHTS])
    return left, done.select("id", "owner", *_WEIGHTS)


def _shrink_pairs(arcs: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Arcs whose coin shows 0 absorb a successor whose coin shows 1: about a quarter goes, in any list."""
    coin = F.xxhash64(F.col("id"), F.lit(turn)).bitwiseAND(F.lit(1))
    arcs = arcs.select("id", "succ", *_WEIGHTS, coin.alias("coin"))
    takes = arcs.where("coin = 0").drop("coin")
    taken = arcs.where("coin = 1").select(
        F.col("id").alias("x"), F.col("succ").alias("x_succ"), *[F.col(w).alias(f"x_{w}") for w in _WEIGHTS]
    )
    pairs = stored(takes.join(taken, takes["succ"] == taken["x"], "full"), "pairs")
    got = F.col("x").isNotNull()
    merged = pairs.where("id IS NOT NULL").select(
        "id", F.when(got, F.col("x_succ")).otherwise(F.col("succ")).alias("succ"),
        *[(F.col(w) + F.coalesce(f"x_{w}", F.lit(0))).alias(w) for w in _WEIGHTS],
    )
    alone = pairs.where("id IS NULL").select(
        F.col("x").alias("id"), F.col("x_succ").alias("succ"), *[F.col(f"x_{w}").alias(w) for w in _WEIGHTS]
    )
    absorbed = pairs.where("id IS NOT NULL AND x IS NOT NULL").select(F.col("x").alias("id"), F.col("id").alias("owner"), *_WEIGHTS)
    kept = pairs.select(F.coalesce("id", "x").alias("id"), F.coalesce("id", "x").alias("owner"),
                        *[F.lit(0).cast("long").alias(w) for w in _WEIGHTS])
    return merged.unionByName(alone), absorbed.unionByName(kept)


def rank(arcs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, step, leaf, saved): for each arc of the list the sums over all arcs before it.

    ``arcs`` has id (not null, at least 0), succ and the weights; they form one list. ``step`` is the
    position if every arc's step is 1.
    """
    rest = stored(arcs.withColumn("grp", F.floor(F.col("id") / block)), "arcs")
    n, undo, blocks = rest.count(), [], True
    while n > 1:
        left, absorbed = _shrink_blocks(rest) if blocks else _shrink_pairs(rest, len(undo))
        undo.append(absorbed)
        left = stored(left, "left")
        m = left.count()
        blocks, n = m <= n * 0.7 if blocks else True, m
        # Neighbouring groups are put together until they have a block's arcs again.
        grp = F.floor(F.col("id") / block)
        sizes = left.groupBy(grp.alias("own")).agg(F.count("*").alias("arcs"))
        upto = Window.orderBy("own").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select("own", F.floor(F.coalesce(F.sum("arcs").over(upto), F.lit(0)) / block).alias("grp"))
        rest = left.withColumn("own", grp).join(sizes, "own").drop("own")
    ranks = rest.select("id", *[F.lit(0).cast("long").alias(w) for w in _WEIGHTS])
    for absorbed in reversed(undo):
        owners = ranks.select(F.col("id").alias("owner"), *[F.col(w).alias(f"{w}_before") for w in _WEIGHTS])
        ranks = stored(
            absorbed.join(owners, "owner").select("id", *[(F.col(w) + F.col(f"{w}_before")).alias(w) for w in _WEIGHTS]),
            "ranks",
        )
    return ranks


def ends_of(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes at which conversations end."""
    nothing = F.lit(0).cast("long")
    k1, k2 = _key(nothing, [nothing] * 4)
    ends = stored(
        steps.where("last").select("k1", "k2", "conv").unionByName(
            lengths.where("n = 0").select(k1.alias("k1"), k2.alias("k2"), "conv")
        ),
        "ends",
    )

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            a, b, conv = (batch[c].to_numpy() for c in ("k1", "k2", "conv"))
            cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            cut = [range(s, e, PIECE) for s, e in zip(cut, np.r_[cut[1:], len(a)], strict=True)]
            at = np.array([s for r in cut for s in r])
            upto = [min(s + PIECE, r.stop) for r in cut for s in r]
            ids = [",".join(map(str, conv[s:e])) for s, e in zip(at, upto, strict=True)]
            yield pd.DataFrame({"k1": a[at], "k2": b[at], "least": conv[at], "ids": ids})

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(batch.k1, batch.k2, batch.ids, strict=True):
                if (a, b) == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (a, b), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, digest.hexdigest())], columns=["k1", "k2", "ends_sha256"])

    cut = ends.repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv").mapInPandas(
        pieces, "k1 long, k2 long, least long, ids string"
    )
    return cut.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "least").mapInPandas(
        digests, "k1 long, k2 long, ends_sha256 string"
    )


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row per node of the trie of conversations given by ``turns`` (conv, d, a, b, bytes) and ``lengths`` (conv, n).

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, enter and leave (the arcs' positions in the tour).
    """
    steps = paths(turns, lengths)
    tree = tree_of(nodes_of(steps, lengths))
    ranks = rank(arcs_of(tree))
    leave = F.col("id") % 2 == 1

    def between(name: str) -> Column:
        return F.sum(F.when(leave, F.col(name)).otherwise(-F.col(name)))

    subtrees = ranks.groupBy(F.shiftright("id", 1).alias("v")).agg(
        between("leaf").alias("n_leaves"), between("saved").alias("saved_tokens"),
        F.min("step").alias("enter"), F.max("step").alias("leave"),
    )
    return (
        tree.join(subtrees, "v")
        .join(ends_of(steps, lengths), ["k1", "k2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "enter", "leave",
        )
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie (see ``trie``) of ``conversations`` (conv_id, turn, role, text), heads shared as in ``shared_heads``.

    Turns come by ``turn``, null first; equal ones by hashes of role and text, so repeated
    rows are turns of their own, one after the other. Null roles and texts are empty.
    Rows without conv_id belong to no conversation. Without rows there is no node.
    Other columns aren't touched.
    """
    turns, convs = numbered_turns(conversations)
    return trie(*shared_heads(stored(turns, "ordered"), convs))
