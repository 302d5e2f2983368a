"""Operator 11: the trie of conversation prefixes, from sorted sequences and range minima.

A conversation is the sequence of its turns' 128-bit hashes of role and text. Sequences are sorted, and LCP[i] is the number of turns
that sequence i shares with the one before it. The members of the prefix of depth d of sequence i are an interval of
the sorted order: all positions around i that are reached over LCPs of at least d. A sparse table holds the least LCP
of every 2^j neighbours; each candidate prefix binary-searches its left and its right end in it, on its own, so neither a
stack nor an order of candidates is needed. Candidates are the prefixes that begin at i (d > LCP[i]) and their parents. A second
sparse table gives the smallest member; subtree sums are differences of running sums, because the candidates of a subtree
follow each other.

At scale the order is a range sort by (sequence, conv_id), so a group of equal or similar conversations spreads over tasks. Tasks work
on blocks of about `BLOCK_TURNS` turns. Only prefixes of a block's first and last sequence can have members in other blocks. These open
nodes, at most two paths for each block, are merged by the hash of their prefix; all others are final in their block. The sums of open
nodes are joined back to blocks by (block, node). No text is shuffled or gathered: a turn is a hash and a length.

Defined results: a null role or text is empty; rows without a conv_id take no part; turns are ordered by number, null first, and
by hash where numbers are equal; repeated rows are turns of their own; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.llm.shared import staged

HASH = 16  # bytes of a turn's hash
BLOCK_TURNS = 1 << 18
NO_MEMBER = hashlib.sha256(b"").hexdigest()

_NODE_TYPES = pa.schema([
    ("block", pa.int64()), ("node", pa.int64()), ("parent", pa.int64()), ("open", pa.bool_()), ("parent_open", pa.bool_()),
    ("prefix", pa.binary()), ("parent_prefix", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("tokens", pa.int64()), ("ends", pa.string()), ("ends_sha256", pa.string())])
NODES = (
    "block long, node long, parent long, open boolean, parent_open boolean, prefix binary, parent_prefix binary, conv_id long, "
    "depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, tokens long, ends string, "
    "ends_sha256 string")


# ---- range minima ---------------------------------------------------------------------------

class RangeMinimum:
    """Sparse table: level j holds the least of 2^j neighbours from each place on."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            step, last = 1 << len(self.levels) - 1, self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least value at a..b-1, for a < b."""
        level = np.frexp((b - a).astype(float))[1] - 1  # the largest power of two that fits
        out = np.empty(len(a), self.levels[0].dtype)
        for j in np.unique(level):
            own = level == j
            out[own] = np.minimum(self.levels[j][a[own]], self.levels[j][b[own] - (1 << j)])
        return out

    def right_end(self, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """First place from `at` on whose value is below `floor`, or the end."""
        at = at.copy()
        for j in reversed(range(len(self.levels))):
            level = self.levels[j]
            fits = at < len(level)
            fits[fits] = level[at[fits]] >= floor[fits]
            at[fits] += 1 << j
        return at

    def left_end(self, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Last place down from `at` whose value is below `floor`, or -1."""
        at = at.copy()
        for j in reversed(range(len(self.levels))):
            from_ = at - (1 << j) + 1
            fits = from_ >= 0
            fits[fits] = self.levels[j][from_[fits]] >= floor[fits]
            at[fits] -= 1 << j
        return at


def shared_turns(a: bytes, b: bytes) -> int:
    """Number of leading turns that two sequences have in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // HASH
    low, high = 0, n // HASH
    while high - low > 8:  # halves, then single turns
        middle = (low + high) // 2
        if a[low * HASH: middle * HASH] == b[low * HASH: middle * HASH]:
            low = middle
        else:
            high = middle
    while a[low * HASH: (low + 1) * HASH] == b[low * HASH: (low + 1) * HASH]:
        low += 1
    return low


# ---- nodes of one block ---------------------------------------------------------------------

def block_nodes(block: int, conv_ids: list[int], sequences: list[bytes], lengths: list[np.ndarray]) -> pa.RecordBatch:
    """All nodes whose prefix begins in the block, with what the block knows of them."""
    m = len(sequences)
    size = np.array([len(s) // HASH for s in sequences])
    lcp = np.array([-1] + [shared_turns(a, b) for a, b in zip(sequences, sequences[1:])])
    table, smallest = RangeMinimum(lcp), RangeMinimum(np.array(conv_ids, np.int64))

    new = size - lcp  # candidates that begin at each sequence
    offset = np.concatenate(([0], np.cumsum(new)))
    home = np.repeat(np.arange(m), new)
    depth = np.arange(len(home)) - offset[home] + lcp[home] + 1

    left = np.maximum(table.left_end(home, depth), 0)
    right = table.right_end(home + 1, depth)
    above = depth - 1  # of parents, whose intervals are searched on their own
    parent_left = np.maximum(table.left_end(home, above), 0)
    parent = np.where(depth > 0, offset[parent_left] + above - lcp[parent_left] - 1, -1)
    count = right - left

    edge = (left == 0) | (right == m)  # may have members in other blocks
    children = np.bincount(parent[parent >= 0], minlength=len(home))
    inner_children = np.bincount(parent[(parent >= 0) & ~edge], minlength=len(home))
    tokens = np.concatenate([np.concatenate(([0], x))[-n:] if n else x[:0] for x, n in zip(lengths, new.tolist())]) if m else np.zeros(0)
    tokens = tokens.astype(np.int64)
    leaf = (children == 0) & ~edge
    weight = np.where(edge, 0, (count - 1) * tokens)
    after = offset[right]
    running = lambda x: np.concatenate(([0], np.cumsum(x)))
    leaves, saved = running(leaf), running(weight)
    here = np.arange(len(home))

    # members that end at a node are the equal sequences from its left end on
    ending = np.flatnonzero(depth == size[left])
    same = np.concatenate((np.flatnonzero(~((lcp == size) & (np.concatenate(([-1], size[:-1])) == size))), [m]))
    stop = same[np.searchsorted(same, left[ending], side="right")]
    ends: list[str | None] = [None] * len(home)
    digest = [NO_MEMBER] * len(home)
    for k, a, b in zip(ending.tolist(), left[ending].tolist(), stop.tolist()):
        text = ",".join(map(str, conv_ids[a:b]))
        if edge[k]:
            ends[k] = text
        else:
            digest[k] = hashlib.sha256(text.encode()).hexdigest()

    prefix, parent_prefix = [None] * len(home), [None] * len(home)
    for which in dict.fromkeys([0, m - 1]) if m else ():
        sha, names = hashlib.sha256(), []
        for d in range(size[which] + 1):
            names.append(sha.digest()[:HASH])
            sha.update(sequences[which][d * HASH: (d + 1) * HASH])
        path = np.full(size[which] + 1, which)
        start = np.maximum(table.left_end(path, np.arange(size[which] + 1)), 0)
        for d, k in enumerate((offset[start] + np.arange(size[which] + 1) - lcp[start] - 1).tolist()):
            prefix[k], parent_prefix[k] = names[d], names[d - 1] if d else None

    parent_open = (parent >= 0) & edge[parent]
    parent_least = smallest.least(parent_left, table.right_end(home + 1, above))
    final = ~edge
    return pa.record_batch([
        pa.array(np.full(len(home), block)), pa.array(here), pa.array(parent), pa.array(edge), pa.array(parent_open),
        pa.array(prefix, pa.binary()), pa.array(parent_prefix, pa.binary()), pa.array(smallest.least(left, right)),
        pa.array(depth), pa.array(parent_least, mask=(parent < 0) | parent_open), pa.array(count),
        pa.array(np.where(final, children, inner_children)), pa.array(leaves[after] - leaves[here]), pa.array(saved[after] - saved[here]),
        pa.array(tokens), pa.array(ends, pa.string()), pa.array(digest, pa.string()),
    ], schema=_NODE_TYPES)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a sorted partition; their numbers follow the sorted order."""
    block = TaskContext.get().partitionId() << 32
    ids, sequences, lengths, turns = [], [], [], 0
    for batch in batches:
        for conv_id, sequence, chars in zip(
                batch.column("conv_id").to_pylist(), batch.column("sequence").to_pylist(), batch.column("chars").to_pylist()):
            ids.append(conv_id)
            sequences.append(sequence)
            lengths.append(np.array(chars, np.int64))
            turns += 1 + len(chars)
            if turns >= BLOCK_TURNS:
                yield from _slices(block_nodes(block, ids, sequences, lengths))
                ids, sequences, lengths, turns, block = [], [], [], 0, block + 1
    if ids:
        yield from _slices(block_nodes(block, ids, sequences, lengths))


def _slices(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


# ---- open nodes -----------------------------------------------------------------------------

def _open_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """prefix, n_leaves, saved_tokens: what the merged nodes that a block owns add to the open nodes of their paths there.

    Rows come sorted by block; a block has at most the prefixes of two sequences.
    """
    kinds = pa.schema([("prefix", pa.binary()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])
    names = ("block", "node", "parent", "prefix", "leaf", "saved")
    rows = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in names]))
    out = []
    for _, own in groupby(rows, key=lambda r: r[0]):
        nodes = {r[1]: r for r in own}
        sums = {k: [r[4], r[5]] for k, r in nodes.items()}
        for k in sorted(nodes, reverse=True):  # a node's number is larger than its parent's
            above = sums.get(nodes[k][2])
            if above:
                above[0] += sums[k][0]
                above[1] += sums[k][1]
        out += [{"prefix": nodes[k][3], "n_leaves": a, "saved_tokens": b} for k, (a, b) in sums.items() if a or b]
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist(out, kinds)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, kinds)


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """prefix, ends_sha256 from the lists of ending members, which come in order."""
    rows = (r for b in batches for r in zip(b.column("prefix").to_pylist(), b.column("ends").to_pylist()))
    kinds, out = pa.schema([("prefix", pa.binary()), ("ends_sha256", pa.string())]), []
    for prefix, own in groupby(rows, key=lambda r: r[0]):
        sha = hashlib.sha256()
        for i, (_, text) in enumerate(own):
            sha.update(("," if i else "").encode() + text.encode())
        out.append({"prefix": prefix, "ends_sha256": sha.hexdigest()})
    if out:
        yield pa.RecordBatch.from_pylist(out, kinds)


def _merged(open_rows: DataFrame) -> DataFrame:
    """One row per open node with its final values, by prefix."""
    alike = open_rows.groupBy("prefix").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_prefix").alias("parent_prefix"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("_children"), F.sum("n_leaves").alias("_leaves"),
        F.sum("saved_tokens").alias("_saved"), F.first("tokens").alias("tokens"), F.min("block").alias("_owner"))
    below = alike.where(F.col("parent_prefix").isNotNull()).groupBy(F.col("parent_prefix").alias("prefix")).agg(
        F.count(F.lit(1)).alias("_open_children"))
    nodes = staged(alike.join(below, "prefix", "left").withColumn(
        "n_children", F.col("_children") + F.coalesce("_open_children", F.lit(0))), "open-nodes")

    # every merged node is added once to the paths of its first block
    owned = nodes.select(
        "prefix", F.col("_owner").alias("block"), (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("tokens")).alias("saved"))
    paths = open_rows.select("block", "node", "parent", "prefix").join(owned, ["prefix", "block"], "left").select(
        "block", "node", "parent", "prefix", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("saved", F.lit(0)).alias("saved"))
    added = paths.repartition("block").sortWithinPartitions("block", "node").mapInArrow(
        _open_sums, "prefix binary, n_leaves long, saved_tokens long").groupBy("prefix").agg(
        F.sum("n_leaves").alias("_more_leaves"), F.sum("saved_tokens").alias("_more_saved"))
    digests = open_rows.where(F.col("ends").isNotNull()).select("prefix", "block", "ends").repartition("prefix").sortWithinPartitions(
        "prefix", "block").mapInArrow(_end_digests, "prefix binary, ends_sha256 string")
    return nodes.join(added, "prefix", "left").join(digests, "prefix", "left").select(
        "prefix", "parent_prefix", "conv_id", "depth", "n_convs", "n_children",
        (F.col("_leaves") + F.coalesce("_more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("_saved") + F.coalesce("_more_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_MEMBER)).alias("ends_sha256"))


# ---- conversations --------------------------------------------------------------------------

def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): per conversation its turns in order, each a hash of role and text and the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(  # sorts by turn, null first, then by hash
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("mark"),
        F.length(text).cast("long").alias("chars"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("_turn"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns")).select(
        "conv_id", F.transform("_turns", lambda t: F.struct(t["mark"].alias("mark"), t["chars"].alias("chars"))).alias("turns"))


def with_shared_openings(sequences: DataFrame, largest: int = 6, family: int = 100) -> DataFrame:
    """Each conversation's first turns replaced by those of its family's first conversation.

    The family of c begins at c - c % family; h = crc32(c) % largest turns are taken over, fewer if there are fewer, and c's
    own turns go on after its first h. A family has less than two times `family` conversations, so the join has no hot key.
    """
    head = sequences.select(F.col("conv_id").alias("_family"), F.slice("turns", 1, largest - 1).alias("_opening"))
    h = (F.crc32(F.col("conv_id").cast("string")) % largest).cast("int")
    rows = sequences.select("conv_id", "turns", h.alias("_h"), (F.col("conv_id") - F.col("conv_id") % family).alias("_family"))
    opening = F.when(F.col("_opening").isNotNull(), F.slice("_opening", F.lit(1), F.col("_h"))).otherwise(F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.join(head, "_family", "left").select("conv_id", F.concat(opening, rest).alias("turns"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie of
    `sequences` (conv_id, turns)."""
    coded = sequences.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["mark"]), "")).alias("sequence"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"))
    coded = staged(coded, "turn-sequences")  # the range sort reads it twice
    nodes = staged(
        coded.repartitionByRange("sequence", "conv_id").sortWithinPartitions("sequence", "conv_id").mapInArrow(_nodes, NODES), "trie-nodes")
    values = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    open_rows = nodes.where("open")
    merged = staged(_merged(open_rows), "open-sums")

    parents = merged.select(F.col("prefix").alias("parent_prefix"), F.col("conv_id").alias("parent_conv_id"))
    wide = merged.join(parents, "parent_prefix", "left").select("conv_id", "depth", "parent_conv_id", *values)
    inner = nodes.where(~F.col("open"))
    settled = inner.where(~F.col("parent_open")).select("conv_id", "depth", "parent_conv_id", *values)
    # a block's nodes meet the final values of its own open nodes: the key spreads a wide parent over the blocks
    known = open_rows.select("block", F.col("node").alias("parent"), "prefix").join(
        merged.select("prefix", F.col("conv_id").alias("parent_conv_id")), "prefix").drop("prefix")
    waiting = inner.where("parent_open").drop("parent_conv_id").join(known, ["block", "parent"]).select(
        "conv_id", "depth", "parent_conv_id", *values)
    return wide.unionByName(settled).unionByName(waiting)
