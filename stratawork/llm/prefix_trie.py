"""Prefix tries of conversations in balanced parentheses, one for each shard.

Conversations are ordered by their turns and dealt to shards by range, so a shard holds a connected piece of the trie. It
writes that piece as parentheses; blocks of their excess and its minima find the closing one of each node, which delimits
its subtree; ranks of leaf pairs and cumulative arrays give what is in it. Only the nodes on a shard's first and last path
(its spines) can lie in other shards too; their figures are merged by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratawork.llm.text import mixed, stored

#: Turns that a shard holds on average; it takes about 200 bytes for each.
SHARD_TURNS = 200_000
#: Parentheses in a block of the excess table.
BLOCK = 64
#: Ids in one piece of a list that runs over several shards.
PIECE_IDS = 4096
#: Spine nodes are broadcast up to this number of rows (40 bytes each); else they are shuffled.
BROADCAST_ROWS = 500_000

_NODE = "shard int, kind int, depth long, a long, b long, pa long, pb long, conv_id long, parent_conv_id long, n_convs long, \
n_children long, n_leaves long, conv_bytes long, node_bytes long, before long, on_first boolean, on_last boolean, \
ends string, piece int, first_path array<long>, last_path array<long>, first_bytes array<long>"
_NAMES = [part.split()[0] for part in _NODE.split(", ")]
#: Kinds of rows: a finished node, a node on a spine, the shard's first and last path, a piece of the ids ending in a spine node.
_DONE, _SPINE, _BORDER, _ENDS = range(4)


def find_close(bits: np.ndarray) -> np.ndarray:
    """Place of the closing parenthesis of each opening one (1 opens, 0 closes), in the order of the opening ones.

    The excess falls below its value before the opening one first at the closing one. It is looked for in the opening
    one's block, then among the minima of the next blocks over a binary tree of them, then in the block found.
    """
    excess = np.cumsum(np.where(bits == 1, 1, -1))
    opening = np.flatnonzero(bits == 1)
    target = excess[opening] - 1
    blocks = -(-len(bits) // BLOCK)
    padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
    padded[: len(bits)] = excess
    table = padded.reshape(blocks, BLOCK)
    levels = [table.min(axis=1)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        if len(last) % 2:
            last = np.append(last, np.iinfo(np.int64).max)
        levels.append(last.reshape(-1, 2).min(axis=1))
    close = np.full(len(opening), -1, np.int64)

    def scan(which: np.ndarray, block: np.ndarray, after: np.ndarray) -> None:
        """First place in `block` behind `after` (within it) with an excess of the target or less."""
        for part in range(0, len(which), 8192):
            w, k = which[part : part + 8192], block[part : part + 8192]
            low = (table[k] <= target[w][:, None]) & (np.arange(BLOCK) > after[part : part + 8192, None])
            hit = low.any(axis=1)
            close[w[hit]] = k[hit] * BLOCK + low[hit].argmax(axis=1)

    scan(np.arange(len(opening)), opening // BLOCK, opening % BLOCK)
    left = np.flatnonzero(close < 0)
    at, level = opening[left] // BLOCK, np.zeros(len(left), np.int64)
    found = np.zeros(len(left), bool)
    for height in range(len(levels)):  # up: the next sibling to the right that holds a value low enough
        minima = levels[height]
        here = ~found
        sibling = at + 1
        can = here & (at % 2 == 0) & (sibling < len(minima))
        can[can] = minima[sibling[can]] <= target[left[can]]
        at = np.where(can, sibling, at)
        level = np.where(can, height, level)
        found |= can
        at = np.where(found, at, at // 2)
    for height in range(len(levels) - 1, 0, -1):  # down: the left child if it holds one, else the right
        own = level == height
        child = at * 2
        minima = levels[height - 1]
        first = own.copy()
        first[own] = minima[child[own]] <= target[left[own]]
        at = np.where(own, np.where(first, child, child + 1), at)
        level = np.where(own, height - 1, level)
    scan(left, at, np.full(len(left), -1))
    return close


def _least_of_ranges(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest of values[low:high] for each pair; every range holds one value at least."""
    table = [values]
    while 2 ** len(table) <= len(values):
        half = 2 ** (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    level = np.log2(high - low).astype(np.int64)
    out = np.empty(len(low), np.int64)
    for k in np.unique(level).tolist():
        own = level == k
        out[own] = np.minimum(table[k][low[own]], table[k][high[own] - 2**k])
    return out


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return np.diff(column.offsets.to_numpy()).astype(np.int64), column.flatten().to_numpy()


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class _Piece:
    """The trie of conversations in the order of their paths: for each node, in preorder from the root, its figures."""

    def __init__(self, convs: np.ndarray, turns: np.ndarray, first: np.ndarray, second: np.ndarray, size: np.ndarray):
        rows = np.repeat(np.arange(len(convs)), turns)
        start = _starts(turns)
        place = np.arange(start[-1]) - start[rows]  # of a turn within its conversation
        shared = np.zeros(len(convs), np.int64)  # turns in common with the conversation before
        shared[1:] = np.minimum(turns[1:], turns[:-1])
        there = np.flatnonzero((rows > 0) & (place < shared[rows]))
        before = start[rows[there] - 1] + place[there]
        other = there[(first[there] != first[before]) | (second[there] != second[before])]
        np.minimum.at(shared, rows[other], place[other])
        new = place >= shared[rows]
        at = np.flatnonzero(new)  # the turn that opens each node but the root
        opened = turns - shared
        closed = np.append(turns[:-1] - shared[1:], turns[-1] + 1)
        opened[0] += 1
        counts = np.stack([opened, closed], axis=1).ravel()
        self.bits = np.repeat(np.tile(np.array([1, 0], np.int8), len(convs)), counts)

        opening = np.flatnonzero(self.bits == 1)
        close = find_close(self.bits)
        nodes = len(opening)
        subtree = (close - opening + 1) // 2
        self.depth = np.append(0, place[at] + 1)
        pairs = np.cumsum((self.bits[:-1] == 1) & (self.bits[1:] == 0))
        pairs = np.append(0, np.append(pairs, pairs[-1]))
        self.leaves = pairs[close + 1] - pairs[opening]
        key = self.depth * nodes + np.arange(nodes)
        order = np.argsort(key)
        self.parent = np.full(nodes, -1, np.int64)
        below = np.arange(1, nodes)
        self.parent[1:] = order[np.searchsorted(key[order], (self.depth[below] - 1) * nodes + below) - 1]
        self.children = np.bincount(self.parent[1:], minlength=nodes)

        own = np.append(0, size[at])
        bytes_before = _starts(own)
        self.node_bytes = bytes_before[np.arange(nodes) + subtree] - bytes_before[:-1]
        path_bytes = _starts(size)
        self.path_bytes = path_bytes  # of all turns up to a place, over all conversations
        self.before = np.append(0, path_bytes[at] - path_bytes[start[rows[at]]])
        #: The node that each conversation ends in.
        last_new = np.cumsum(np.bincount(rows[at], minlength=len(convs)))
        self.ends = np.where(turns > shared, last_new, 0)
        same = np.flatnonzero((turns == shared) & (np.arange(len(convs)) > 0))  # ends where the one before has passed or ended
        if len(same):
            fresh = np.maximum.accumulate(np.where((turns > shared) | (np.arange(len(convs)) == 0), np.arange(len(convs)), 0))
            self.ends[same] = self.ends[fresh[same]]
        low = np.searchsorted(self.ends, np.arange(nodes))
        high = np.searchsorted(self.ends, np.arange(nodes) + subtree)
        self.low, self.convs = low, high - low
        self.conv_id = _least_of_ranges(convs, low, high)
        totals = _starts(path_bytes[start[1:]] - path_bytes[start[:-1]])
        self.conv_bytes = totals[high] - totals[low]
        self.ended = np.bincount(self.ends, minlength=nodes)
        #: Fingerprints of the paths: turns' hashes, spread by their place, put together by exclusive or.
        self.key = [np.append(0, _prefixes(h, place, start[rows])[at]) for h in (first, second)]

        self.on_first = np.zeros(nodes, bool)
        self.on_first[: turns[0] + 1] = True
        self.on_last = np.zeros(nodes, bool)
        node = int(self.ends[-1])
        while node >= 0:
            self.on_last[node] = True
            node = int(self.parent[node])


def _prefixes(hashes: np.ndarray, place: np.ndarray, start: np.ndarray) -> np.ndarray:
    spread = mixed(hashes.view(np.uint64) + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.append(np.uint64(0), np.bitwise_xor.accumulate(spread)) if len(spread) else np.zeros(1, np.uint64)
    return (sums[1:] ^ sums[start]).view(np.int64)


def _sha(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def _rows(kind: int, shard: int, n: int, **columns) -> pa.RecordBatch:
    schema = {
        "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()),
    }
    kinds = [schema[part.split()[1]] for part in _NODE.split(", ")]
    given = {"shard": np.full(n, shard, np.int32), "kind": np.full(n, kind, np.int32), **columns}
    arrays = [pa.array(given[x], t) if x in given else pa.nulls(n, t) for x, t in zip(_NAMES, kinds)]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a whole shard: conv_id, path (two hashes for each turn), sizes; in the order of path and conv_id."""
    parts = [batch for batch in batches if batch.num_rows]
    if not parts:
        return
    shard = TaskContext.get().partitionId()
    convs = np.concatenate([p.column("conv_id").to_numpy() for p in parts])
    turns, size = (np.concatenate(x) for x in zip(*[_lists(p.column("sizes")) for p in parts]))
    hashes = np.concatenate([_lists(p.column("path"))[1] for p in parts])
    size = size.astype(np.int64)
    trie = _Piece(convs, turns, hashes[0::2].copy(), hashes[1::2].copy(), size)
    del parts
    spine = trie.on_first | trie.on_last
    up = np.maximum(trie.parent, 0)

    def figures(own: np.ndarray) -> dict:
        return {
            "depth": trie.depth[own], "a": trie.key[0][own], "b": trie.key[1][own], "pa": trie.key[0][up[own]],
            "pb": trie.key[1][up[own]], "conv_id": trie.conv_id[own], "n_convs": trie.convs[own],
            "n_children": trie.children[own], "n_leaves": trie.leaves[own], "conv_bytes": trie.conv_bytes[own],
            "node_bytes": trie.node_bytes[own], "before": trie.before[own], "on_first": trie.on_first[own],
            "on_last": trie.on_last[own],
        }

    inner, nothing = np.flatnonzero(~spine), _sha(np.empty(0, np.int64))
    for a in range(0, len(inner), 10_000):
        own = inner[a : a + 10_000]
        ends = [
            _sha(convs[x : x + n]) if n else nothing for x, n in zip(trie.low[own].tolist(), trie.ended[own].tolist())
        ]  # those that end in a node come first among its members
        hidden = spine[up[own]]
        yield _rows(
            _DONE, shard, len(own), **figures(own), ends=ends,
            parent_conv_id=pa.array(trie.conv_id[up[own]], mask=hidden),
        )
    own = np.flatnonzero(spine)
    yield _rows(_SPINE, shard, len(own), **figures(own))
    first, last = turns[0], turns[-1]
    yield _rows(
        _BORDER, shard, 1, first_path=[hashes[: 2 * first]], last_path=[hashes[len(hashes) - 2 * last :]],
        first_bytes=[trie.path_bytes[: first + 1]],
    )
    for node in own[trie.ended[own] > 0].tolist():
        ids = convs[trie.low[node] : trie.low[node] + trie.ended[node]]
        for piece, a in enumerate(range(0, len(ids), PIECE_IDS)):
            yield _rows(
                _ENDS, shard, 1, depth=[trie.depth[node]], a=[trie.key[0][node]], b=[trie.key[1][node]], piece=[piece],
                ends=[",".join(map(str, ids[a : a + PIECE_IDS].tolist()))],
            )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come one after another: depth, a, b, ends."""
    node, state, out = None, None, []
    for batch in batches:
        for depth, a, b, text in zip(*[batch.column(n).to_pylist() for n in ("depth", "a", "b", "ends")]):
            if (depth, a, b) != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, a, b), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["depth", "a", "b", "ends"])
            out = []
    if node is not None:
        out.append((*node, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["depth", "a", "b", "ends"])


def rebuilt(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Each conversation with the first turns of the one that begins its group: conv_id, path, sizes.

    Conversation c takes the first crc32(c as text) % `most` turns of conversation c - c % `group` (all if that has fewer,
    none if it is not there) and its own turns behind as many. path holds two hashes of role and text for each turn, sizes
    the bytes of its text. Turns are ordered by number (null first), equal numbers by role and text; null role or text is
    empty. Rows without conv_id belong to no conversation. A conversation is one row; its turns are held by one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        F.struct(
            "turn", role.alias("role"), text.alias("text"), F.xxhash64(role, text).alias("a"),
            F.xxhash64(F.lit(41), role, text).alias("b"), F.octet_length(text).alias("size"),
        ).alias("at"),
    )
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("at")).select(
        "conv_id", F.flatten(F.transform("at", lambda x: F.array(x["a"], x["b"]))).alias("path"),
        F.transform("at", lambda x: x["size"]).alias("sizes"),
    )
    own = stored(own, "conversations")
    heads = own.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("head"), F.slice("path", 1, 2 * (most - 1)).alias("head_path"),
        F.slice("sizes", 1, most - 1).alias("head_sizes"),
    )
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")

    def spliced(head: str, column: str, width: int) -> Column:
        rest = F.slice(column, taken * width + 1, F.greatest(F.size(column) - taken * width, F.lit(0)))
        return F.concat(F.slice(F.coalesce(head, F.array().cast("array<long>" if width == 2 else "array<int>")), 1, taken * width), rest)

    both = own.join(heads, F.col("conv_id") - F.col("conv_id") % group == F.col("head"), "left")
    return both.select(
        "conv_id", spliced("head_path", "path", 2).alias("path"), spliced("head_sizes", "sizes", 1).alias("sizes")
    )


def _shared(left: str, right: str) -> Column:
    """Turns that two paths have in common from the start; null paths have none."""
    differs = F.expr(f"array_position(zip_with({left}, {right}, (x, y) -> x <=> y), false)")
    return F.coalesce(F.floor(F.when(differs > 0, differs - 1).otherwise(F.size(left)) / 2), F.lit(0)).cast("long")


def trie_nodes(paths: DataFrame) -> DataFrame:
    """Every node of the conversations' prefix trie.

    `paths` holds conv_id (each once), path and sizes as `rebuilt` gives them. Columns: conv_id (the smallest member),
    depth, parent_conv_id (null for the root), n_convs (members: those that start with the node's turns), n_children,
    n_leaves (nodes without children in its subtree, itself included), saved_tokens (over its subtree, members beyond the
    first times the bytes of the node's last text), ends_sha256 (of the members that end here, their ids in order, joined
    by commas). A conversation without turns is a member of the root. Without conversations there are no nodes.
    """
    spark = paths.sparkSession
    paths = stored(paths.select("conv_id", "path", "sizes"), "paths")
    turns = paths.agg(F.sum(F.size("sizes"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    ordered = paths.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    pieces = stored(ordered.mapInArrow(_shard, _NODE), "pieces")

    order = Window.orderBy("shard")  # one row for each shard
    borders = stored(
        pieces.filter(F.col("kind") == _BORDER).withColumns({
            "before_path": F.lag("last_path").over(order), "next_path": F.lead("first_path").over(order),
        }).select(
            "shard", "first_bytes", (F.size("last_path") / 2).cast("long").alias("last_turns"),
            F.when(F.col("before_path").isNull(), -1).otherwise(_shared("first_path", "before_path")).alias("reopened"),
            F.when(F.col("next_path").isNull(), -1).otherwise(_shared("last_path", "next_path")).alias("goes_on"),
        ),
        "borders",
    )
    # Nodes on the first path down to `reopened` were open in the shard before: their bytes count there, and they are not
    # new children. The leaf that ends the last path counts in the last shard that holds it.
    again = F.col("on_first") & (F.col("depth") <= F.col("reopened"))
    spines = pieces.filter(F.col("kind") == _SPINE).drop("first_bytes").join(F.broadcast(borders), "shard").select(
        "shard", "depth", "a", "b", "pa", "pb", "conv_id", "n_convs", "conv_bytes", "before",
        (F.col("n_children") - F.when(F.col("on_first") & (F.col("depth") < F.col("reopened")), 1).otherwise(0)).alias("n_children"),
        (F.col("n_leaves") - F.when(F.col("on_last") & (F.col("goes_on") >= F.col("last_turns")), 1).otherwise(0)).alias("n_leaves"),
        (F.col("node_bytes") - F.when(again, F.expr("element_at(first_bytes, cast(reopened as int) + 1)") - F.col("before")).otherwise(0))
        .alias("node_bytes"),
    )
    node = ["depth", "a", "b"]
    merged = stored(
        spines.groupBy(*node).agg(
            F.min("conv_id").alias("conv_id"), F.first("pa").alias("pa"), F.first("pb").alias("pb"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "conv_bytes", "node_bytes")],
            F.first("before").alias("before"),
        ),
        "spines",
    )
    small = F.broadcast if merged.count() <= BROADCAST_ROWS else (lambda df: df)
    above = merged.select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("above_conv_id")
    )
    texts = pieces.filter(F.col("kind") == _ENDS).select(*node, "shard", "piece", "ends")
    digests = texts.repartition(*node).sortWithinPartitions(*node, "shard", "piece").mapInArrow(
        _digests, "depth long, a long, b long, ends string"
    )
    none = F.lit(hashlib.sha256(b"").hexdigest())
    on_spine = merged.join(above, ["depth", "pa", "pb"], "left").join(digests, node, "left").withColumns(
        {"parent_conv_id": F.col("above_conv_id"), "ends": F.coalesce("ends", none)}
    )
    # A shard's own copy of its spine: the children of a node that very many conversations share stay with their shards.
    local = spines.select("shard", *node).join(small(merged.select(*node, F.col("conv_id").alias("above_conv_id"))), node).select(
        "shard", (F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), "above_conv_id"
    )
    done = pieces.filter(F.col("kind") == _DONE)
    hanging = done.filter("parent_conv_id is null").join(small(local), ["shard", "depth", "pa", "pb"]).withColumn(
        "parent_conv_id", F.col("above_conv_id")
    )
    columns = [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("conv_bytes") - F.col("n_convs") * F.col("before") - F.col("node_bytes")).alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    ]
    return (
        done.filter("parent_conv_id is not null").select(*columns)
        .unionByName(hanging.select(*columns)).unionByName(on_spine.select(*columns))
    )
