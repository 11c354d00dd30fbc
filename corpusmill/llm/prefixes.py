"""Conversation prefix trie: which beginnings conversations share, and what sharing them saves.

Conversations are paths of turn digests (128 bits each). Paths are dealt by ranges, sorted, into shards, so that a shard is a
part of the trie in preorder. A shard writes its part as balanced parentheses: blocks of the excess with their minima and
maxima, in a tree, give each node's closing parenthesis, and with it the node's subtree; leaves are pairs "()" counted by rank,
conversations and savings are differences of cumulative arrays. Only nodes on the spine that a shard shares with the one before
or after it are in several shards; their numbers are added up, each distinct node counted in the first shard that has it, and
a leaf in the last. Texts are read once, for their digests and word counts, and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.shared import partitions, saved

#: Conversations of as many consecutive ids take their first turns from the first of them, fewer than HEAD.
FAMILY, HEAD = 20, 4
BLOCK = 64
_DIGEST = 16
_EMPTY = hashlib.sha256(b"").hexdigest()
NODES = "shard int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary, ends string"


class Parentheses:
    """Balanced parentheses (1 opens) with findclose by a tree of minima and maxima of the excess over blocks."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK):
        self.block, self.bits = block, bits
        self.excess = np.cumsum(np.where(bits == 1, 1, -1))
        padded = np.concatenate([self.excess, np.full(-len(bits) % block, self.excess[-1] if len(bits) else 0)]).reshape(-1, block)
        low, high = padded.min(axis=1), padded.max(axis=1)
        lows, highs = [low], [high]
        while len(lows[-1]) > 1:
            if len(lows[-1]) % 2:  # an odd level gets a cell that holds no value
                lows[-1], highs[-1] = np.append(lows[-1], np.iinfo(np.int64).max), np.append(highs[-1], np.iinfo(np.int64).min)
            lows.append(np.minimum(lows[-1][::2], lows[-1][1::2]))
            highs.append(np.maximum(highs[-1][::2], highs[-1][1::2]))
        self.first = np.cumsum([0, *map(len, lows)])
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)

    def _holds(self, level: np.ndarray, cell: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The excess changes by one at each place: a range has every value between its minimum and maximum."""
        at = self.first[level] + cell
        return (self.low[at] <= value) & (value <= self.high[at])

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """For each opening place the place that closes it: the next with an excess of one less."""
        value, out = self.excess[at] - 1, np.full(len(at), -1, dtype=np.int64)
        todo = np.arange(len(at))
        for step in range(1, self.block):  # inside the own block
            todo = todo[(at[todo] + step) // self.block == at[todo] // self.block]
            todo = todo[at[todo] + step < len(self.bits)]
            if not len(todo):
                break
            met = self.excess[at[todo] + step] == value[todo]
            out[todo[met]] = at[todo[met]] + step
            todo = todo[~met]
        todo = np.flatnonzero(out < 0)
        if not len(todo):
            return out
        want, cell, level = value[todo], at[todo] // self.block + 1, np.zeros(len(todo), dtype=np.int64)
        while not (met := self._holds(level, cell, want)).all():  # up and to the right, to a range that has the value
            up = ~met & (cell % 2 == 1)
            cell[~met] += 1
            cell[up] //= 2
            level[up] += 1
        while (level > 0).any():  # down to its first block
            down = level > 0
            level[down] -= 1
            cell[down] *= 2
            right = down.copy()
            right[down] = ~self._holds(level[down], cell[down], want[down])
            cell[right] += 1
        for a in range(0, len(todo), 10_000):
            b = slice(a, a + 10_000)
            places = np.minimum(cell[b, None] * self.block + np.arange(self.block), len(self.bits) - 1)
            out[todo[b]] = places[np.arange(len(places)), (self.excess[places] == want[b, None]).argmax(axis=1)]
        return out


def range_minimum(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of values[first:end] for each pair of bounds, by minima over powers of two."""
    out, size, table, power = np.empty(len(first), dtype=values.dtype), end - first, values, 1
    while True:
        now = (size >= power) & (size < 2 * power)
        out[now] = np.minimum(table[first[now]], table[end[now] - power])
        if 2 * power > len(values):
            return out
        table, power = np.minimum(table[:-power], table[power:]), 2 * power


def common(a: bytes, b: bytes) -> int:
    """How many digests two paths begin with alike."""
    low, high = 0, min(len(a), len(b)) // _DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * _DIGEST] == b[: mid * _DIGEST] else (low, mid - 1)
    return low


def _shard(number: int, paths: list[bytes], convs: np.ndarray, words: list[np.ndarray], before: bytes | None, after: bytes | None) -> pa.RecordBatch:
    """The nodes of a shard's sorted paths; before and after are the neighbours' nearest paths."""
    stack, parent, runs = [0], [-1], [0, 1]
    of_words, ends, least, ids = [np.zeros(1, np.int64)], {}, {}, {}
    previous, a = b"", 0
    while a < len(paths):
        path, b = paths[a], a + 1
        while b < len(paths) and paths[b] == path:
            b += 1
        alike, depth = common(previous, path), len(path) // _DIGEST
        runs += [len(stack) - 1 - alike, depth - alike]
        del stack[alike + 1 :]
        new = range(len(parent), len(parent) + depth - alike)
        parent += [stack[alike], *new[:-1]] if new else []
        stack += new
        of_words.append(words[a][alike:].astype(np.int64))
        ends[stack[-1]], least[stack[-1]], ids[stack[-1]] = b - a, convs[a], ",".join(map(str, convs[a:b].tolist()))
        previous, a = path, b
    runs.append(len(stack))
    bits = np.repeat(np.arange(len(runs)) % 2, runs).astype(np.int8)
    bp, n = Parentheses(bits), len(parent)
    opens = np.flatnonzero(bits)
    close = bp.findclose(opens)
    end = np.arange(n) + (close - opens + 1) // 2
    own, lowest = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    own[list(ends)], lowest[list(ends)] = list(ends.values()), list(least.values())

    up, size = np.array(parent), np.concatenate(of_words)
    earlier, later = np.zeros(n, bool), np.zeros(n, bool)
    if before is not None:
        earlier[: common(before, paths[0]) + 1] = True  # the first path's nodes come first
    if after is not None:
        later[stack[: common(previous, after) + 1]] = True
    depth = bp.excess[opens] - 1

    def between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[high] - total[low]

    at = np.arange(n)
    n_convs = between(own, at, end)
    pairs = np.zeros(len(bits), np.int64)
    pairs[opens] = (bits[opens + 1] == 0) & ~later
    saving = between(n_convs * size, at, end) - between(size * ~earlier, at, end)
    conv = range_minimum(lowest, at, end)
    children = np.bincount(up[1:][~earlier[1:]], minlength=n)
    shared = earlier | later
    keys: list[bytes | None] = [None] * n
    for path, alike, nodes in ((paths[0], common(before, paths[0]) if before is not None else -1, range(n)), (previous, common(previous, after) if after is not None else -1, stack)):
        digest = hashlib.md5(usedforsecurity=False)
        for d in range(alike + 1):
            digest.update(path[(d - 1) * _DIGEST : d * _DIGEST] if d else b"")
            keys[nodes[d]] = digest.digest()
    text = [ids.get(i, "") for i in range(n)]
    columns = (
        pa.array(np.full(n, number, np.int32)), pa.array(depth), pa.array(conv), pa.array(np.where(up >= 0, conv[up], 0), mask=up < 0), pa.array(n_convs), pa.array(children.astype(np.int64)),
        pa.array(between(pairs, opens, close)), pa.array(saving), pa.array([None if s else hashlib.sha256(x.encode()).hexdigest() if x else _EMPTY for x, s in zip(text, shared, strict=True)], pa.string()),
        pa.array(keys, pa.binary()), pa.array([keys[i] if i >= 0 else None for i in parent], pa.binary()), pa.array([x if s and x else None for x, s in zip(text, shared, strict=True)], pa.string()),
    )
    return pa.RecordBatch.from_arrays(list(columns), names=[c.split()[0] for c in NODES.split(", ")])


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, the neighbours' paths first, then by path and conv_id; one shard is held at a time."""
    number, paths, convs, words, near = None, [], [], [], (None, None)

    def out():
        nodes = _shard(number, paths, np.array(convs, dtype=np.int64), words, *near)
        for a in range(0, nodes.num_rows, 20_000):
            yield nodes.slice(a, 20_000)

    for batch in batches:
        lists = batch.column(4)
        values, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for k, (shard, kind, path, conv) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True)):
            if kind == 0:
                if paths:
                    yield from out()
                number, paths, convs, words = shard, [], [], []
                near = (batch.column(5)[k].as_py(), batch.column(6)[k].as_py())
            else:
                paths.append(path)
                convs.append(conv)
                words.append(values[bounds[k] : bounds[k + 1]])
    if paths:
        yield from out()


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, ends) sorted by key and shard: the digest of each key's ends, comma-joined, taken as they stream by."""
    key, digest, done = None, None, []

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["key", "ends_sha256"])
        done.clear()
        return batch

    for batch in batches:
        for k, ids in zip(batch.column(0), batch.column(1), strict=True):
            k, ids = k.as_py(), ids.as_py().encode()
            if k != key:
                if digest:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids)
            else:
                digest.update(b"," + ids)
        yield out()
    if digest:
        done.append((key, digest.hexdigest()))
    yield out()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with the ordered turns of each conversation as (digest in hex, words)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select("conv_id", F.struct(F.col("turn").isNotNull().alias("known"), "turn", digest.alias("digest"), F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).alias("words")).alias("x"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """(conv_id, path, words): each conversation c begins with the first h turns of conversation c - c % family, h = crc32(c) % head,
    and goes on with its own turns after its first h."""
    own = saved(turns(conversations), "turns")
    first = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, head - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % head).cast("int")
    both = own.withColumn("base", F.expr(f"conv_id - conv_id % {family}")).join(first, "base", "left").withColumn("h", h)
    begin = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    every = both.select("conv_id", F.concat(begin, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))
    return every.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.words").alias("words"))


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, path, words), path being 16 bytes a turn: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = sequences.sparkSession
    n = partitions(spark)
    dealt = sequences.select("path", F.col("conv_id").cast("long").alias("conv_id"), "words").repartitionByRange(n, "path", "conv_id")
    dealt = saved(dealt.withColumn("shard", F.spark_partition_id()), "trie-shards")
    in_order = W.orderBy("shard")  # a row a shard
    edges = dealt.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    edges = edges.select("shard", F.lag("last").over(in_order).alias("before"), F.lead("first").over(in_order).alias("after"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = dealt.select("shard", F.lit(1).alias("kind"), "path", "conv_id", "words", none("binary").alias("before"), none("binary").alias("after"))
    rows = rows.union(edges.select("shard", F.lit(0), none("binary"), none("long"), none("array<int>"), "before", "after"))
    nodes = saved(rows.repartitionByRange(n, "shard").sortWithinPartitions("shard", "kind", "path", "conv_id").mapInArrow(_tries, NODES), "trie-nodes")

    spine = nodes.where("key is not null")
    ends = spine.where("ends is not null").select("key", "ends", "shard").repartition("key").sortWithinPartitions("key", "shard").select("key", "ends").mapInArrow(_joined_ends, "key binary, ends_sha256 string")
    counts = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    merged = spine.groupBy("key").agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.min("parent_key").alias("parent_key"), *[F.sum(c).alias(c) for c in counts])
    merged = saved(merged.join(ends, "key", "left"), "trie-spine")
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    result = ["conv_id", "depth", "parent_conv_id", *counts, "ends_sha256"]
    top = merged.join(above, "parent_key", "left").select("conv_id", "depth", F.col("above").alias("parent_conv_id"), *counts, F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    inner = nodes.where("key is null")
    # By shard, so that the children of a common beginning are not one key.
    near = spine.select("shard", F.col("key").alias("parent_key")).join(above, "parent_key")
    below = inner.where("parent_key is not null").drop("parent_conv_id").join(near, ["shard", "parent_key"]).withColumnRenamed("above", "parent_conv_id")
    return inner.where("parent_key is null").select(*result).union(below.select(*result)).union(top.select(*result))


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations: a row for each distinct beginning, the empty one included.

    Turns are ordered by turn, null first, equal ones by the digest of role and text; null role and text are empty. Rows of a
    null conv_id belong to no conversation and are left out. A conversation's digests (16 bytes a turn) are held in one
    row. Repeated rows are turns of their own; other columns are ignored; an empty table gives an empty result.
    """
    return trie(rebuilt(conversations))


ORACLE = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, md5(length(role) || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS k FROM t),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, k, digest, words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND k <= h
  UNION ALL SELECT c.conv_id, 1, k, digest, words FROM c JOIN o USING (conv_id) WHERE k > h),
q AS (SELECT conv_id, words, row_number() OVER w AS depth, md5(string_agg(digest, ',') OVER w) AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, k)),
m AS (SELECT conv_id, depth, words, key, lag(key, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM q UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
l AS (SELECT conv_id, max(depth) AS last FROM m GROUP BY ALL),
n AS (SELECT key, depth, any_value(parent) AS parent, any_value(words) AS words, min(m.conv_id) AS conv_id, count(*) AS n_convs,
  coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (depth = last), '') AS ends FROM m JOIN l USING (conv_id) GROUP BY key, depth),
ch AS (SELECT parent AS key, count(*) AS n_children FROM n GROUP BY ALL),
s AS (SELECT m.key, sum(CASE WHEN ch.key IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM n JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth LEFT JOIN ch ON ch.key = n.key GROUP BY m.key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
sha256(n.ends) AS ends_sha256 FROM n JOIN s ON s.key = n.key LEFT JOIN ch ON ch.key = n.key LEFT JOIN n p ON p.key = n.parent"""
