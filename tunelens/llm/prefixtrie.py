"""Prefix tries of conversations from vertical bitmaps.

Conversations are dealt to shards of about ``SHARD`` each. A shard numbers its conversations and keeps, for every turn
seen at every position, the bitset of the conversations that have it there. A node is the bitset of its conversations:
children come from intersecting it with the postings of the next position, depth first, its popcount is its size, and its
bits among those that end at its depth are its end list.

Nodes of different shards with the same turns carry the same key, a digest of the turns so far, and are added up by it.
Each node of the whole trie is counted in the shard of its smallest member, which holds the whole way to it, so sums over
subtrees are taken inside shards and added up by key again. No conversation is compared with another one, and no node's
members are gathered, except as runs of ids that pass through a hash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelens.llm.tables import written

SHARD = 4096
#: A shard also ends at this many turns.
SHARD_TURNS = 200_000
#: Ids of one end list that are sorted and joined at a time: those that are equal without their last bits.
RUN_BITS = 16
#: Shards of one task are numbered from task << SHARD_BITS.
SHARD_BITS = 32
#: Conversations whose ids share their quotient by this are rebuilt from one of them.
FAMILY = 5
#: A conversation takes fewer turns than this from the first of its family.
BORROWED = 9

NODES = (
    "shard bigint, node int, parent int, key binary, parent_key binary, depth bigint, n bigint, least bigint, "
    "bytes bigint, ends array<bigint>")
SUMS = (
    "key binary, owner boolean, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint")

#: A turn: its digest and the UTF-8 bytes of its text.
Turn = tuple[bytes, int]


def borrowed_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % BORROWED


def turns_of(conversations: DataFrame) -> DataFrame:
    """(family, conv_id, turn, digest, bytes). Null role and text are empty; the digest is of both, told apart."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id IS NOT NULL").select(
        (F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("family"),
        "conv_id",
        "turn",
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )


def rebuilt(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Turn]]]:
    """(conv_id, turns) of every rebuilt conversation, from rows sorted by family, conv_id and turn.

    The first conversation of a family, whose turns the others borrow, has its smallest id.
    """
    family = conv = None
    own: list[Turn] = []
    first: list[Turn] = []

    def finish() -> tuple[int, list[Turn]]:
        nonlocal first
        if conv == family:
            first = own[: BORROWED - 1]
        h = borrowed_turns(conv)
        return conv, first[:h] + own[h:]

    for batch in rows:
        columns = [batch.column(c).to_pylist() for c in ("family", "conv_id", "digest", "bytes")]
        for f, c, digest, size in zip(*columns):
            if c != conv:
                if conv is not None:
                    yield finish()
                if f != family:
                    first = []
                family, conv, own = f, c, []
            own.append((digest, size))
    if conv is not None:
        yield finish()


class Trie:
    """The nodes of one shard in depth-first order: parents come before their children."""

    def __init__(self, convs: list[tuple[int, list[Turn]]]):
        convs = sorted(convs, key=lambda c: c[0])  # so the lowest bit of a bitset is its smallest member
        self.ids = [c for c, _ in convs]
        at: list[dict[Turn, int]] = []  # at[position][turn]: bitset
        ends: dict[int, int] = defaultdict(int)  # by length
        for i, (_, turns) in enumerate(convs):
            while len(at) < len(turns):
                at.append(defaultdict(int))
            for d, turn in enumerate(turns):
                at[d][turn] |= 1 << i
            ends[len(turns)] |= 1 << i
        self.parent: list[int] = []
        self.key: list[bytes] = []
        self.depth: list[int] = []
        self.n: list[int] = []
        self.least: list[int] = []
        self.bytes: list[int] = []
        self.ends: list[list[int]] = []
        stack = [(-1, b"", 0, (1 << len(convs)) - 1, 0)] if convs else []
        while stack:
            parent, key, depth, members, size = stack.pop()
            node = len(self.parent)
            ending = members & ends[depth]
            self.parent.append(parent)
            self.key.append(key)
            self.depth.append(depth)
            self.n.append(members.bit_count())
            self.least.append(self.ids[_lowest(members)])
            self.bytes.append(size)
            self.ends.append([self.ids[i] for i in _bits(ending)])
            left = members ^ ending
            while left:
                turn = convs[_lowest(left)][1][depth]
                child = left & at[depth][turn]
                left ^= child
                stack.append((node, hashlib.blake2b(key + turn[0], digest_size=16).digest(), depth + 1, child, turn[1]))

    def record(self, shard: int) -> pa.RecordBatch:
        n = len(self.parent)
        above = [None if p < 0 else self.key[p] for p in self.parent]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.list_(pa.int64())]
        values = [
            [shard] * n, range(n), self.parent, self.key, above, self.depth, self.n, self.least, self.bytes, self.ends]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(values, kinds)], [f.split()[0] for f in NODES.split(", ")])


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _bits(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _shard_nodes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << SHARD_BITS
    held: list[tuple[int, list[Turn]]] = []
    turns = 0
    for conv in rebuilt(rows):
        held.append(conv)
        turns += len(conv[1])
        if len(held) >= SHARD or turns >= SHARD_TURNS:
            yield Trie(held).record(number)
            number, held, turns = number + 1, [], 0
    if held:
        yield Trie(held).record(number)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and
    ``key``, the digest of the node's turns.

    ``conversations`` has conv_id, turn, role, text. Turns are ordered by ``turn``, null first; turns with equal numbers,
    repeated rows among them, are turns of their own and ordered by the SHA-256 of role and text. Rows without a conv_id
    belong to no conversation and are left out; for negative ids the quotient of the family rounds down. An empty table
    gives no rows; other columns are not read. Turns and keys are compared by digests of 256 and 128 bits.

    A task holds one shard and the turns of one conversation, as digests. Every table in between is written to the
    shared folder or comes from one shuffle by family, key or shard.
    """
    dealt = turns_of(conversations).repartition("family")
    ordered = dealt.sortWithinPartitions("family", "conv_id", F.asc_nulls_first("turn"), "digest")
    nodes = written(
        ordered.select("family", "conv_id", "digest", "bytes").mapInArrow(_shard_nodes, NODES), "trie-nodes")
    whole = nodes.groupBy("key").agg(
        F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.min("parent_key").alias("parent_key"))
    children = whole.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"))
    facts = whole.select("key", "n_convs", "conv_id").join(children, "key", "left").fillna(0, ["n_children"])
    known = nodes.drop("parent_key", "n", "ends").join(facts, "key")
    by_shard = known.repartition("shard").sortWithinPartitions("shard", "node")
    sums = by_shard.mapInArrow(_subtree_sums, SUMS)
    merged = sums.groupBy("key").agg(
        *[F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children")],
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"),
    )
    empty = hashlib.sha256(b"").hexdigest()
    return merged.join(end_hashes(nodes), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), "key")


def _subtree_sums(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves and saved bytes below every node of a shard, of the nodes that the shard owns. Rows are sorted by shard and
    node, so a node's parent has come before."""
    names = ["shard", "node", "parent", "key", "depth", "least", "bytes", "n_convs", "conv_id", "n_children"]
    for shard in _groups(rows, names, 0):
        leaves, saved = [0] * len(shard), [0] * len(shard)
        out: list[list] = [[] for _ in range(9)]
        for i in range(len(shard) - 1, -1, -1):
            _, _, parent, key, depth, least, size, n, conv, children = shard[i]
            owner = least == conv
            if owner:
                leaves[i] += not children
                saved[i] += (n - 1) * size
            if parent >= 0:
                leaves[parent] += leaves[i]
                saved[parent] += saved[i]
            above = shard[parent][8] if parent >= 0 else None
            facts = (conv, depth, above, n, children) if owner else (None,) * 5
            if owner or leaves[i] or saved[i]:
                for column, v in zip(out, (key, owner, *facts, leaves[i], saved[i])):
                    column.append(v)
        kinds = [pa.binary(), pa.bool_(), *[pa.int64()] * 7]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(out, kinds)], [f.split()[0] for f in SUMS.split(", ")])


def _groups(rows: Iterator[pa.RecordBatch], names: list[str], by: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal values in column ``by``."""
    held: list[tuple] = []
    for batch in rows:
        for row in zip(*[batch.column(n).to_pylist() for n in names]):
            if held and row[by] != held[0][by]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def end_hashes(nodes: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end.

    Ids are sorted and joined in runs of at most 2 ** ``RUN_BITS``, in parallel; a node's runs then pass through its hash one
    after the other and are never held together.
    """
    ends = nodes.select("key", F.explode("ends").alias("id"))
    runs = ends.groupBy("key", F.shiftright("id", RUN_BITS).alias("run")).agg(
        F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))
    ordered = runs.repartition("key").sortWithinPartitions("key", "run").select("key", "ids")
    return ordered.mapInArrow(_hash_runs, "key binary, ends_sha256 string")


def _hash_runs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key: bytes | None = None
    running: Callable | None = None
    for batch in rows:
        done: list[tuple[bytes, str]] = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key or running is None:
                if running is not None:
                    done.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield _hashes(done)
    if running is not None:
        yield _hashes([(key, running.hexdigest())])


def _hashes(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    keys, hashes = zip(*done) if done else ((), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])


#: The same nodes, without their keys, for DuckDB; crc32 is taken bit by bit.
ORACLE = """
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos, digest, bytes
    FROM (
        SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes,
            sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations WHERE conv_id IS NOT NULL)),
sizes AS (
    SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
        xor(list_reduce(
            list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
            lambda crc, byte: list_reduce(
                list_prepend(xor(crc, byte), [-1, -1, -1, -1, -1, -1, -1, -1]),
                lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h
    FROM turns GROUP BY conv_id),
rebuilt AS (
    SELECT c.conv_id, t.pos, t.digest, t.bytes FROM sizes c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + t.pos - c.h, t.digest, t.bytes
    FROM sizes c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN sizes b ON b.conv_id = c.base),
members AS (
    SELECT conv_id, 0 AS depth, '' AS key, 0 AS bytes FROM sizes
    UNION ALL
    SELECT conv_id, pos, sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY pos)), bytes FROM rebuilt),
nodes AS (
    SELECT key, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes
    FROM members GROUP BY key),
links AS (
    SELECT DISTINCT p.key AS parent, c.key FROM members c JOIN members p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1),
children AS (SELECT parent AS key, count(*) AS n_children FROM links GROUP BY parent),
below AS (
    SELECT DISTINCT a.key AS top, b.key FROM members a JOIN members b ON b.conv_id = a.conv_id AND b.depth >= a.depth),
sums AS (
    SELECT top AS key, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
    FROM below JOIN nodes USING (key) LEFT JOIN children USING (key) GROUP BY top),
ends AS (
    SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
    FROM members m JOIN (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id) USING (conv_id, depth)
    GROUP BY key)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
    coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
    sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN sums USING (key) LEFT JOIN children USING (key) LEFT JOIN ends USING (key)
LEFT JOIN links USING (key) LEFT JOIN nodes p ON p.key = links.parent
"""
