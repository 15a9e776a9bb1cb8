"""The prefix trie of conversations, by an LCP-aware mergesort.

A conversation is a string of turns, each of 24 bytes: 16 of its digest and 8 of its text's length.  Conversations are
dealt out by ranges of (string, conv_id), so copies of one conversation may lie in several ranges.  A task sorts what
comes in as runs, each with the number of turns that a string shares with the one before (its LCP), and merges the runs
by a loser tree: of two strings the one that shares more with the last winner is less, so turns that are known to be
shared aren't compared again.  The merged stream opens and closes nodes on a stack, the path of the current string; a
closed node is whole and goes out.

Only nodes on the paths of a range's first and last string may go on in other ranges.  They go out as parts; one task
takes all ranges' parts in order, a few for each range, and closes them on a stack of the same kind.

Plan: turns become 24 bytes where they are read (texts are never shuffled); one shuffle by conversation makes strings,
which are written; one shuffle by range; the parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, functions as F

from .conversation_repair import CRC_STEPS, crc32_sql
from .shared import partitions, small_batches, staged, table

#: Bytes of a turn in a string, and of them its text's length.
TURN = 24
#: Bytes of strings in a range, about; a task holds a range.
RANGE_BYTES = 1 << 23
#: Turns of another conversation that a rebuilt one may start with, at most.
HEAD = 8


def shared_turns(a: bytes, b: bytes, at: int = 0) -> int:
    """Turns that two strings share from their start; the first `at` are known to be."""
    k = at * TURN
    while k < len(a) and a[k : k + TURN] == b[k : k + TURN]:
        k += TURN
    return k // TURN


class Run:
    """A sorted run of (string, conv_id), with LCPs."""

    def __init__(self, rows: list[tuple[bytes, int]]) -> None:
        self.rows = sorted(rows)
        self.lcps = [0] + [shared_turns(a[0], b[0]) for a, b in zip(self.rows, self.rows[1:])]


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, int]]:
    """(string, conv_id, LCP with the one before) of all runs in order, by a loser tree."""
    size = 1
    while size < len(runs):
        size *= 2
    now: list = [r.rows[0] if r.rows else None for r in runs] + [None] * (size - len(runs))
    lcp, at = [0] * size, [0] * size

    def beats(i: int, j: int) -> bool:
        """Whether i comes before j; the loser's LCP becomes that with the winner."""
        if now[i] is None or now[j] is None:
            return now[j] is None
        if lcp[i] != lcp[j]:
            return lcp[i] > lcp[j]
        (a, x), (b, y) = now[i], now[j]
        h = shared_turns(a, b, lcp[i])
        k = h * TURN
        p, q = a[k : k + TURN], b[k : k + TURN]
        first = p < q or (p == q and (x, i) < (y, j))
        lcp[j if first else i] = h
        return first

    losers = [0] * size

    def played(node: int) -> int:
        if node >= size:
            return node - size
        i, j = played(2 * node), played(2 * node + 1)
        i, j = (i, j) if beats(i, j) else (j, i)
        losers[node] = j
        return i

    winner = played(1)
    while now[winner] is not None:
        yield *now[winner], lcp[winner]
        at[winner] += 1
        run = runs[winner]
        if at[winner] < len(run.rows):
            now[winner], lcp[winner] = run.rows[at[winner]], run.lcps[at[winner]]
        else:
            now[winner] = None
        node = (winner + size) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


class Node:
    """An open node: what is known of it and of its closed children."""

    __slots__ = ("children", "depth", "ends", "first", "leaves", "least", "length", "n", "refs", "saved", "key")

    def __init__(self, depth: int, length: int, first: bool = False) -> None:
        self.depth, self.length, self.first = depth, length, first
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: list[int] = []

    def close(self) -> None:
        self.saved += (self.n - 1) * self.length
        self.leaves = self.leaves if self.children else 1

    def take(self, child: Node) -> None:
        self.children += 1
        self.add(child)

    def add(self, part: Node) -> None:
        """What a closed child, or another part of the same node, brings."""
        self.n += part.n
        self.leaves += part.leaves
        self.saved += part.saved
        if part.least is not None:
            self.least = part.least if self.least is None else min(self.least, part.least)


def _id_text(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
#: Rows of a range: nodes that are whole (with their parent, or the part that it has in this range) and parts.
_PARTS = "part int, seq int, parent_seq int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, length long, turn_down boolean, ends binary"


def _batches(rows: Iterator[tuple], names: list[str], types: list, most: int = 4096, size: int = 1 << 22) -> Iterator:
    import pyarrow as pa

    out, held = [], 0
    for r in rows:
        out.append(r)
        held += len(r[-1] or b"") if isinstance(r[-1], bytes) else 0
        if len(out) >= most or held > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def range_rows(rows: Iterator[tuple[bytes, int, int]], part: int) -> Iterator[tuple]:
    """Rows of _PARTS of one range's merged stream."""
    import hashlib

    stack = [Node(0, 0, True)]
    done: list[Node] = []  # children before parents
    first = last = b""
    fresh = True
    shared = 0  # depth up to which the last path is the first one's

    def left(depth: int) -> None:
        """Close nodes deeper than depth; those of the first path stay parts."""
        while len(stack) > depth + 1:
            node = stack.pop()
            done.append(node)
            if not node.first:
                node.close()
                stack[-1].take(node)

    for turns, conv, lcp in rows:
        left(lcp if not fresh else 0)
        for d in range(len(stack), len(turns) // TURN + 1):
            stack.append(Node(d, int.from_bytes(turns[d * TURN - 8 : d * TURN], "big"), fresh))
        if fresh:
            first, fresh, shared = turns, False, len(turns) // TURN
        else:
            shared = min(shared, lcp)
        last = turns
        top = stack[-1]
        top.ends.append(conv)
        top.n += 1
        top.least = conv if top.least is None else min(top.least, conv)
    if fresh:
        return
    keys: dict[tuple[bool, int], bytes] = {}
    for own, turns in ((True, first), (False, last)):
        h = hashlib.blake2b(digest_size=16)
        keys[own, 0] = h.digest()
        for d in range(1, len(turns) // TURN + 1):
            h.update(turns[(d - 1) * TURN : d * TURN])
            keys[own, d] = h.copy().digest()
    parts = {id(x) for x in stack} | {id(x) for x in done if x.first}
    done += reversed(stack)
    # Parents before children: the last one seen of the depth above is a node's parent.
    above: dict[int, tuple[int | None, int | None]] = {}
    seq_of = lambda x: x.depth if x.first else len(first) // TURN + x.depth - shared
    for x in reversed(done):
        parent, parent_seq = above.get(x.depth - 1, (None, None))
        if id(x) in parts:
            above[x.depth] = None, seq_of(x)
            yield part, seq_of(x), None, x.least, x.depth, None, x.n, x.children, x.leaves, x.saved, None, keys[x.first, x.depth], x.length, not x.first, _id_text(x.ends)
        else:
            above[x.depth] = x.least, None
            yield part, None, parent_seq, x.least, x.depth, parent, x.n, x.children, x.leaves, x.saved, hashlib.sha256(_id_text(x.ends)).hexdigest(), None, None, None, None


def _ranges(batches: Iterator) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    runs = [Run(list(zip(b.column("turns").to_pylist(), b.column("conv_id").to_pylist()))) for b in batches]
    names = [x.split()[0] for x in _PARTS.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    yield from _batches(range_rows(merged(runs), TaskContext.get().partitionId()), names, [kinds[x.split()[1]] for x in _PARTS.split(", ")])


def joined_parts(parts: Iterator[dict]) -> Iterator[tuple]:
    """Whole nodes, each with the (part, seq) of its parts, of all ranges' parts in order."""
    import hashlib

    stack: list[Node] = []
    done: list[Node] = []

    def left(depth: int) -> None:
        while len(stack) > depth + 1:
            node = stack.pop()
            node.close()
            node.ends = node.ends.hexdigest()
            done.append(node)
            if stack:
                stack[-1].take(node)

    before, same = None, False
    for p in parts:
        d = p["depth"]
        if p["part"] != before:
            before, same, turned = p["part"], True, False
        if p["turn_down"] and not turned:  # from the first path to the last one
            left(d - 1)
            turned, same = True, False
        if same and len(stack) > d and stack[d].key == p["key"]:
            node = stack[d]
        else:
            if same:
                left(d - 1)
            same = False
            node = Node(d, p["length"])
            node.key, node.refs, node.ends = p["key"], [], hashlib.sha256()
            stack.append(node)
        own = Node(d, 0)
        own.n, own.least, own.leaves, own.saved = p["n_convs"], p["conv_id"], p["n_leaves"], p["saved_tokens"]
        node.children += p["n_children"]
        node.add(own)
        if p["ends"]:
            node.ends.update(b"," if node.first else b"")
            node.ends.update(p["ends"])
            node.first = True  # here: some ends are in the digest
        node.refs.append({"part": p["part"], "seq": p["seq"]})
    left(-1)
    above: dict[int, int] = {}
    for x in reversed(done):
        above[x.depth] = x.least
        yield x.least, x.depth, above.get(x.depth - 1), x.n, x.children, x.leaves, x.saved, x.ends, x.refs


def _joined(batches: Iterator) -> Iterator:
    import pyarrow as pa

    refs = pa.list_(pa.struct([("part", pa.int32()), ("seq", pa.int32())]))
    yield from _batches(joined_parts(row for b in batches for row in b.to_pylist()), [*_NODE, "refs"], [*[pa.int64()] * 7, pa.string(), refs])


def _strings(head: Callable[[int], int] | None) -> Callable:
    """(conv_id, turns) of turns that come by family, its first conversation first; head: how many turns of that one a conversation starts with."""

    def rows(batches: Iterator) -> Iterator[tuple[int, int, bytes]]:
        for b in batches:
            yield from zip(b.column("family").to_pylist(), b.column("conv_id").to_pylist(), b.column("token").to_pylist())

    def strings(batches: Iterator) -> Iterator[tuple[int, bytes]]:
        for family, members in groupby(rows(batches), key=itemgetter(0)):
            start = b""
            for conv, turns in groupby(members, key=itemgetter(1)):
                own = b"".join(t for _, _, t in turns)
                if conv == family:
                    start = own[: HEAD * TURN]
                n = TURN * (head(conv) if head is not None else 0)
                yield conv, start[:n] + own[n:]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from _batches(strings(batches), ["conv_id", "turns"], [pa.int64(), pa.binary()])

    return run


def strings(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: Column | None = None, head: Callable[[int], int] | None = None) -> DataFrame:
    """(conv_id long, turns binary): each conversation's turns in order, TURN bytes each.

    family and head: a conversation starts with head(conv_id) turns (HEAD at most) of the one whose id is its family,
    instead of its own first ones.
    """
    small_batches(df.sparkSession, 4096)
    said, by = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(said).cast("string"), F.lit(":"), said, by).cast("binary"), 256), 1, 32)
    token = F.unhex(F.concat(digest, F.lpad(F.hex(F.octet_length(by)), 16, "0")))
    own = F.col(conv_id).cast("long")
    rows = df.where(own.isNotNull()).select(own.alias("conv_id"), (own if family is None else family).alias("family"), F.col(turn).alias("turn"), token.alias("token"))
    dealt = rows.repartition("family").sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", F.asc_nulls_first("turn"), "token")
    return dealt.select("family", "conv_id", "token").mapInArrow(_strings(head), "conv_id long, turns binary")


def trie(conversations: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The nodes of the trie of (conv_id, turns), as `strings` gives them: conv_id, the smallest conversation below a
    node, with depth its name; parent_conv_id, the parent's conv_id (null for the root); n_convs; n_children; n_leaves;
    saved_tokens, the bytes of last texts of its subtree that are there more than once; ends_sha256, of the
    conv_ids that end at the node.

    A conversation without turns ends at the root.  An empty table gives no nodes.
    """
    spark = conversations.sparkSession
    kept = staged(conversations, "strings")
    told = kept.agg(F.coalesce(F.sum(F.octet_length("turns") + 40), F.lit(0))).first()[0]
    n = max(partitions(spark), -(-told // range_bytes))
    parts = staged(kept.repartitionByRange(n, "turns", "conv_id").mapInArrow(_ranges, _PARTS), "trie")
    open_ = parts.where("seq is not null").repartition(1).sortWithinPartitions("part", "seq")  # a path or two a range
    node = f"{', '.join(c + ' long' for c in _NODE[:-1])}, ends_sha256 string"
    paths = staged(open_.mapInArrow(_joined, f"{node}, refs array<struct<part:int,seq:int>>"), "paths")
    whole = parts.where("seq is null")
    above = paths.select(F.explode("refs").alias("r"), F.col("conv_id").alias("above")).select(F.col("r.part").alias("part"), F.col("r.seq").alias("parent_seq"), "above")
    below = whole.where("parent_seq is not null").join(above, ["part", "parent_seq"]).withColumn("parent_conv_id", F.col("above"))
    return whole.where("parent_seq is null").select(*_NODE).unionByName(below.select(*_NODE)).unionByName(paths.select(*_NODE))


def conversation_trie(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of a table of turns.  Turns go by number, nulls first, and turns of one number by their digest; a null
    role or text is empty.  Rows without a conv_id belong to no conversation.  Other columns aren't read."""
    return trie(strings(df, conv_id, turn, role, text))


def node_turns(nodes: DataFrame, df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """nodes (of `conversation_trie(df)`) with the role and text of each node's last turn; the root has none."""
    from pyspark.sql import Window

    said, by = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.length(said).cast("string"), F.lit(":"), said, by).cast("binary"), 256)
    places = df.select(F.col(conv_id).cast("long").alias("conv_id"), F.row_number().over(Window.partitionBy(conv_id).orderBy(F.asc_nulls_first(turn), digest)).cast("long").alias("depth"), said.alias("role"), by.alias("text"))
    return nodes.join(places, ["conv_id", "depth"], "left")


def rebuilt_head(conv: int) -> int:
    """How many turns a rebuilt conversation takes from the first of its five."""
    import zlib

    return zlib.crc32(str(conv).encode()) % 9


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return trie(strings(rows, family=F.col("conv_id") - F.col("conv_id") % 5, head=rebuilt_head))


def sql() -> str:
    """The same nodes by grouping all prefixes of all conversations."""
    return f"""WITH RECURSIVE {CRC_STEPS}, given AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS token, octet_length(encode(coalesce(text, ''))) AS bytes FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, token) AS k FROM given
), convs AS (
  SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM given), crc_steps
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, k, token, bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND k <= h
  UNION ALL SELECT c.conv_id, 1, k, token, bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND k > h
), whole AS (
  SELECT c.conv_id, coalesce(list(token ORDER BY own, k) FILTER (token IS NOT NULL), []) AS tokens, coalesce(list(bytes ORDER BY own, k) FILTER (token IS NOT NULL), []) AS lengths FROM convs c LEFT JOIN rebuilt USING (conv_id) GROUP BY c.conv_id
), prefixes AS (
  SELECT conv_id, tokens, len(tokens) AS n, unnest(range(len(tokens) + 1)) AS depth, lengths FROM whole
), nodes AS (
  SELECT depth, tokens[1:depth] AS key, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(lengths[depth]), 0) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, tokens[1:depth]
), children AS (
  SELECT key[1:depth - 1] AS key, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), sums AS (
  SELECT a AS depth, key[1:a] AS key, sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
  FROM (SELECT o.*, c.n, unnest(range(o.depth + 1)) AS a FROM nodes o LEFT JOIN children c ON c.depth = o.depth AND c.key = o.key) GROUP BY a, key[1:a]
)
SELECT o.conv_id, o.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, o.ends_sha256
FROM nodes o LEFT JOIN children c ON c.depth = o.depth AND c.key = o.key JOIN sums s ON s.depth = o.depth AND s.key = o.key LEFT JOIN nodes p ON p.depth = o.depth - 1 AND p.key = o.key[1:o.depth - 1]"""
