"""The prefix trie of conversations, from a merge of sorted runs that carry common prefixes."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import Staging
from .text import over_texts

#: Bytes of the digest that stands for a turn in a conversation's key.
TURN = 16
#: Bytes of keys in one sorted run.
RUN_BYTES = 16 << 20
#: Bytes of keys that a task merges, on average.
RANGE_BYTES = 8 << 20
#: Bytes of one piece of a long list of members.
PIECE = 1 << 16
NOBODY = hashlib.sha256(b"").hexdigest()
_RUNS = pa.schema([("run", pa.int64()), ("pos", pa.int32()), ("conv_id", pa.int64()), ("key", pa.binary()), ("chars", pa.binary()), ("lcp", pa.int32())])
_NUMBERS = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_NODES = pa.schema([("part", pa.int64()), ("name", pa.binary()), ("parent_name", pa.binary()), ("parent_conv_id", pa.int64()), *((c, pa.int64()) for c in _NUMBERS), ("chars", pa.int64()), ("ends_sha256", pa.string()), ("at", pa.int64()), ("piece", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    names = {"int64": "long", "int32": "int"}
    return ", ".join(f"{f.name} {names.get(str(f.type), f.type)}" for f in schema)


def common(a: bytes, b: bytes, known: int) -> int:
    """How many first turns two keys share, of which `known` are known."""
    low, high = known, min(len(a), len(b)) // TURN
    if a[low * TURN : high * TURN] == b[low * TURN : high * TURN]:
        return high
    while low < high - 1:
        mid = (low + high) // 2
        if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN]:
            low = mid
        else:
            high = mid
    return low


def _sorted_runs(run_bytes: int):
    """A task that sorts its conversations in runs; each row knows how many turns it shares with the one before."""

    def run_of(number: int, rows: list[tuple]) -> pa.RecordBatch:
        rows.sort()
        lcp = [0] + [common(a[0], b[0], 0) for a, b in zip(rows, rows[1:], strict=False)]
        keys, ids, chars = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([number] * len(rows), range(len(rows)), ids, keys, chars, lcp), _RUNS, strict=True)], schema=_RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = pyspark.TaskContext.get().partitionId() << 33
        rows, size = [], 0
        for batch in batches:
            for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns"), strict=True):
                held = turns.values
                key = b"".join(held.field("digest").to_pylist())
                rows.append((key, conv, np.asarray(held.field("chars"), dtype=np.int64).tobytes()))
                size += len(key) + 100
                if size >= run_bytes:
                    yield run_of(number, rows)
                    rows, size, number = [], 0, number + 1
        if rows:
            yield run_of(number, rows)

    return run


def merged(keys: list[bytes], ids: list[int], lcps: list[int], bounds: list[int]) -> Iterator[tuple[int, int]]:
    """Rows of several sorted runs in order, with the number of turns that each shares with the one before.

    Run r is the rows bounds[r] to bounds[r + 1]. A tree of losers keeps for
    every head how many turns it shares with the row that left last. Where two
    heads differ in that, the one that shares more is next, and no turn is
    compared; else only turns beyond the shared ones are.
    """
    runs = len(bounds) - 1
    width = 1 << max(0, runs - 1).bit_length()
    at = bounds[:-1] + [0] * (width - runs)
    end = bounds[1:] + [0] * (width - runs)
    shares = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser then knows what it shares with the winner."""
        if at[b] >= end[b]:
            return a, b
        if at[a] >= end[a]:
            return b, a
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        x, y = keys[at[a]], keys[at[b]]
        same = common(x, y, shares[a])
        rest = (x[same * TURN : (same + 1) * TURN], ids[at[a]]), (y[same * TURN : (same + 1) * TURN], ids[at[b]])
        winner, loser = (a, b) if rest[0] < rest[1] else (b, a)
        shares[loser] = same
        return winner, loser

    losers, winners = [0] * width, [0] * width + list(range(width))
    for node in range(width - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if width > 1 else 0
    while at[best] < end[best]:
        row = at[best]
        yield row, shares[best]
        at[best] = row + 1
        if row + 1 < end[best]:
            shares[best] = lcps[row + 1]
        node = (best + width) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


class Open:
    """A node of the trie whose conversations are still coming."""

    __slots__ = ("border", "chars", "conv", "ends", "n_children", "n_convs", "n_leaves", "number", "saved")

    def __init__(self, number: int, chars: int, border: bool) -> None:
        self.number, self.chars, self.border = number, chars, border
        self.conv, self.ends = None, []
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0


def _batch(**columns) -> pa.RecordBatch:
    rows = len(columns["part"])
    arrays = (columns.get(f.name, pa.nulls(rows, f.type)) for f in _NODES)
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, _NODES, strict=True)], schema=_NODES)


def names_of(key: bytes) -> list[bytes]:
    """A digest for each prefix of a key, the empty one first."""
    running, out = hashlib.blake2b(digest_size=TURN), []
    for at in range(0, len(key) + 1, TURN):
        out.append(running.copy().digest())
        running.update(key[at : at + TURN])
    return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs of one range of keys and gives the nodes of its conversations.

    A node is finished when a conversation comes that lies outside it. Nodes of
    the first and of the last conversation may go on in other ranges: they leave
    with a name, as parts to be summed up, and what their finished children
    hold is in their sums.
    """
    part = pyspark.TaskContext.get().partitionId()
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    del held
    keys, ids, lcps = (table.column(c).to_pylist() for c in ("key", "conv_id", "lcp"))
    chars = [np.frombuffer(c, dtype=np.int64) for c in table.column("chars").to_pylist()]
    run = np.asarray(table.column("run"))
    bounds = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]

    out = {c: array("q") for c in ("parent", *_NUMBERS)}
    sha: dict[int, str] = {}  # of nodes at which conversations end
    names: dict[int, bytes] = {}  # of nodes on the border
    lengths: dict[int, int] = {}
    pieces: list[tuple] = []
    path: list[Open] = []

    def enter(length: int, border: bool) -> None:
        path.append(Open(len(out["depth"]), length, border))
        for column in out.values():
            column.append(0)
        out["depth"][-1] = len(path) - 1
        out["parent"][-1] = path[-2].number if len(path) > 1 else -1

    def leave() -> None:
        node = path.pop()
        i = node.number
        if not node.border:
            node.n_leaves += not node.n_children
            node.saved += (node.n_convs - 1) * node.chars
        for column, value in zip(_NUMBERS, (node.conv, len(path), node.n_convs, node.n_children, node.n_leaves, node.saved), strict=True):
            out[column][i] = value
        if node.ends and not node.border:
            sha[i] = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
        elif node.ends:
            text, step = list(map(str, node.ends)), max(1, PIECE // 20)
            pieces.extend((names[i], n, ",".join(text[n : n + step])) for n in range(0, len(text), step))
        if node.border:
            lengths[i] = node.chars
        if path:
            above = path[-1]
            above.n_convs += node.n_convs
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
            if not node.border:
                above.n_children += 1
                above.n_leaves += node.n_leaves
                above.saved += node.saved

    enter(0, True)
    key = b""
    for row, same in merged(keys, ids, lcps, bounds):
        while len(path) - 1 > same:
            leave()
        first = not names
        if first:
            names.update(enumerate(names_of(keys[row])))
        key = keys[row]
        for d in range(len(path) - 1, len(key) // TURN):
            enter(int(chars[row][d]), first)
        top = path[-1]
        top.n_convs += 1
        top.conv = ids[row] if top.conv is None else min(top.conv, ids[row])
        top.ends.append(ids[row])
    for node, name in zip(path, names_of(key), strict=True):
        names[node.number] = name
        node.border = True
    while path:
        leave()

    columns = {c: np.frombuffer(v, dtype=np.int64) for c, v in out.items()}
    border = np.zeros(len(columns["depth"]), dtype=bool)
    border[list(names)] = True
    inner, parent = np.flatnonzero(~border), columns["parent"]
    for i in range(0, len(inner), 50_000):
        at = inner[i : i + 50_000]
        above = parent[at]
        yield _batch(
            part=np.full(len(at), part),
            parent_name=[names.get(p) for p in above.tolist()],
            parent_conv_id=pa.array(columns["conv_id"][above], mask=border[above]),
            ends_sha256=[sha.get(n, NOBODY) for n in at.tolist()],
            **{c: columns[c][at] for c in _NUMBERS},
        )
    for i in range(0, len(names), 50_000):
        at = np.array(sorted(names)[i : i + 50_000])
        yield _batch(part=np.full(len(at), part), name=[names[n] for n in at.tolist()], parent_name=[names.get(p) for p in parent[at].tolist()], chars=[lengths[n] for n in at.tolist()], **{c: columns[c][at] for c in _NUMBERS})
    for i in range(0, len(pieces), 100):
        some = pieces[i : i + 100]
        yield _batch(part=[part] * len(some), name=[p[0] for p in some], at=[p[1] for p in some], piece=[p[2] for p in some])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each name's list of members, whose pieces come in order."""
    schema = pa.schema([("name", pa.binary()), ("ends_sha256", pa.string())])
    now, running = None, hashlib.sha256()
    for batch in batches:
        for name, piece in zip(batch.column("name").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if name != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()])], schema=schema)
                now, running = name, hashlib.sha256()
                running.update(piece.encode())
            else:
                running.update(b"," + piece.encode())
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()])], schema=schema)


def _subtree_sums(nodes: DataFrame, staging: Staging) -> DataFrame:
    """(name, n_leaves, saved_tokens) summed over each node's subtree; every round doubles how far down the sums reach."""
    now, i = staging.write(nodes.select("name", F.col("parent_name").alias("above"), "n_leaves", "saved_tokens"), "sums0"), 0
    while not now.where("above IS NOT NULL").isEmpty():
        i += 1
        below = now.where("above IS NOT NULL").groupBy(F.col("above").alias("name")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        higher = now.select(F.col("name").alias("above"), F.col("above").alias("next"))
        grown = now.join(below, "name", "left").join(higher, "above", "left")
        sums = [(F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c) for c, m in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))]
        now = staging.write(grown.select("name", F.col("next").alias("above"), *sums), f"sums{i}")
    return now.drop("above")


def rebuilt(conversations: DataFrame, staging: Staging, block: int = 100, shared_turns: int = 6) -> DataFrame:
    """(conv_id, turns) of conversations, each begun with turns of the first one of its block of ids.

    Conversation c takes the first crc32(c) % shared_turns turns of conversation
    c - c % block and goes on with its own turns after as many.
    """
    own = staging.write(sequences(conversations), "own")
    first = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, max(1, shared_turns - 1)).alias("lent"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared_turns).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(first, "base", "left").withColumn("head", head)
    lent = F.when(F.col("lent").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("lent", F.lit(1), F.col("head")))
    return both.select("conv_id", F.concat(lent, F.slice("turns", F.col("head") + 1, F.size("turns"))).alias("turns"))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with a digest and a length for each turn, in order; texts are read but never shuffled."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest: Column = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, TURN)
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars")).alias("t"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def prefix_trie(conversations: DataFrame, staging: Staging, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each node of the trie of conversations (conv_id, turns as `sequences` gives them; ids differ).

    A node of depth d is a distinct sequence of d first turns; its members are
    the conversations that begin with it, and the root (d = 0) has all of them.
    Columns: conv_id (smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves (childless nodes in its subtree, itself
    included), saved_tokens (over its subtree, each node's members but one times
    the characters of its last turn) and ends_sha256 (of the ids, ascending and
    comma-joined, of members that have no further turn).

    Tasks sort their conversations in runs whose rows know how many turns they
    share with the row before. Runs are dealt by ranges of (turns, id), so that
    any number of like conversations spreads over ranges, and each range merges
    its runs by a tree of losers, which compares no shared turn again. The
    merged stream feeds a stack of open nodes. Nodes on the border of a range
    are summed over ranges. A turn is named by 128 bits of its SHA-256.

    A list of members that end at one node is hashed by one task, as SHA-256
    has to be, from pieces of 64 kB. A conversation's digests are held whole by a
    task, its texts never. No conversations give no rows, not even a root.
    """
    spark = conversations.sparkSession
    runs = staging.write(over_texts(conversations.select("conv_id", "turns"), _sorted_runs(run_bytes), _ddl(_RUNS)), "runs")
    size = runs.agg(F.coalesce(F.sum(F.octet_length("key") + 100), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    dealt = runs.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("run", "pos")
    found = staging.write(over_texts(dealt, _nodes, _ddl(_NODES)), "nodes")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

    parts = found.where("name IS NOT NULL AND piece IS NULL")
    sums = {"conv_id": F.min, "depth": F.min, "parent_name": F.max, "n_convs": F.sum, "n_children": F.sum, "n_leaves": F.sum, "saved_tokens": F.sum, "chars": F.max}
    border = staging.write(parts.groupBy("name").agg(*(f(c).alias(c) for c, f in sums.items())), "border")
    kids = border.where("parent_name IS NOT NULL").groupBy(F.col("parent_name").alias("name")).agg(F.count("*").alias("kids"))
    joined = border.join(kids, "name", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    own = joined.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars"))
    whole = staging.write(own.drop("kids"), "whole")
    summed = _subtree_sums(whole, staging)
    pieces = found.where("piece IS NOT NULL").select("name", "part", "at", "piece").repartition("name").sortWithinPartitions("name", "part", "at")
    ends = over_texts(pieces, _digests, "name binary, ends_sha256 string")
    above = whole.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("parent_conv_id"))
    on_border = whole.drop("n_leaves", "saved_tokens").join(summed, "name").join(above, "parent_name", "left").join(ends, "name", "left")
    on_border = on_border.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY))).select(columns)

    inner = found.where("name IS NULL")
    known = inner.where("parent_name IS NULL").select(columns)
    parents = parts.select("part", F.col("name")).join(whole.select("name", F.col("conv_id").alias("parent_conv_id")), "name").withColumnRenamed("name", "parent_name")
    asked = inner.where("parent_name IS NOT NULL").drop("parent_conv_id").join(parents, ["part", "parent_name"]).select(columns)
    return known.union(asked).union(on_border)


def conversation_trie(conversations: DataFrame, block: int = 100, shared_turns: int = 6) -> DataFrame:
    """`prefix_trie` of rebuilt conversations, from a table of turns (conv_id, turn, role, text).

    Turns are ordered by `turn`, null first; turns with one number by a digest of
    role and text, so that the order is the same on every run. Null roles and
    texts count as empty, an empty turn still is a turn. Repeated rows are turns
    of their own. Rows without a conv_id belong to no conversation. An empty
    table gives no rows. Other columns, whatever their names, are not read.
    """
    staging = Staging(conversations.sparkSession, "prefixtrie")
    return prefix_trie(rebuilt(conversations, staging, block, shared_turns), staging)
