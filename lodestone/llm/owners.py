"""Exact duplicates by compressed radix tries whose terminals name the owner of a text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import Staging
from .text import over_texts

#: Bytes of text and nodes that one task's tries may hold before a subtree is spilled.
TRIE_BYTES = 64 << 20
#: What a node costs beside its label.
NODE_BYTES = 300
#: Bytes of text in one output batch.
OUT_BYTES = 8 << 20
_SCHEMA = "id long, grp long, into long, text binary, length long, hash long, owner long, owner_row long, size long, final boolean"
_ARROW = pa.schema([("id", pa.int64()), ("grp", pa.int64()), ("into", pa.int64()), ("text", pa.binary()), ("length", pa.int64()), ("hash", pa.int64()), ("owner", pa.int64()), ("owner_row", pa.int64()), ("size", pa.int64()), ("final", pa.bool_())])


class Terminal:
    """What a trie knows of one text: the number of its group, its owner and how many rows have it."""

    __slots__ = ("grp", "hash", "owner", "row", "size")

    def __init__(self, grp: int, hashed: int) -> None:
        self.grp, self.hash, self.owner, self.row, self.size = grp, hashed, None, None, 0

    def add(self, owner: int | None, row: int, size: int, largest: bool) -> None:
        """Counts rows; the better owner stays, a null one only where all are null, of equal ones the first row."""
        self.size += size
        if self.row is None or (owner is not None and (self.owner is None or (owner > self.owner if largest else owner < self.owner))) or (owner == self.owner and row < self.row):
            self.owner, self.row = owner, row


class Node:
    """An edge label, and branches by first byte or a terminal; neither where a subtree was spilled (`sealed`)."""

    __slots__ = ("kids", "label", "sealed", "terminal", "texts", "weight")

    def __init__(self, label: bytes, kids: dict | None = None) -> None:
        self.label, self.kids, self.terminal, self.sealed = label, kids, None, False
        self.weight, self.texts = len(label) + NODE_BYTES, 0


def shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of a equal those of b from `at` on."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Tries:
    """A compressed radix trie for each length of text; texts of one length are never prefixes of each other."""

    def __init__(self) -> None:
        self.roots: dict[int, Node] = {}
        self.weight = self.texts = 0

    def reach(self, text: bytes) -> tuple[Node, list[Node]]:
        """The node at which `text` ends (made if new, then without a terminal), or the spilled one above it; and the way there."""
        length, at = len(text), 0
        node = self.roots.get(length)
        if node is None:
            node = self.roots[length] = Node(b"", {} if length else None)
            self.weight += node.weight
        way = [node]
        while node.kids is not None:
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = Node(text[at:])
                self.grow(way, kid.weight)
                way.append(kid)
                return kid, way
            if not text.startswith(kid.label, at):
                same = shared(kid.label, text, at)
                fork = Node(kid.label[:same], {kid.label[same]: kid})
                kid.label = kid.label[same:]
                fork.weight, fork.texts = kid.weight + NODE_BYTES, kid.texts
                node.kids[text[at]] = fork
                self.grow(way, NODE_BYTES)
                kid.weight -= same
                kid = fork
            at += len(kid.label)
            node = kid
            way.append(node)
        return node, way

    def grow(self, way: list[Node], weight: int, texts: int = 0) -> None:
        self.weight += weight
        self.texts += texts
        for node in way:
            node.weight += weight
            node.texts += texts

    def heaviest(self) -> tuple[bytes, list[Node]]:
        """The text above, and the way to, the heaviest subtree that leaves some text outside it."""
        way, prefix = [max((r for r in self.roots.values() if r.texts), key=lambda n: n.weight)], b""
        while way[-1].texts == self.texts:
            kid = max((k for k in way[-1].kids.values() if k.texts), key=lambda n: n.weight)
            prefix += kid.label
            way.append(kid)
        return prefix, way

    def spill(self, seal: bool) -> Iterator[tuple[bytes, Terminal]]:
        """Takes a heavy subtree out: its texts and terminals. Sealed, its root stays and turns later texts away."""
        prefix, way = self.heaviest()
        node = way[-1]
        yield from walk(node, prefix)
        gone = node.weight - (len(node.label) + NODE_BYTES if seal else 0)
        self.grow(way, -gone, -node.texts)
        if seal:
            node.kids = node.terminal = None
            node.sealed = True
        elif len(way) > 1:
            del way[-2].kids[node.label[0]]
        else:
            self.roots = {n: r for n, r in self.roots.items() if r is not node}

    def all(self) -> Iterator[tuple[bytes, Terminal]]:
        for root in self.roots.values():
            yield from walk(root, b"")


def walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, Terminal]]:
    """Texts and terminals below a node, whose own text is `prefix`."""
    stack = [(node, prefix)]
    while stack:
        node, text = stack.pop()
        if node.terminal is not None:
            yield text, node.terminal
        for kid in (node.kids or {}).values():
            stack.append((kid, text + kid.label))


class _Out:
    """Rows of the output as Arrow batches of bounded size."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, *row: object) -> bool:
        self.rows.append(row)
        self.bytes += 100 + len(row[3] or b"")
        return self.bytes >= OUT_BYTES

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(_ARROW)
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _hash(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _insert(largest: bool, limit: int, again: bool):
    """A task that inserts its texts into tries.

    Each row it reads gives a link (id, grp -> into), each text that leaves the
    tries a row with its owner and size, numbered `into`. In the first round the
    same text may leave them more than once, in this task or in others. `again`,
    all rows of a text are in one task, so what stays in the tries to the end is
    final, and what a spilled subtree would hold goes on to the next round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = pyspark.TaskContext.get().partitionId() << 33
        tries, out, groups, rows = Tries(), _Out(), 0, 0

        def leave(text: bytes, t: Terminal, final: bool = False) -> bool:
            return out.add(None, None, t.grp, text, len(text), t.hash, t.owner, t.row, t.size, final)

        for batch in batches:
            texts = batch.column("text")
            others = zip(*(batch.column(c).to_pylist() for c in (("owner", "owner_row", "size", "grp", "hash") if again else ("id",))), strict=True)
            for i, other in enumerate(others):
                text = texts[i].as_py() or b""
                if again:
                    owner, row, size, grp, hashed = other
                else:
                    text, owner, row, size, grp, hashed = text.lower(), other[0], base + rows, 1, None, None
                    rows += 1
                node, way = tries.reach(text)
                t = node.terminal
                if t is None:
                    t = Terminal(base + groups, _hash(text) if hashed is None else hashed)
                    groups += 1
                    if not node.sealed:
                        node.terminal = t
                        tries.grow(way, 0, 1)
                t.add(owner, row, size, largest)
                full = out.add(owner, row if grp is None else grp, t.grp, None, None, None, None, None, None, None)
                full = node.sealed and leave(text, t) or full
                while tries.weight > limit and tries.texts > 1:
                    for spilled in tries.spill(again):
                        if leave(*spilled):
                            yield out.take()
                if full:
                    yield out.take()
        for text, t in tries.all():
            if leave(text, t, again):
                yield out.take()
        yield out.take()

    return run


@dataclass
class Owners:
    """Tables of `owners`: one row for each document, one for each distinct text."""

    members: DataFrame
    texts: DataFrame


def owners(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> Owners:
    """Which row owns each text, where texts are equal but for the case of A-Z.

    `members` has one row for each of docs: doc_id, keep_id (the smallest or
    largest id of the rows with that text), group_size, kept (true for one row
    of each text) and text_sha256 (of the text in lower case). `texts` has one
    row for each text: text (lower case), keep_id, group_size, text_sha256.

    Every task first inserts its own rows into tries, so that of any number of
    copies at most one text leaves each task; these meet by length and hash of
    content in one task, whose tries compare whole byte strings. A task that
    holds more than `trie_bytes` spills a subtree: its texts are written and
    dealt again to more tasks, round by round, until none is left over.

    A null text counts as empty, and empty texts are equal. A null id never
    owns a text that another id has; where all are null keep_id is null and one
    row is kept. Of rows repeated with one id, one is kept. No row gives no
    rows. Other columns, whatever their names, are not read. A text is held
    whole by a task, however long; ids must be whole numbers.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    spark = docs.sparkSession
    staging, largest = Staging(spark, "owners"), keep == "largest"
    todo = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text"))
    links, finals, number = [], [], 0
    while True:
        again = number > 0
        done = staging.write(over_texts(todo, _insert(largest, trie_bytes, again), _SCHEMA), f"round{number}")
        links.append(done.where("grp IS NOT NULL").select("id", "grp", "into"))
        finals.append(done.where("final"))
        left = done.where("NOT final")
        if left.isEmpty():
            break
        number += 1
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) * number
        todo = left.drop("id", "grp", "final").withColumnRenamed("into", "grp").repartition(tasks, "length", "hash", F.lit(number))
    texts = None  # of each number that a round gave, its final text
    for link, final in zip(reversed(links[1:]), reversed(finals[1:]), strict=True):
        here = final.select(F.col("into").alias("grp"), "text", F.col("owner").alias("keep_id"), "owner_row", F.col("size").alias("group_size"), F.sha2("text", 256).alias("text_sha256"))
        own = here.drop("text")
        facts = own if texts is None else own.union(facts)
        texts = here if texts is None else texts.union(here)
        facts = link.select(F.col("grp").alias("was"), F.col("into").alias("grp")).join(facts, "grp").drop("grp").withColumnRenamed("was", "grp")
    if texts is None:  # no rows
        members = links[0].select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.col("grp").alias("group_size"), F.lit(True).alias("kept"), F.lit("").alias("text_sha256"))
        return Owners(members, members.select(F.lit("").alias("text"), "keep_id", "group_size", "text_sha256"))
    rows = links[0].select(F.col("id").alias("doc_id"), F.col("grp").alias("row"), F.col("into").alias("grp"))
    members = rows.join(facts, "grp").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("owner_row")).alias("kept"), "text_sha256")
    return Owners(members, texts.select(F.col("text").cast("string").alias("text"), "keep_id", "group_size", "text_sha256"))
