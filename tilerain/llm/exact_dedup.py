"""Exact duplicate texts, owned by the terminals of Patricia tries."""

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilerain.llm.common import mapped, spill_file, text_of

#: Python bytes that one task's trie may hold before subtrees go to disk.
TRIE_BYTES = 96 << 20
#: Bytes that a node costs beside its label.
NODE_BYTES = 200
SCHEMA = "n_bytes long, text_sha256 string, content long, body binary, keep_id long, group_size long"


class _Spill:
    """The strings of a subtree that left memory, as (id or none, rows, string) records."""

    HEAD = struct.Struct("<?qqq")

    def __init__(self):
        self.file = spill_file()

    def add(self, key: bytes, ident: int | None, rows: int) -> None:
        self.file.write(self.HEAD.pack(ident is not None, ident or 0, rows, len(key)))
        self.file.write(key)

    def records(self) -> Iterator[tuple[bytes, int | None, int]]:
        self.file.seek(0)
        while head := self.file.read(self.HEAD.size):
            known, ident, rows, size = self.HEAD.unpack(head)
            yield self.file.read(size), ident if known else None, rows
        self.file.close()


class _Node:
    __slots__ = ("label", "children", "ident", "rows", "spill")

    def __init__(self, label: bytes):
        self.label, self.children, self.ident, self.rows, self.spill = label, {}, None, 0, None


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low + 1 < high:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low if a[low:low + 1] != b[low:low + 1] else low + 1


class PatriciaOwners:
    """A compressed radix trie of byte strings. Each terminal keeps the smallest id and the number of rows of its string.

    Beyond `budget` bytes the heaviest subtree below the first branching is written to disk and its place keeps only the
    file; later strings of that subtree are appended. `drain` builds each spilled subtree as a trie of its own, so any
    number of strings passes through bounded memory. Only a single string larger than the budget stays whole.
    """

    def __init__(self, budget: int = TRIE_BYTES):
        self.budget, self.root, self.held = budget, _Node(b""), 0

    def insert(self, key: bytes, ident: int | None, rows: int = 1) -> None:
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                node.spill.add(key, ident, rows)
                return
            if at == len(key):
                break
            child = node.children.get(key[at])
            if child is None:
                child = _Node(key[at:])
                node.children[key[at]] = child
                self.held += len(child.label) + NODE_BYTES
                node, at = child, len(key)
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                same = _shared(child.label, key[at:at + len(child.label)])
                upper = _Node(child.label[:same])
                child.label = child.label[same:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                self.held += NODE_BYTES
                node, at = upper, at + same
        if node.rows == 0 or (ident is not None and (node.ident is None or ident < node.ident)):
            node.ident = ident
        node.rows += rows
        if self.held > self.budget:
            self._shed()

    @staticmethod
    def _below(node: _Node, path: bytes) -> Iterator[tuple[_Node, bytes]]:
        stack = [(node, path)]
        while stack:
            node, path = stack.pop()
            yield node, path
            stack.extend((c, path + c.label) for c in node.children.values())

    def _shed(self) -> None:
        top, path = self.root, b""
        while len(top.children) == 1 and not top.rows:
            top = next(iter(top.children.values()))
            path += top.label
        weigh = {}
        for first, child in top.children.items():
            if child.spill is None:
                weigh[first] = sum(len(n.label) + NODE_BYTES for n, _ in self._below(child, b""))
        if not weigh:
            return
        victim = top.children[max(weigh, key=weigh.get)]
        spill = _Spill()
        for node, key in self._below(victim, path + victim.label):
            if node.spill is not None:
                for record in node.spill.records():
                    spill.add(*record)
            elif node.rows:
                spill.add(key, node.ident, node.rows)
        self.held -= max(weigh.values())
        victim.children, victim.rows, victim.ident, victim.spill = {}, 0, None, spill

    def drain(self) -> Iterator[tuple[bytes, int | None, int]]:
        spilled = []
        for node, key in self._below(self.root, b""):
            if node.spill is not None:
                spilled.append(node.spill)
            elif node.rows:
                yield key, node.ident, node.rows
        self.root, self.held = _Node(b""), 0
        for spill in spilled:
            part = PatriciaOwners(self.budget)
            for record in spill.records():
                part.insert(*record)
            yield from part.drain()


def _owners(budget: int):
    """Folds the rows of a partition to one row per distinct string; the trie compares whole strings."""
    def fold(batches):
        trie, keys = PatriciaOwners(budget), {}
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for n_bytes, sha, content, body, ident, rows in zip(*cols):
                trie.insert(body, ident, rows)
        rows, size = [], 0
        for row in trie.drain():
            rows.append(row)
            size += len(row[0])
            if size > (8 << 20):
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)
    return fold


def _batch(rows) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                            pa.array([r[2] for r in rows], pa.int64())], ["body", "keep_id", "group_size"])


def _keys(body: Column) -> list[Column]:
    return [F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("text_sha256"),
            F.xxhash64(body).alias("content")]


def normalised(column: str) -> Column:
    return F.regexp_replace(text_of(column), r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are after white space runs became one space. Every input partition folds its texts
    in a trie first, so a text that holds a third of all rows is shuffled once per input partition; the distinct texts
    then meet in partitions by length and content hash, whose tries name the owner. The wide texts are shuffled once;
    rows learn their owner through a join on length and SHA-256, whose hot keys adaptive execution splits.

    Null texts count as empty. A null id is never smaller than another: keep_id is null only where all ids of a group
    are, and then its null rows are kept. Rows that repeat both id and text stand for one document and share `kept`.
    An empty table gives no rows; further columns play no part.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), normalised(text).cast("binary").alias("body"))
    one = rows.select(*_keys(F.col("body")), "body", F.col("doc_id").alias("keep_id"),
                      F.lit(1).cast("long").alias("group_size"))
    order = ["n_bytes", "text_sha256", "content", "body", "keep_id", "group_size"]
    folded = "body binary, keep_id long, group_size long"

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(*_keys(F.col("body")), "body", "keep_id", "group_size")

    local = keyed(mapped(one.select(*order), _owners(budget), folded))
    owners = keyed(mapped(local.repartition("n_bytes", "content").select(*order), _owners(budget), folded))
    owners = owners.select("n_bytes", "text_sha256", "keep_id", "group_size")
    members = rows.select("doc_id", *_keys(F.col("body"))[:2])
    return (members.join(owners, ["n_bytes", "text_sha256"])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    "text_sha256"))


def without_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", budget: int = TRIE_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, whose text has no row with a smaller id; ids are taken as unique."""
    kept = exact_duplicates(docs, text, doc_id, budget).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs[f"`{doc_id}`"].cast("long").eqNullSafe(F.col("__kept_id")), "left_semi")
