"""Exact deduplication by Patricia-trie owners.

Every task first inserts its own texts into a compressed radix trie, so that a text with very many copies leaves a
task once. What is left is dealt out by byte length and content hash, and each partition inserts the full byte
strings of its rows into a trie of its own. Keys are the plain bytes of the texts: edges hold runs of bytes, nodes
branch where texts part, and a terminal node stores the owner (the largest or smallest identifier) and the count.
A trie that outgrows its bound gives up a subtree at a time, the smallest one that holds half of it; a text that
comes again later then has another terminal. Terminals of one text are added up in the end by their digest, of
which only owners and counts are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import column, packed, uid

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that a task's trie may hold, a node's own share of them, and bytes of text in a batch that a task gives out.
SPILL_BYTES, NODE_BYTES, OUT_BYTES = 16_000_000, 200, 1_000_000


class RadixTrie:
    """Compressed radix trie over byte strings.

    A node is [edge, children by first byte, terminal or None, bytes held at and below it]; a terminal is [owner, count].
    """

    def __init__(self):
        self.root: list = [b"", {}, None, 0]

    @property
    def held(self) -> int:
        return self.root[3]

    def insert(self, key: bytes, owner: int | None, count: int, largest: bool) -> None:
        path, node, at = [self.root], self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None, 0]
                node[1][key[at]] = child
                path.append(child)
                self._grow(path, len(key) - at + NODE_BYTES)
                at = len(key)
            elif key.startswith(child[0], at):
                at += len(child[0])
                path.append(child)
            else:
                edge = child[0]
                same = _common(edge, key, at)
                child[:] = [edge[:same], {edge[same]: [edge[same:], child[1], child[2], child[3] - same]}, None, child[3]]
                path.append(child)
                self._grow(path, NODE_BYTES)
                at += same
            node = child
        if node[2] is None:
            node[2] = [owner, count]
        else:
            node[2][:] = [_own(node[2][0], owner, largest), node[2][1] + count]

    @staticmethod
    def _grow(path: list[list], size: int) -> None:
        for node in path:
            node[3] += size

    def evict(self) -> Iterator[tuple[bytes, int, int]]:
        """Cuts off the smallest subtree that holds half of all bytes, or else the largest below the root; gives its strings."""
        path, most = [self.root], self.root[3] / 2
        while path[-1][1]:
            child = max(path[-1][1].values(), key=lambda c: c[3])
            if child[3] < most and len(path) > 1:
                break
            path.append(child)
            if child[3] < most:
                break
        node = path.pop()
        if path:
            del path[-1][1][node[0][0]]
            self._grow(path, -node[3])
        else:
            self.root = [b"", {}, None, 0]
        yield from _strings(b"".join(n[0] for n in path), node)

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        """Every string with its owner and count, subtree by subtree."""
        yield from _strings(b"", self.root)


def _strings(before: bytes, node: list) -> Iterator[tuple[bytes, int, int]]:
    stack = [(before, node)]
    while stack:
        before, (edge, children, end, _) = stack.pop()
        if end is not None:
            yield before + edge, end[0], end[1]
        stack += [(before + edge, child) for child in children.values()]


def _own(a, b, largest: bool):
    if a is None or b is None:
        return a if b is None else b
    return max(a, b) if largest else min(a, b)


def _common(edge: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of edge and key[at:], by halving."""
    low, high = 0, min(len(edge), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if edge[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _terminals(batches: Iterator[pa.RecordBatch], largest: bool, spill: int) -> Iterator[tuple[bytes, int, int]]:
    """The strings of a task's rows (text, owner, count): those of evicted subtrees as they go, the others in the end."""
    trie = RadixTrie()
    for batch in batches:
        buf, offsets = packed(column(batch, "text"))
        ends = offsets.tolist()
        for i, (owner, count) in enumerate(zip(column(batch, "owner").to_pylist(), column(batch, "count").to_pylist(), strict=True)):
            trie.insert(buf[ends[i] : ends[i + 1]].tobytes(), owner, count, largest)
            while trie.held > spill:
                yield from trie.evict()
    yield from trie.items()


def _batches(rows: Iterator[tuple], size_of, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about OUT_BYTES, as size_of counts them."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size > OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _combine(largest: bool, spill: int):
    schema = pa.schema([("text", pa.string()), ("owner", pa.int64()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_terminals(batches, largest, spill), lambda r: len(r[0]) + 16, schema)

    return run


def _owners(largest: bool, spill: int):
    schema = pa.schema([("text_sha256", pa.string()), ("owner", pa.int64()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((hashlib.sha256(text).hexdigest(), owner, count) for text, owner, count in _terminals(batches, largest, spill))
        yield from _batches(found, lambda r: 80, schema)

    return run


def normalise(text):
    """A-Z to a-z and nothing else; null as the empty text."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def owners(docs: DataFrame, largest: bool = True, spill: int = SPILL_BYTES) -> DataFrame:
    """One row for each distinct normalised text: text_sha256, owner, group_size."""
    rows = docs.select(normalise(docs["text"]).alias("text"), docs["doc_id"].cast("long").alias("owner"), F.lit(1).cast("long").alias("count"))
    local = rows.mapInArrow(_combine(largest, spill), "text string, owner long, count long")
    dealt = local.repartition(F.octet_length("text"), F.xxhash64("text"))
    found = dealt.mapInArrow(_owners(largest, spill), "text_sha256 string, owner long, count long")
    return found.groupBy("text_sha256").agg((F.max if largest else F.min)("owner").alias("owner"), F.sum("count").alias("group_size"))


def exact_dedup(docs: DataFrame, keep: str = "largest", spill: int = SPILL_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and uid of every row of docs (doc_id, text).

    Rows are equal when their texts are identical after lower-casing A-Z. keep: whether the row with the largest
    or the smallest doc_id stays. A null text is the empty one, which is a text like any other. A row with a
    null doc_id counts in its group but is never chosen over another; if all ids of a group are null, keep_id is
    null and all of its rows stay. Rows that repeat the chosen doc_id are all marked as kept; uid (see
    `common.documents`) tells those apart that differ. Other columns are ignored; an empty table gives an empty result.
    A text longer than `spill` is inserted and evicted like any other, so it needs memory for itself.
    """
    found = owners(docs, keep == "largest", spill).select("text_sha256", F.col("owner").alias("keep_id"), "group_size")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), uid(docs).alias("uid"), F.sha2(normalise(docs["text"]).cast("binary"), 256).alias("text_sha256"))
    return rows.join(found, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "uid")
