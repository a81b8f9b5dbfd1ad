"""Byte-level BPE encoding and decoding with overlapping chunks.

A text that fits in a chunk is encoded where it is read. A longer one is cut into overlapping chunks that are dealt
out and pre-tokenised apart. The pattern never looks back, so from any place where two neighbours both begin a
piece, they agree on all that follows; the first such place in their overlap is where they are stitched. Chunks
without one (a run longer than the overlap) are fused and go on as one. What lies between two stitches is then
encoded, again dealt out, and the ids of a text are put together in order. Decoding joins the bytes of the ids.

A stitch must also leave the text before it as it is when that is matched alone. It does where the character before
it is no white space: every alternative that ends there has then ended for a reason other than what follows, except
for an apostrophe, whose contractions need two more characters; chunks trust nothing so near their own end.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import column, cut

#: Characters of a chunk, and of what it shares with the next.
CHUNK, OVERLAP = 32_768, 512
#: Characters at a chunk's end in which its boundaries are not trusted.
MARGIN = 4


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file with a base64 token and a rank in each line."""
    with open(path, "rb") as f:
        return _parse(f.read())


def _parse(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


@lru_cache(maxsize=2)
def _encoding(data: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_parse(data), special_tokens={})


@lru_cache(maxsize=2)
def _tokens(data: bytes) -> dict[int, bytes]:
    return {rank: token for token, rank in _parse(data).items()}


def boundaries(text: str, compiled, low: int, high: int) -> list[int]:
    """Starts of pieces in [low, high) of text that follow a character other than white space."""
    out = []
    for m in compiled.finditer(text):
        at = m.start()
        if at >= high:
            break
        if at >= low and at and not text[at - 1].isspace():
            out.append(at)
    return out


def _split(chunk: int, overlap: int):
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.string()), ("copies", pa.int64()), ("i", pa.int32()), ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, h, copies, text in zip(*(column(batch, c) for c in ("doc_id", "h", "copies", "text")), strict=True):
                text = text.as_py()
                starts = range(0, max(1, len(text) - overlap), chunk)
                for i, s in enumerate(starts):
                    last = i + 1 == len(starts)
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc.as_py(), "h": h.as_py(), "copies": copies.as_py(), "i": i, "start": s, "last": last, "text": text[s:] if last else text[s : s + chunk + overlap]}], schema)

    return run


def _pre_tokenise(pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)
        for batch in batches:
            head, tail = [], []
            for text, start, last in zip(column(batch, "text").to_pylist(), column(batch, "start").to_pylist(), column(batch, "last").to_pylist(), strict=True):
                found = boundaries(text, compiled, 0, len(text) if last else len(text) - MARGIN)
                head.append([start + x for x in found if x < overlap])
                tail.append([] if last else [start + x for x in found if x >= chunk])
            yield batch.append_column("head", pa.array(head, pa.list_(pa.int64()))).append_column("tail", pa.array(tail, pa.list_(pa.int64())))

    return run


def _encode(ranks, pattern: str, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _encoding(ranks.value, pattern)
        for batch in cut(batches):
            ids = [np.array(one.encode_ordinary(t), "<u4").tobytes() if t else b"" for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in keep), pa.array(ids, pa.binary())], [*keep, "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids of every row of docs (doc_id, text): ids as one binary value, little-endian unsigned 32-bit.

    path: the file of ranks, read by the driver and broadcast (its size does not depend on the documents).
    A null text is an empty one, which has no ids. Null doc_ids and repeated rows are kept, one result for each
    row; other columns are ignored; an empty table gives an empty result.
    """
    if overlap <= MARGIN or chunk <= overlap:
        raise ValueError("a chunk must be longer than its overlap, and that longer than the margin")
    with open(path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    fits = F.length("text") <= chunk + overlap
    short = rows.where(fits).mapInArrow(_encode(ranks, pattern, ("doc_id",)), "doc_id long, ids binary")

    long = rows.where(~fits).groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("h", F.sha2("text", 256))
    key = ("doc_id", "h", "copies")
    chunks = long.select(*key, "text").mapInArrow(_split(chunk, overlap), "doc_id long, h string, copies long, i int, start long, last boolean, text string")
    seen = chunks.repartition("doc_id", "h", "i").mapInArrow(_pre_tokenise(pattern, chunk, overlap), "doc_id long, h string, copies long, i int, start long, last boolean, text string, head array<long>, tail array<long>")
    order = Window.partitionBy(*key).orderBy("i")
    common = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    stitched = seen.withColumn("cut", common).withColumn("before", F.lag("cut").over(order)).withColumn("run", F.count("before").over(order))
    # a fused run: all but its last chunk give up what they share with the next
    part = F.struct("i", "start", F.when(F.col("cut").isNull() & ~F.col("last"), F.substring("text", 1, chunk)).otherwise(F.col("text")).alias("text"))
    runs = stitched.groupBy(*key, "run").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max("cut").alias("end"), F.min("before").alias("begin"))
    first = F.get("parts", F.lit(0))["start"]
    whole = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    skip = F.coalesce(F.col("begin") - first, F.lit(0)).cast("int")
    text = F.when(F.col("end").isNull(), F.substring(whole, skip + 1, F.length(whole))).otherwise(F.substring(whole, skip + 1, (F.col("end") - first).cast("int") - skip))
    pieces = runs.select(*key, "run", text.alias("text")).mapInArrow(_encode(ranks, pattern, (*key, "run")), "doc_id long, h string, copies long, run long, ids binary")
    joined = pieces.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("run", F.hex("ids").alias("ids")))).alias("all"))
    ids = F.unhex(F.array_join(F.transform("all", lambda r: r["ids"]), ""))
    return short.unionByName(joined.select("doc_id", F.explode(F.array_repeat(ids, F.col("copies").cast("int"))).alias("ids")))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) with the column decoded: the bytes of the ids, joined. Null ids give null; an id that the file lacks is an error."""
    with open(path, "rb") as f:
        ranks = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tokens(ranks.value).__getitem__
        for batch in cut(batches, "ids"):
            out = [None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in column(batch, "ids").to_pylist()]
            yield batch.append_column("decoded", pa.array(out, pa.binary()))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
