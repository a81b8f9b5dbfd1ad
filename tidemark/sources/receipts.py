"""Raw responses kept as receipts: converted to compressed payloads, opened again, and read back into tables that lost rows.

A receipt is a row of sha256 (the address: the digest of the plain payload), payload (binary), encoding (plain or zstd),
and what is known of the request. Payloads are handled in tasks, a batch at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.quality import require_empty
from tidemark.sources.raw import mapped
from tidemark.sources.tables import absent, cut, keep_one

LEVEL = 10


def _each_payload(df: DataFrame, change) -> DataFrame:
    """df with every payload changed by a function of payload and encoding (null stays null)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("payload")
            payloads, encodings = batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index("encoding")).to_pylist()
            new = [None if p is None else change(bytes(p), e) for p, e in zip(payloads, encodings, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(new, pa.binary()), *batch.columns[at + 1 :]], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def _unzipped(payload: bytes, encoding: str) -> bytes:
    import zstandard

    if encoding != "zstd":
        return payload
    with zstandard.ZstdDecompressor().stream_reader(payload) as r:
        return r.read()


def _zipped(payload: bytes, encoding: str) -> bytes:
    import zstandard

    if encoding == "zstd":
        return payload
    out = zstandard.ZstdCompressor(level=LEVEL).compress(payload)
    if _unzipped(out, "zstd") != payload:
        raise ValueError("a payload did not survive compression")
    return out


def compressed(receipts: DataFrame) -> DataFrame:
    """receipts with plain payloads compressed, each checked by decompressing it. A plain payload that does not hash to its address, or is null, stays as it is, with fault ADDRESS."""
    plain = F.coalesce(F.col("encoding"), F.lit("plain")) != "zstd"
    wrong = plain & ~F.coalesce(F.sha2("payload", 256) == F.col("sha256"), F.lit(False))
    rows = receipts.withColumn("fault", F.when(wrong, "ADDRESS"))
    rest = rows.where(plain & F.col("fault").isNull())
    return rows.where(~(plain & F.col("fault").isNull())).unionByName(_each_payload(rest, _zipped).withColumn("encoding", F.lit("zstd")))


def opened(receipts: DataFrame) -> DataFrame:
    """receipts with plain payloads; one that does not hash to its address is an error when it is read."""
    out = _each_payload(receipts, _unzipped)
    right = F.coalesce(F.sha2("payload", 256) == F.col("sha256"), F.lit(False))
    return out.withColumn("payload", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("a payload does not match its address "), F.coalesce("sha256", F.lit("null")))))).withColumn("encoding", F.lit("plain"))


def backfill(receipts: DataFrame, schema: str, stored: DataFrame, expected: DataFrame, key: str, clock: str, now: Column, wanted: Column) -> DataFrame:
    """Rows to append to stored: records of the receipts that `wanted` picks, with clock, the time of the receipt.

    receipts: sha256, payload, encoding, http_status, received_at; a payload is {"data": [records]}. Responses other than 200
    carry no records. Keys found must be exactly those of expected; rows stored for such keys must all come from these
    receipts; a wanted record from after now, or a payload that is no such JSON, is an error. A record that several receipts of one
    time hold counts once. Doing it twice adds nothing.
    """
    good = opened(receipts.where("http_status = 200")).withColumn("_body", F.col("payload").cast("string"))
    read, bad = mapped(good.select("sha256", "received_at", "_body"), "_body", f"data array<struct<{schema}>>")
    require_empty(bad.select("sha256").unionByName(read.where("data IS NULL").select("sha256")), "payloads without a list of records")
    rows = cut(read.select(F.col("received_at").alias(clock), "sha256", F.inline("data")).where(wanted))  # the checks below read it again
    require_empty(rows.where(F.col(clock) > now).select("sha256"), "records of receipts from after now")
    rows = keep_one(rows, [key, clock], [F.col("sha256")]).drop("sha256")
    found, asked = rows.select(key).distinct(), expected.select(key).distinct()
    require_empty(found.join(asked, key, "full_outer").join(found.intersect(asked), key, "left_anti"), "keys that are not both found and expected")
    theirs = stored.join(asked, key, "left_semi").select(key, clock)
    require_empty(theirs.join(rows.select(key, clock), [key, clock], "left_anti"), "stored rows that did not come from these receipts")
    return absent(rows, stored, [key, clock])
