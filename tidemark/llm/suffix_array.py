"""Suffix-array dedup over bytes: a distributed difference-cover algorithm, for prefixes of `window` bytes.

Cover. Equal windows must have a sampled position at the same distance from their start. The textbook cover takes
two of three positions; here the content decides: every window has an anchor (see `anchored`), and the positions at
multiples of STEP before and after it are sampled, so each window has exactly one sample in its first STEP bytes.
Windows whose anchor occurs nowhere else are never sampled.
Sampled triples. The suffix at a sample is read as a triple of names; a name of a block is made of the triple of
names of its thirds, down to a few bytes. Nothing deeper than a window matters, so the recursion ends there and names
are 64-bit fingerprints rather than ranks. Spark sorts the triples; equal neighbours are samples that agree on all of
the window's bytes but the STEP - 1 at either end.
Remaining suffixes. The window that starts o bytes before a sample is o bytes, the sample's triple, and STEP - 1 - o
bytes. Samples with equal triples carry those bytes at both ends along, so their remaining suffixes are merged and
neighbours compared where the triples are sorted; a run of equal triples that goes beyond a batch hands its windows
on to be sorted by themselves.
Samples that a task finds equal in all bytes stay there, and one witness of them goes out, so a passage in very many
texts costs a row for each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.anchored import Units, array_of, by_bytes, candidates, shared_anchors, units_of
from tidemark.llm.common import column, cut, documents, mix, rolling, signed, spans, stage, window_min

WINDOW, GRAM, STEP = 400, 48, 32
#: Bytes of a block that is named by itself.
LEAF = 48
#: Bytes of text that one step looks at; smaller than elsewhere, as a window makes several arrays.
SLICE = 1_000_000
#: Bytes of text whose samples a task brings together before they go out.
TOGETHER = 16_000_000


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(mix(mix(a) + b) + c)


def _name(prefix, at: np.ndarray, size: int) -> np.ndarray:
    """Names of blocks of `size` bytes: of the triple of names of their thirds."""
    if size <= LEAF:
        return spans(prefix, at, at + size)
    return _triple(*_thirds(prefix, at, size))


def _thirds(prefix, at: np.ndarray, size: int) -> list[np.ndarray]:
    a, b = size // 3, 2 * size // 3
    return [_name(prefix, at, a), _name(prefix, at + a, b - a), _name(prefix, at + b, size - b)]


def _distance(units: Units, start: np.ndarray, shared: list[np.ndarray], window: int, k: int) -> np.ndarray:
    """Bytes from each candidate start to the first place of its anchor."""
    places = np.sort(np.concatenate([np.zeros(0, np.int64), *(first + np.unique(at) for first, at in zip(units.first, shared, strict=True))]))
    least = window_min(units.gram, window - k + 1)[start]
    at = np.searchsorted(places, start)
    todo = np.arange(len(start))
    while len(todo := todo[units.gram[places[at[todo]]] != least[todo]]):
        at[todo] += 1
    return places[at] - start


def _samples(window: int, k: int, step: int):
    core, side = window - step + 1, step - 1
    whole = (1 << step) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, most=TOGETHER):
            uids, shared = column(batch, "uid").to_numpy(), array_of(column(batch, "at"))
            parts = []
            for i, j, units in units_of(batch, by_bytes(k), SLICE):
                start = candidates(units, shared[i:j], window, k)
                if not len(start):
                    continue
                o = _distance(units, start, shared[i:j], window, k) % step
                mask = np.bincount(start + o, np.ldexp(1.0, o)).astype(np.int64)  # each start once: a bit for each distance
                p = np.flatnonzero(mask)
                mask = mask[p]
                prefix = rolling(units.buf)
                padded = np.concatenate([np.zeros(side, np.uint8), units.buf, np.zeros(side, np.uint8)])
                around = np.arange(side)
                ends = np.concatenate([padded[p[:, None] + around], padded[p[:, None] + side + core + around]], axis=1)
                row = units.row(p)
                parts.append((*_thirds(prefix, p, core), ends, i + row, p - units.first[row], mask))
            if not parts:
                continue
            n0, n1, n2, ends, row, at, mask = map(np.concatenate, zip(*parts, strict=True))
            e = np.where(mask == whole, _rows_hash(ends), mix(uids[row].view(np.uint64) + at.astype(np.uint64)))
            order = np.lexsort((e, n2, n1, n0))
            n0, n1, n2, e, row, at, mask = (x[order] for x in (n0, n1, n2, e, row, at, mask))
            ends = ends[order]
            new = np.concatenate([[True], (n0[1:] != n0[:-1]) | (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1]) | (e[1:] != e[:-1])])
            again = ~new
            again[:-1] |= ~new[1:]
            yield _table(n0[new], n1[new], n2[new], e[new], ends[new], uids[row[new]], at[new], mask[new], ~again[new])
            if again.any():
                far, near = np.log2(mask[again]).astype(np.int64), np.log2(mask[again] & -mask[again]).astype(np.int64)
                yield _known(uids[row[again]], at[again] - far, at[again] - near)

    return run


SCHEMA = "n0 long, n1 long, n2 long, e long, ends binary, uid long, at int, mask long, report boolean, lo int, hi int"
_ARROW = pa.schema([("n0", pa.int64()), ("n1", pa.int64()), ("n2", pa.int64()), ("e", pa.int64()), ("ends", pa.binary()), ("uid", pa.int64()), ("at", pa.int32()), ("mask", pa.int64()), ("report", pa.bool_()), ("lo", pa.int32()), ("hi", pa.int32())])


def _table(n0, n1, n2, e, ends, uid, at, mask, report) -> pa.RecordBatch:
    n, width = ends.shape
    binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ends))])
    none = pa.nulls(n, pa.int32())
    return pa.RecordBatch.from_arrays([*map(pa.array, (signed(n0), signed(n1), signed(n2), signed(e))), binary, pa.array(uid), pa.array(at.astype(np.int32)), pa.array(mask), pa.array(report), none, none], schema=_ARROW)


def _known(uid, lo, hi) -> pa.RecordBatch:
    """Texts and the first and last of neighbouring starts of repeated windows."""
    n = len(uid)
    given = {"uid": pa.array(uid), "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32))}
    return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in _ARROW], schema=_ARROW)


def _rows_hash(x: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes."""
    factor = np.multiply.accumulate(np.full(x.shape[1], 0x9E3779B97F4A7C15, np.uint64))
    return mix((x.astype(np.uint64) + np.uint64(1)) @ factor if x.shape[1] else np.zeros(len(x), np.uint64))


def _merged(ends: np.ndarray, run: np.ndarray, o: int, side: int) -> np.ndarray:
    """Hash of run and the bytes that the window o bytes before a sample has besides its core."""
    return mix(_rows_hash(ends[:, side - o : 2 * side - o]) + mix(run))


def _neighbours(step: int):
    """Compares the remaining suffixes of samples in the order of their triples; rows in and out as SCHEMA, n0 to n2 naming a window where it is handed on."""
    side = step - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            n0, n1, n2 = (column(batch, c).to_numpy().view(np.uint64) for c in ("n0", "n1", "n2"))
            new = np.concatenate([[True], (n0[1:] != n0[:-1]) | (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])])
            run_of = np.cumsum(new) - 1
            ends_at = (run_of == 0) | (run_of == run_of[-1])  # these may go on in other batches
            alone = np.bincount(run_of)[run_of] == 1
            uid, at, mask, report = (column(batch, c).to_numpy(False) for c in ("uid", "at", "mask", "report"))
            data = column(batch, "ends")
            first = np.frombuffer(data.buffers()[1], np.int32)[data.offset]
            ends = np.frombuffer(data.buffers()[2], np.uint8)[first : first + n * 2 * side].reshape(n, 2 * side)
            inner = np.flatnonzero(~alone & ~ends_at)
            low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            for o in range(step):
                rows = inner[(mask[inner] >> o) & 1 == 1]
                _, where, count = np.unique(_merged(ends[rows], run_of[rows].astype(np.uint64), o, side), return_inverse=True, return_counts=True)
                rows = rows[count[where] > 1]
                high[rows[high[rows] < 0]] = o
                low[rows] = o
            found = np.flatnonzero((low >= 0) & report.astype(bool))
            if len(found):
                yield _known(uid[found], at[found] - low[found], at[found] - high[found])
            open_ = np.flatnonzero(ends_at)
            core = _triple(n0[open_], n1[open_], n2[open_])
            for o in range(step):
                some = (mask[open_] >> o) & 1 == 1
                rows = open_[some]
                name = _merged(ends[rows], core[some], o, side)
                order = np.lexsort((name, core[some]))
                rows, name, key = rows[order], name[order], core[some][order]
                if not len(rows):
                    continue
                fresh = np.concatenate([[True], (name[1:] != name[:-1]) | (key[1:] != key[:-1])])
                again = ~fresh
                again[:-1] |= ~fresh[1:]
                zero = np.zeros(int(fresh.sum()), np.uint64)
                yield _table(key[fresh], name[fresh], zero + np.uint64(o), zero, np.zeros((len(zero), 0), np.uint8), uid[rows[fresh]], at[rows[fresh]] - o, mask[rows[fresh]], report[rows[fresh]].astype(bool) & ~again[fresh])
                told = rows[again & report[rows].astype(bool)]
                if len(told):
                    yield _known(uid[told], at[told] - o, at[told] - o)

    return run


def _equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports windows that equal a neighbour, in the order of their names; the last row of a batch waits for the next."""
    last: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.concat_batches([last, batch])
        a, b, c = (column(batch, x).to_numpy() for x in ("n0", "n1", "n2"))
        same = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (c[1:] == c[:-1])])
        twin = same.copy()
        twin[:-1] |= same[1:]
        twin &= column(batch, "report").to_numpy(False).astype(bool)
        uid, at = (column(batch, x).to_numpy()[twin] for x in ("uid", "at"))
        yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(at), pa.array(at)], ["uid", "lo", "hi"])
        last = batch.slice(batch.num_rows - 1)


def repeated_bytes(docs: DataFrame, window: int = WINDOW, k: int = GRAM, step: int = STEP) -> DataFrame:
    """uid and spans (lo, hi) of docs (uid, text): windows that start at lo and at hi are repeated, and hi - lo < step."""
    shared = shared_anchors(docs, by_bytes(k), window, k)
    rows = docs.select("uid", "text").join(shared, "uid")
    samples = stage(rows.mapInArrow(_samples(window, k, step), SCHEMA), "samples")
    triples = samples.where("n0 IS NOT NULL").drop("lo", "hi").repartitionByRange("n0", "n1", "n2", "e").sortWithinPartitions("n0", "n1", "n2", "e")
    met = stage(triples.mapInArrow(_neighbours(step), SCHEMA), "neighbours")
    windows = met.where("n0 IS NOT NULL").select("n0", "n1", "n2", "uid", "at", "report").repartitionByRange("n0", "n1", "n2").sortWithinPartitions("n0", "n1", "n2")
    found = samples.where("n0 IS NULL").select("uid", "lo", "hi").unionByName(met.where("n0 IS NULL").select("uid", "lo", "hi")).unionByName(windows.mapInArrow(_equal, "uid long, lo int, hi int"))
    return stage(found.groupBy("uid").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")), "spans")


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            size, gone, runs, kept = [], [], [], []
            for text, lo, hi in zip(column(batch, "text").to_pylist(), column(batch, "lo").to_pylist(), column(batch, "hi").to_pylist(), strict=True):
                data = text.encode()
                size.append(len(data))
                if not lo:
                    gone.append(0)
                    runs.append(0)
                    kept.append(data)
                    continue
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, np.array(lo), 1)
                np.add.at(edge, np.array(hi) + window, -1)
                covered = np.cumsum(edge)[:-1] > 0
                gone.append(int(covered.sum()))
                runs.append(int((covered[1:] & ~covered[:-1]).sum()) + int(covered[0]))
                kept.append(np.frombuffer(data, np.uint8)[~covered].tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def suffix_array_dedup(docs: DataFrame, window: int = WINDOW, k: int = GRAM, step: int = STEP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) of every row of docs (doc_id, text), as UTF-8.

    A byte is removed if a string of `window` bytes of its document covers it that also starts anywhere else, in the
    same document too; overlaps count, and strings are judged on the input. n_spans counts maximal removed runs. What
    is kept may cut a character. A null text is an empty one; null and repeated ids are documents like others, and
    rows repeated whole repeat each other. Other columns are ignored. A text is read whole, however long, by one task at a
    time; an empty table gives an empty result.
    """
    if not 0 < step <= 48 or window - step + 1 < k:
        raise ValueError("step must be 48 at most, and window - step + 1 not less than k")
    docs = documents(docs)
    found = repeated_bytes(docs, window, k, step)
    return docs.join(found, "uid", "left").mapInArrow(_cut(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
