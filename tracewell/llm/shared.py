"""What the operators share: written tables that cut lineage, and packed exchanges.

A packed exchange moves (key, payload...) entries between tasks as a few binary
columns: each task sorts its entries by bucket and writes one row per bucket it
has entries for, so Spark shuffles few rows and tasks work on NumPy arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.storage import keep, shared_dir  # noqa: F401

#: Entries that one bucket of a packed exchange should hold.
BUCKET_ENTRIES = 400_000


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in all rows, by which exchanges choose their number of buckets."""
    return docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def bucket_count(entries: float, least: int = 12) -> int:
    return max(least, int(np.ceil(entries / BUCKET_ENTRIES)))


def tree_sum(parts: DataFrame, read: Callable, write: Callable, zero: np.ndarray, fan: int = 16) -> np.ndarray:
    """Sum of the arrays that the rows of a one-column table hold, each task's rows at once.

    Tasks add up the arrays of ``fan`` others until one is left, which alone reaches the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total = read(raw, zero.dtype) if total is None else total + read(raw, zero.dtype)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([write(total)], pa.binary())], names=[name])

    name, tasks = parts.columns[0], parts.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // fan)
        parts = parts.repartition(tasks).mapInArrow(add, f"{name} binary")
    found = parts.collect()
    return read(bytes(found[0][0]), zero.dtype).reshape(zero.shape) if found else zero


_packer, _unpacker = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def code(values: np.ndarray) -> bytes:
    """Integers as differences, byte planes apart, compressed: near-sorted ones shrink to a byte or less each."""
    step = np.diff(values, prepend=values.dtype.type(0))
    planes = step.view(np.uint8).reshape(len(values), values.itemsize).T
    return _packer.compress(planes.tobytes())


def decode(raw: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(_unpacker.decompress(raw), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.cumsum(np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel(), dtype=dtype)


def pack(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """One row per bucket present: its number and, for each column, its entries in order.

    Unsigned columns are hashes and stay raw bytes; signed ones are coded.
    """
    if not len(bucket):
        return None
    order = np.argsort(bucket.astype(np.int16) if bucket.max() < 2**15 else bucket, kind="stable")
    sorted_bucket = bucket[order]
    starts = np.flatnonzero(np.r_[True, sorted_bucket[1:] != sorted_bucket[:-1]])
    ends = np.r_[starts[1:], len(order)]
    arrays = [pa.array(sorted_bucket[starts].astype(np.int64))]
    for values in columns.values():
        values = values[order]
        form = code if values.dtype.kind == "i" else np.ndarray.tobytes
        arrays.append(pa.array([form(values[s:e]) for s, e in zip(starts, ends)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *columns])


def packed_schema(*columns: str) -> str:
    return ", ".join(["bucket long", *(f"{c} binary" for c in columns)])


def unpack(table: pa.Table | pa.RecordBatch, column: str, dtype) -> np.ndarray:
    parts = table.column(column).to_pylist()
    if np.dtype(dtype).kind == "i":
        return np.concatenate([decode(p, dtype) for p in parts]) if parts else np.empty(0, dtype)
    return np.frombuffer(b"".join(parts), dtype=dtype)


def bucketed_rows(df: DataFrame, buckets: int) -> DataFrame:
    """(bucket, rows): rows of df as compressed Arrow blobs by doc_id modulo ``buckets`` (null doc_ids by their text).

    For exchanges of whole texts, which shuffle blocks alone compress less.
    """
    keyed = df.withColumn("bucket", F.pmod(F.coalesce("doc_id", F.xxhash64("text")), F.lit(buckets)))

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = np.array(batch.column(batch.num_columns - 1))
            order = np.argsort(bucket, kind="stable")
            start, _ = runs(bucket[order])
            rows = batch.drop_columns(["bucket"])
            out = []
            for s, e in zip(start.tolist(), np.r_[start[1:], len(order)].tolist()):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                    writer.write_batch(rows.take(pa.array(order[s:e])))
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order[start]].astype(np.int64)), pa.array(out, pa.binary())], names=["bucket", "rows"])

    return keyed.mapInArrow(blobs, "bucket long, rows binary")


def rows_of(table: pa.Table) -> pa.Table | None:
    """The rows of a group of ``bucketed_rows``; None if there are none."""
    parts = [pa.ipc.open_stream(b).read_all() for b in table.column("rows").to_pylist()]
    return pa.concat_tables(parts) if parts else None


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal keys, and for each entry the number of its run."""
    if not len(sorted_keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
    return np.flatnonzero(first), np.cumsum(first) - 1


def batches_of(found: Iterable[pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        if batch is not None and batch.num_rows:
            yield batch


def empty_table(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()
