"""Blocks of rows that ask the parts of a table, dealt by hash, and numbers packed for the way."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401  used as pa.ipc
from pyspark.sql import DataFrame


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of the model that has a hash; it grows with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def in_blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, int, pa.Table]]:
    """Blocks of rows in the order of the input, of ``limit`` bytes: number, sign and rows. A longer text is a block of its own.

    The last two columns are the size of a row's text, in bytes, and the number of the partition. A block must be cut alike whenever the documents are read; its sign, of the sizes of its texts, shows if it was not.
    """
    held, size, chunk, sign, where = [], 0, 0, 0, 0
    for batch in batches:
        sizes = batch.column(batch.num_columns - 2).to_pylist()
        where = batch.column(batch.num_columns - 1)[0].as_py() if batch.num_rows else where
        start = 0
        for i, n in enumerate(sizes):
            if size and size + n > limit:
                held.append(batch.slice(start, i - start))
                yield where << 32 | chunk, sign, pa.Table.from_batches(held)
                held, size, chunk, sign, start = [], 0, chunk + 1, 0, i
            size += n
            sign = (sign * 31 + n + 1) % (1 << 61)
        held.append(batch.slice(start))
    if held and sum(map(len, held)):
        yield where << 32 | chunk, sign, pa.Table.from_batches(held)


def pack_numbers(*arrays: tuple[np.ndarray, int]) -> bytes:
    """Arrays of whole numbers, the low bytes of each first, compressed; the second figure is the number of bytes of each."""
    raw = b"".join(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() for a, width in arrays)
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", 1).compress(raw, asbytes=True) if raw else b"")


class Unpacked:
    """Reads back what ``pack_numbers`` wrote."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:8], "little")
        self.raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], size, asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
        self.read = 0

    def take(self, n: int, width: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = self.raw[self.read : self.read + n * width].reshape(width, n).T
        self.read += n * width
        return out.view("<u8").ravel()


def pack_cells(values: np.ndarray) -> bytes:
    """Sorted whole numbers, evenly strewn and at least one, by the Rice code of their steps: within some hundredths of a bit of the least."""
    steps = np.diff(values)
    low = round(np.log2(max(1.0, 0.69 * float(steps.mean())))) if len(steps) else 0
    quotients = (steps >> np.uint64(low)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(steps), bool)
    unary[np.cumsum(quotients + 1) - 1] = True
    bits = [(steps >> np.uint64(i) & np.uint64(1)).astype(bool) for i in range(low)]
    return int(values[0]).to_bytes(8, "little") + bytes([low]) + np.packbits(np.concatenate([*bits, unary])).tobytes()


def unpack_cells(blob: bytes, n: int) -> np.ndarray:
    """Reads back the ``n`` numbers that ``pack_cells`` wrote."""
    low, bits = blob[8], np.unpackbits(np.frombuffer(blob, np.uint8, offset=9))
    steps = np.diff(np.flatnonzero(bits[low * (n - 1) :])[: n - 1], prepend=-1).astype(np.uint64) - np.uint64(1) << np.uint64(low)
    for i in range(low):
        steps |= bits[i * (n - 1) : (i + 1) * (n - 1)].astype(np.uint64) << np.uint64(i)
    return np.cumsum(np.concatenate([[np.uint64(int.from_bytes(blob[:8], "little"))], steps]), dtype=np.uint64)


def pack_blocks(rows: DataFrame, limit: int, change: Callable[[pa.Table], pa.Table] | None = None, level: int = 3) -> DataFrame:
    """``(block, sign, rows)``: the rows of each block of ``in_blocks``, or what ``change`` makes of them, in one compressed value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, sign, table in in_blocks(batches, limit):
            table = change(table) if change else table
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as writer:
                writer.write_table(table.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sign]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "sign", "rows"])

    return rows.mapInArrow(run, "block long, sign long, rows binary")


def unpack_rows(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(value).read_all()
