"""Packs: many rows in one value, so that blocks of rows meet by an ordinary join and are worked on as matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bytes of a pack; a single row may be larger.
PACK_BYTES = 4 << 20


def usable_vector(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def packed(df: DataFrame, most_rows: int, keys: list[str] | None = None) -> DataFrame:
    """keys, pack (unique number), rows, data: consecutive rows of a partition, most_rows at most and PACK_BYTES at most. With keys, the rows of a
    partition must be sorted by them, and a pack holds one key."""
    keys = keys or []
    types = dict(df.dtypes)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for b in batches:
            cuts = {0, b.num_rows}
            for k in keys:
                c = b.column(k)
                if b.num_rows > 1:
                    same = pc.or_(pc.fill_null(pc.equal(c[1:], c[:-1]), False), pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1])))
                    cuts |= set((np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist())
            ends = sorted(cuts)
            for lo, hi in zip(ends, ends[1:], strict=False):
                yield tuple(b.column(k)[lo].as_py() for k in keys), b.slice(lo, hi - lo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []
        now: tuple | None = None
        rows = size = 0

        def out() -> pa.RecordBatch:
            nonlocal number, rows, size
            whole = pa.Table.from_batches(held).combine_chunks().drop_columns(keys).to_batches()[0]
            values = [*now, number, rows, to_bytes(whole)]
            kinds = [held[0].schema.field(k).type for k in keys] + [pa.int64(), pa.int32(), pa.binary()]
            held.clear()
            number, rows, size = number + 1, 0, 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [*keys, "pack", "rows", "data"])

        for key, piece in pieces(batches):
            if held and key != now:
                yield out()
            now, at = key, 0
            width = max(1, piece.nbytes // piece.num_rows)
            while at < piece.num_rows:
                room = min(most_rows - rows, max(1 if not held else 0, (PACK_BYTES - size) // width))
                if room <= 0:
                    yield out()
                    continue
                part = piece.slice(at, room)
                held.append(part)
                rows, size, at = rows + part.num_rows, size + part.num_rows * width, at + part.num_rows
        if held:
            yield out()

    return df.mapInArrow(run, "".join(f"`{k}` {types[k]}, " for k in keys) + "pack long, rows int, data binary")


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """The vectors of a list column as rows; shorter ones are filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    d = max(int(sizes.max(initial=0)), width or 0)
    if (sizes == d).all():
        return flat.reshape(len(sizes), d)
    out = np.zeros((len(sizes), d))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def decoder(decode: Callable[[pa.RecordBatch], object]) -> Callable[[int, pa.Scalar], object]:
    """Decodes a pack by its number, and keeps the last one: a join gives the pairs of a pack one after the other."""
    last: dict[int, object] = {}

    def get(pack: int, data: pa.Scalar) -> object:
        if pack not in last:
            last.clear()
            last[pack] = decode(from_bytes(data.as_py()))
        return last[pack]

    return get
