"""Payload tables of whole columns: FlatBuffers tables read and written by offset arithmetic over Arrow buffers, without a call per row."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stratalog.functions.flatbuf import Field

#: Kinds whose values lie outside of the table, and the bytes of what lies inside.
_OUTSIDE, _SIZES = ("string", "bytes", "floats"), {"time": 8}


def _buffers(column: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """(the column with 64-bit offsets, its bytes, where each value begins, and the end)."""
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    return wide, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), offsets


class _Reader:
    """Little-endian integers at any byte of a buffer, for many places at once; none may reach beyond its row."""

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        self._data, self._ends = data, ends

    def at(self, places: np.ndarray, rows: np.ndarray, kind: str, starts: np.ndarray) -> np.ndarray:
        size = np.dtype(kind).itemsize
        if len(places) and ((places < starts[rows]) | (places + size > self._ends[rows])).any():
            raise ValueError("a payload table points beyond its bytes")
        if not len(places):
            return np.zeros(0, dtype=np.int64)
        view = np.ndarray((len(self._data) - size + 1,), dtype=kind, buffer=self._data, strides=(1,))
        return view[places].astype(np.int64)


def decode(fields: list[Field], column: pa.Array) -> dict[str, pa.Array]:
    """The fields of the root tables of a binary column, by any writer: missing ones are null, but 0 for u32; a null row is null everywhere.

    A time is a struct of seconds and nanoseconds.
    """
    wide, data, offsets = _buffers(column)
    n = len(wide)
    rows = np.flatnonzero(np.asarray(wide.is_valid()))
    starts, ends = offsets[:-1], offsets[1:]
    read = _Reader(data, ends)
    take = lambda places, who, kind: read.at(places, who, kind, starts)
    root = starts[rows] + take(starts[rows], rows, "<u4")
    vtable = root - take(root, rows, "<i4")
    size = take(vtable, rows, "<u2")
    out = {}
    for i, f in enumerate(fields):
        place = np.zeros(len(rows), dtype=np.int64)
        has = 4 + 2 * i + 2 <= size
        place[has] = take(vtable[has] + 4 + 2 * i, rows[has], "<u2")
        own = np.flatnonzero(place)
        at, who = root[own] + place[own], rows[own]
        if f.kind == "u32":
            values = np.zeros(n, dtype=np.int64)
            values[who] = take(at, who, "<u4")
            out[f.name] = pa.array(values, mask=~np.isin(np.arange(n), rows))
        elif f.kind == "time":
            absent = ~np.isin(np.arange(n), who)
            parts = np.zeros((2, n), dtype=np.int64)
            parts[0, who], parts[1, who] = take(at, who, "<u4"), take(at + 4, who, "<u4")
            out[f.name] = pa.StructArray.from_arrays([pa.array(parts[0], mask=absent), pa.array(parts[1], mask=absent)], ["sec", "nsec"], mask=pa.array(absent))
        else:
            at = at + take(at, who, "<u4")
            length = take(at, who, "<u4") * (4 if f.kind == "floats" else 1)
            begin = at + 4
            if (begin + length > ends[who]).any():
                raise ValueError("a payload table points beyond its bytes")
            out[f.name] = _slices(data, n, who, begin, length, f.kind)
    return out


def _slices(data: np.ndarray, n: int, who: np.ndarray, begin: np.ndarray, length: np.ndarray, kind: str) -> pa.Array:
    """Byte ranges of the rows ``who``, null elsewhere."""
    index = np.full(n, -1, dtype=np.int64)
    index[who] = np.arange(len(who))
    # Ranges and the gaps between them are one array over the buffer; every other value is taken. Rows lie in order, and so do their ranges.
    edges = np.column_stack([begin, begin + length]).ravel()
    whole = pa.Array.from_buffers(pa.large_binary(), max(0, len(edges) - 1), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
    picked = whole.take(pa.array(2 * index, mask=index < 0)) if len(edges) else pa.nulls(n, pa.large_binary())
    if kind == "bytes":
        return picked.cast(pa.binary())
    if kind == "string":
        return picked.cast(pa.large_string()).cast(pa.string())
    offsets = np.frombuffer(picked.buffers()[1], dtype=np.int64)[: n + 1] if n else np.zeros(1, dtype=np.int64)
    floats = np.frombuffer(picked.buffers()[2], dtype="<f4") if picked.buffers()[2] is not None and picked.buffers()[2].size else np.zeros(0, dtype="<f4")
    return pa.ListArray.from_arrays(pa.array((offsets // 4).astype(np.int32)), pa.array(floats[: offsets[-1] // 4]), mask=picked.is_null())


def encode(fields: list[Field], columns: dict[str, pa.Array], n: int) -> pa.Array:
    """A binary column of ``n`` root tables. Fields that are missing or null are left out; all null rows make empty tables.

    Rows that leave out the same fields are written together, byte for byte as one by one.
    """
    given = [f for f in fields if f.name in columns]
    present = np.column_stack([np.asarray(columns[f.name].is_valid()) for f in given]) if given else np.zeros((n, 0), dtype=bool)
    kinds, which = np.unique(present, axis=0, return_inverse=True) if n else (np.zeros((0, 0), dtype=bool), np.zeros(0, dtype=np.int64))
    which = np.ravel(which)
    parts, order = [], []
    for k, kind in enumerate(kinds):
        rows = np.flatnonzero(which == k)
        own = {f.name for f, has in zip(given, kind.tolist(), strict=True) if has}
        parts.append(_alike([(f, f.name in own) for f in fields], {c: columns[c].take(pa.array(rows)) for c in own}, len(rows)))
        order.append(rows)
    if not parts:
        return pa.array([], pa.binary())
    back = np.empty(n, dtype=np.int64)
    back[np.concatenate(order)] = np.arange(n)
    return pa.concat_arrays(parts).take(pa.array(back))


def _raw(column: pa.Array, kind: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(bytes of each value, their number, the length that is written before them)."""
    if kind == "floats":
        flat = column.flatten().cast(pa.float32())
        sizes = np.asarray(column.value_lengths()).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(4 * sizes)]).astype(np.int32)
        values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype("<f4")
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]), 4 * sizes, sizes
    raw = column.cast(pa.binary())
    sizes = np.asarray(pc.binary_length(raw)).astype(np.int64)
    return raw, sizes, sizes


def _alike(fields: list[tuple[Field, bool]], columns: dict[str, pa.Array], n: int) -> pa.Array:
    """Tables with the same fields present."""
    places, size = {}, 4
    for i, (f, has) in enumerate(fields):
        if has:
            places[i] = size
            size += _SIZES.get(f.kind, 4)
    last = max(places, default=-1) + 1
    vtable = struct.pack(f"<HH{last}H", 4 + 2 * last, size, *(places.get(i, 0) for i in range(last)))
    vtable += bytes(-len(vtable) % 4)
    start = 4 + len(vtable)
    head = np.zeros((n, start + size), dtype=np.uint8)
    head[:] = np.frombuffer(struct.pack("<I", start) + vtable + struct.pack("<i", len(vtable)) + bytes(size - 4), dtype=np.uint8)

    def put(at: int, values: np.ndarray) -> None:
        head[:, at : at + 4] = values.astype("<u4").view(np.uint8).reshape(n, 4)

    ends = np.full(n, start + size, dtype=np.int64)
    pieces: list[pa.Array] = []
    paddings = pa.array([b"\x00" * k for k in range(8)], pa.binary())
    for i, (f, has) in enumerate(fields):
        if not has:
            continue
        column, at = columns[f.name], start + places[i]
        if f.kind == "u32":
            put(at, np.asarray(column).astype(np.int64))
        elif f.kind == "time":
            put(at, np.asarray(column.field("sec")).astype(np.int64))
            put(at + 4, np.asarray(column.field("nsec")).astype(np.int64))
        else:
            raw, sizes, said = _raw(column, f.kind)
            put(at, ends - at)
            pad = (-(sizes + (f.kind == "string"))) % 4 + (f.kind == "string")
            pieces += [_fixed(np.ascontiguousarray(said.astype("<u4")).view(np.uint8).reshape(n, 4)), raw, paddings.take(pa.array(pad))]
            ends = ends + 4 + sizes + pad
    return pc.binary_join_element_wise(_fixed(head), *pieces, pa.scalar(b"", pa.binary()))


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes of one width as a binary array."""
    n, width = rows.shape
    offsets = (np.arange(n + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])
