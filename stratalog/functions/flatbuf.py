"""FlatBuffers tables of scalars, strings, byte and float vectors and inline structs, without a schema compiler."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Field:
    """A field's kind: u32, string, bytes, floats, or time (a struct of seconds and nanoseconds, both u32)."""

    name: str
    kind: str


def encode_table(fields: list[Field], values: dict[str, object]) -> bytes:
    """A buffer with one root table; fields that are missing or None are left out."""
    inline, places = bytearray(4), {}
    for i, f in enumerate(fields):
        if values.get(f.name) is None:
            continue
        places[i] = len(inline)
        inline += struct.pack("<II", *values[f.name]) if f.kind == "time" else struct.pack("<I", values[f.name] if f.kind == "u32" else 0)
    last = max(places, default=-1) + 1
    vtable = struct.pack(f"<HH{last}H", 4 + 2 * last, len(inline), *(places.get(i, 0) for i in range(last)))
    vtable += bytes(-len(vtable) % 4)
    start = 4 + len(vtable)
    inline[0:4] = struct.pack("<i", len(vtable))
    out = bytearray(struct.pack("<I", start) + vtable + inline)
    for i, f in enumerate(fields):
        if i in places and f.kind in ("string", "bytes", "floats"):
            value = values[f.name]
            raw = value.encode() if f.kind == "string" else np.asarray(value, dtype="<f4").tobytes() if f.kind == "floats" else bytes(value)
            at = start + places[i]
            struct.pack_into("<I", out, at, len(out) - at)
            out += struct.pack("<I", len(raw) // 4 if f.kind == "floats" else len(raw)) + raw + (b"\x00" if f.kind == "string" else b"")
            out += bytes(-len(out) % 4)
    return bytes(out)


def decode_table(fields: list[Field], data: bytes) -> dict[str, object]:
    """The fields of the root table, by any writer; missing ones are None (0 for u32, as the format has it)."""
    root = struct.unpack_from("<I", data, 0)[0]
    vtable = root - struct.unpack_from("<i", data, root)[0]
    size = struct.unpack_from("<H", data, vtable)[0]
    out: dict[str, object] = {}
    for i, f in enumerate(fields):
        place = struct.unpack_from("<H", data, vtable + 4 + 2 * i)[0] if 4 + 2 * i + 2 <= size else 0
        if not place:
            out[f.name] = 0 if f.kind == "u32" else None
            continue
        at = root + place
        if f.kind == "u32":
            out[f.name] = struct.unpack_from("<I", data, at)[0]
        elif f.kind == "time":
            out[f.name] = struct.unpack_from("<II", data, at)
        else:
            at += struct.unpack_from("<I", data, at)[0]
            n = struct.unpack_from("<I", data, at)[0]
            if f.kind == "floats":
                out[f.name] = np.frombuffer(data, dtype="<f4", count=n, offset=at + 4)
            else:
                raw = bytes(data[at + 4 : at + 4 + n])
                out[f.name] = raw.decode() if f.kind == "string" else raw
    return out
