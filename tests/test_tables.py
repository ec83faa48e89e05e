"""Payload tables of whole columns against one table at a time."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from stratalog.functions import payload, tables
from stratalog.functions.flatbuf import Field, decode_table, encode_table

KINDS = {
    "u32": (pa.int64(), hs.integers(0, 2**32 - 1)),
    "string": (pa.string(), hs.text(max_size=9)),
    "bytes": (pa.binary(), hs.binary(max_size=9)),
    "floats": (pa.list_(pa.float32()), hs.lists(hs.floats(width=32, allow_nan=False), max_size=5)),
    "time": (pa.struct([("sec", pa.int64()), ("nsec", pa.int64())]), hs.fixed_dictionaries({"sec": hs.integers(0, 2**32 - 1), "nsec": hs.integers(0, 10**9 - 1)})),
}


@hs.composite
def columns(draw):
    kinds = draw(hs.lists(hs.sampled_from(sorted(KINDS)), min_size=1, max_size=5))
    n = draw(hs.integers(0, 6))
    fields = [Field(f"f{i}", k) for i, k in enumerate(kinds)]
    return fields, {f.name: draw(hs.lists(hs.one_of(hs.none(), KINDS[f.kind][1]), min_size=n, max_size=n)) for f in fields}, n


def one_by_one(fields, values, n):
    return [encode_table(fields, {f.name: (v["sec"], v["nsec"]) if f.kind == "time" and (v := values[f.name][i]) is not None else values[f.name][i] for f in fields}) for i in range(n)]


@settings(max_examples=150, deadline=None)
@given(columns(), hs.integers(0, 3))
def test_columns_are_tables(given_columns, skipped):
    fields, values, n = given_columns
    arrays = {f.name: pa.array(values[f.name], KINDS[f.kind][0]) for f in fields}
    made = tables.encode(fields, arrays, n)
    want = one_by_one(fields, values, n)
    assert made.to_pylist() == want
    holed = pa.array([None, *want, None], pa.binary()).slice(min(skipped, n))
    got = tables.decode(fields, holed)
    for i, raw in enumerate(holed.to_pylist()):
        one = {} if raw is None else decode_table(fields, raw)
        for f in fields:
            v, w = got[f.name][i].as_py(), one.get(f.name)
            if f.kind == "time":
                w = w and {"sec": w[0], "nsec": w[1]}
            elif f.kind == "floats" and w is not None:
                w = w.tolist()
            assert v == w or (f.kind == "u32" and raw is None and v is None)


@settings(max_examples=200, deadline=None)
@given(hs.binary(max_size=40), hs.integers(0, 60), hs.integers(0, 255))
def test_broken_tables_never_read_beyond_their_row(junk, at, byte):
    good = encode_table(payload.FLOAT_ARRAY, {"values": [1.0, 2.0]})
    bad = bytearray(good)
    bad[at % len(bad)] = byte
    for raw in (junk, bytes(bad)):
        column = pa.array([good, raw, good], pa.binary())
        try:
            got = tables.decode(payload.FLOAT_ARRAY, column)["values"].to_pylist()
        except ValueError:
            continue
        assert got[0] == got[2] == [1.0, 2.0]


def test_raw_images_of_all_encodings():
    rng = np.random.default_rng(1)
    made, want = [], []
    for name, (channels, _, kind) in payload.ENCODINGS.items():
        pixels = rng.integers(0, 200, (2, 3) if channels == 1 else (2, 3, channels)).astype(kind)
        made.append(payload.encode_raw_image(pixels, name))
        want.append((name, channels, kind, pixels.tobytes()))
    got = payload._raw_images(pa.array([None, *made], pa.binary())).to_pylist()
    assert got[0] is None
    assert [(r["encoding"], r["channels"], r["dtype"], r["data"]) for r in got[1:]] == want
    broken = encode_table(payload.RAW_IMAGE, {"width": 3, "height": 2, "encoding": "mono8", "step": 4, "data": b"x" * 8})
    with pytest.raises(ValueError, match="do not hold"):
        payload._raw_images(pa.array([broken], pa.binary()))
    with pytest.raises(NotImplementedError, match="unsupported"):
        payload._raw_images(pa.array([encode_table(payload.RAW_IMAGE, {"encoding": "yuv"})], pa.binary()))


def test_compressed_images_of_any_format():
    made = [payload.encode_compressed_image(b"\x01\x02", 5_000_000_007, f) for f in ("jpeg", "png")]
    got = payload._compressed_images(pa.array([*made, None], pa.binary())).to_pylist()
    assert [r and (r["format"], r["sec"], r["nsec"], r["data"]) for r in got] == [("jpeg", 5, 7, b"\x01\x02"), ("png", 5, 7, b"\x01\x02"), None]
