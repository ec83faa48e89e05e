"""Payloads: float vectors as FlatBuffers, raw-image geometry, encodings and message builders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, StructField, StructType

from stratalog.functions import tables
from stratalog.functions.columns import NS, as_float_vector, guard, split_stamp
from stratalog.functions.flatbuf import Field, decode_table, encode_table

#: Encoding -> (channels, bytes per channel, pixel type); fixed values of the raw-image schema.
ENCODINGS = {
    "rgb8": (3, 1, "uint8"),
    "bgr8": (3, 1, "uint8"),
    "8UC3": (3, 1, "uint8"),
    "rgba8": (4, 1, "uint8"),
    "bgra8": (4, 1, "uint8"),
    "mono8": (1, 1, "uint8"),
    "8UC1": (1, 1, "uint8"),
    "mono16": (1, 2, "uint16"),
    "16UC1": (1, 2, "uint16"),
    "32FC1": (1, 4, "float32"),
}
#: (pixel type, channels) -> encoding for images written without one; fixed values.
INFERRED = {("uint8", 1): "8UC1", ("uint8", 3): "8UC3", ("uint16", 1): "16UC1", ("float32", 1): "32FC1"}


#: Fields of the payload tables in order of their ids (fixed values of the schemas).
FLOAT_ARRAY = [Field("values", "floats")]
RAW_IMAGE = [Field("timestamp", "time"), Field("frame_id", "string"), Field("width", "u32"), Field("height", "u32"), Field("encoding", "string"), Field("step", "u32"), Field("data", "bytes")]
COMPRESSED_IMAGE = [Field("timestamp", "time"), Field("frame_id", "string"), Field("data", "bytes"), Field("format", "string")]
_RAW_TYPE = "struct<width:bigint,height:bigint,channels:int,dtype:string,encoding:string,frame_id:string,data:binary>"
_COMPRESSED_TYPE = "struct<format:string,frame_id:string,sec:bigint,nsec:bigint,data:binary>"


def encode_float_array(values: np.ndarray | list[float] | None) -> bytes:
    """A table with one float32 vector; None leaves the field out."""
    return encode_table(FLOAT_ARRAY, {"values": values})


def decode_float_array(data: bytes) -> np.ndarray | None:
    """The vector of a float-array buffer, by any writer; None if the field is missing."""
    return decode_table(FLOAT_ARRAY, data)["values"]


def encode_raw_image(pixels: np.ndarray, encoding: str = "", frame_id: str = "") -> bytes:
    """A raw-image table of packed rows; the encoding is inferred from pixel type and shape where none is given."""
    channels = 1 if pixels.ndim == 2 else 3
    name = encoding or INFERRED[str(pixels.dtype), channels]
    height, width = pixels.shape[:2]
    step = width * (1 if pixels.ndim == 2 else pixels.shape[2]) * pixels.itemsize
    return encode_table(RAW_IMAGE, {"frame_id": frame_id, "width": width, "height": height, "encoding": name, "step": step, "data": np.ascontiguousarray(pixels).tobytes()})


def encode_compressed_image(data: bytes, stamp_ns: int, image_format: str = "jpeg", frame_id: str = "") -> bytes:
    """A compressed-image table; the stamp is split into seconds and nanoseconds."""
    return encode_table(COMPRESSED_IMAGE, {"timestamp": divmod(stamp_ns, NS), "frame_id": frame_id, "data": data, "format": image_format})


def _float_arrays(column: pa.Array) -> pa.Array:
    return tables.decode(FLOAT_ARRAY, column)["values"]


def _raw_images(column: pa.Array) -> pa.Array:
    """Rows of raw-image tables as _RAW_TYPE; unknown encodings and geometries that do not fit their bytes raise."""
    t = tables.decode(RAW_IMAGE, column)
    valid = column.is_valid()
    names = pa.array(list(ENCODINGS), pa.string())
    code = pc.index_in(t["encoding"], names)
    if pc.any(pc.and_(valid, code.is_null())).as_py():
        raise NotImplementedError(f"unsupported encoding: {t['encoding'].filter(pc.and_(valid, code.is_null()))[0].as_py()}")
    channels, size = (np.array([shape[i] for shape in ENCODINGS.values()], dtype=np.int64)[np.asarray(code.fill_null(0))] for i in (0, 1))
    width, height, step = (np.asarray(t[c].fill_null(0)) for c in ("width", "height", "step"))
    held = np.asarray(pc.binary_length(t["data"]).fill_null(0)).astype(np.int64)
    bad = np.asarray(valid) & ((step // (channels * size) != width) | (held != width * height * channels * size))
    if bad.any():
        i = int(np.argmax(bad))
        raise ValueError(f"rows of {step[i]} bytes and {held[i]} bytes of data do not hold {width[i]} x {height[i]} pixels")
    kinds = pa.array([kind for _, _, kind in ENCODINGS.values()], pa.string()).take(code)
    columns = [t["width"], t["height"], pa.array(channels.astype(np.int32)), kinds, t["encoding"], t["frame_id"], t["data"]]
    return pa.StructArray.from_arrays(columns, ["width", "height", "channels", "dtype", "encoding", "frame_id", "data"], mask=pc.invert(valid))


def _compressed_images(column: pa.Array, formats: tuple[str, ...] | None = None) -> pa.Array:
    """Rows of compressed-image tables as _COMPRESSED_TYPE; a format that is not among ``formats`` raises (None: any will do)."""
    t = tables.decode(COMPRESSED_IMAGE, column)
    if formats is not None:
        odd = pc.and_(column.is_valid(), pc.invert(pc.is_in(t["format"], pa.array(formats, pa.string()))))
        if pc.any(odd).as_py():
            raise ValueError(f"expected a {' or '.join(formats)} image, not {t['format'].filter(odd)[0].as_py()}")
    columns = [t["format"], t["frame_id"], t["timestamp"].field("sec"), t["timestamp"].field("nsec"), t["data"]]
    return pa.StructArray.from_arrays(columns, ["format", "frame_id", "sec", "nsec", "data"], mask=column.is_null())


def payload_type(schema_name: str) -> str:
    """The Spark type that a payload decodes to, by the last part of its schema's name; unknown schemas raise."""
    kinds = {"FloatArray": "array<float>", "RawImage": _RAW_TYPE, "CompressedImage": _COMPRESSED_TYPE}
    short = schema_name.rpartition(".")[2]
    if short not in kinds:
        raise KeyError(f"no decoder for schema {schema_name!r}; known: {sorted(kinds)}")
    return kinds[short]


def decode_columns(df: DataFrame, schemas: dict[str, str], formats: tuple[str, ...] | None = ("jpeg",)) -> DataFrame:
    """``df`` with each named binary column decoded by its schema, in one pass over Arrow batches.

    Compressed images of other ``formats`` raise; with None any passes, its name beside its bytes.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    readers = {"FloatArray": _float_arrays, "RawImage": _raw_images, "CompressedImage": lambda column: _compressed_images(column, formats)}
    fields = [StructField(f.name, _parse_datatype_string(payload_type(schemas[f.name]))) if f.name in schemas else f for f in df.schema]
    kinds = {f.name: to_arrow_type(f.dataType) for f in fields if f.name in schemas}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = []
            for f in fields:
                col = batch.column(f.name)
                if f.name in schemas:
                    col = readers[schemas[f.name].rpartition(".")[2]](col).cast(kinds[f.name])
                cols.append(col)
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return df.mapInArrow(decode, StructType(fields))


def encode_compressed_images(df: DataFrame, data: str, stamp: str, image_format: str = "jpeg", frame_id: str = "") -> DataFrame:
    """``df`` with the image bytes in column ``data`` made compressed-image tables stamped with column ``stamp`` (nanoseconds)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = batch.column(data), batch.num_rows
            ns = np.asarray(batch.column(stamp).fill_null(0)).astype(np.int64)
            time = pa.StructArray.from_arrays([pa.array(ns // NS), pa.array(ns % NS)], ["sec", "nsec"])
            made = tables.encode(COMPRESSED_IMAGE, {"timestamp": time, "frame_id": pa.repeat(frame_id, n), "data": own.fill_null(b""), "format": pa.repeat(image_format, n)}, n)
            yield batch.set_column(batch.schema.get_field_index(data), data, pc.if_else(own.is_valid(), made, pa.scalar(None, pa.binary())))

    return df.mapInArrow(encode, df.schema)


def encode_raw_images(df: DataFrame, image: str) -> DataFrame:
    """``df`` with column ``image``, the payload struct of raw_image(), made raw-image tables; null stays null."""
    fields = ["frame_id", "width", "height", "encoding", "step", "data"]
    schema = StructType([StructField(f.name, BinaryType()) if f.name == image else f for f in df.schema])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(image)
            made = tables.encode(RAW_IMAGE, {f: pc.struct_field(own, f) for f in fields}, batch.num_rows)
            yield batch.set_column(batch.schema.get_field_index(image), image, pc.if_else(own.is_valid(), made, pa.scalar(None, pa.binary())))

    return df.mapInArrow(encode, schema)


@F.arrow_udf(ArrayType(FloatType()))
def decode_float_arrays(data: pa.Array) -> pa.Array:
    return _float_arrays(data)


@F.arrow_udf(BinaryType())
def encode_float_arrays(values: pa.Array) -> pa.Array:
    return tables.encode(FLOAT_ARRAY, {"values": values}, len(values))


def encoding_shape(encoding: Column) -> Column:
    """struct<channels, itemsize, dtype> of an encoding; unknown ones raise."""
    chain = None
    for name, (channels, size, kind) in ENCODINGS.items():
        value = F.struct(F.lit(channels).alias("channels"), F.lit(size).alias("itemsize"), F.lit(kind).alias("dtype"))
        chain = F.when(encoding == name, value) if chain is None else chain.when(encoding == name, value)
    return chain.otherwise(F.raise_error(F.concat(F.lit("unsupported encoding: "), encoding)))


def infer_encoding(dtype: Column, dims: Column) -> Column:
    """The encoding of an image by pixel type and number of dimensions (2: one channel, else three); others raise."""
    channels = F.when(dims == 2, 1).otherwise(3)
    chain = None
    for (kind, n), name in INFERRED.items():
        hit = (dtype == kind) & (channels == n)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(F.raise_error(F.concat(F.lit("no encoding for "), dtype)))


def check_raw_images(images: DataFrame) -> DataFrame:
    """Rows of (width, height, step, encoding, data) with channels, itemsize and dtype added; padded rows raise.

    Row padding of a whole pixel or more makes step // (channels * itemsize) differ from width; padding below a pixel leaves
    data that is not height x width x channels x itemsize long. Both raise.
    """
    shaped = images.withColumn("shape", encoding_shape(F.col("encoding")))
    pixel = F.col("shape.channels") * F.col("shape.itemsize")
    ok = (F.floor(F.col("step") / pixel) == F.col("width")) & (F.length("data") == F.col("height") * F.col("width") * pixel)
    shaped = shaped.where(guard(ok, "image rows are padded"))
    return shaped.select(*images.columns, "shape.channels", "shape.itemsize", "shape.dtype")


def decode_raw_image(width: int, height: int, step: int, encoding: str, data: bytes) -> np.ndarray:
    """Pixels [height, width] or [height, width, channels]; unknown encodings and padded rows raise."""
    if encoding not in ENCODINGS:
        raise NotImplementedError(f"unsupported encoding: {encoding}")
    channels, size, kind = ENCODINGS[encoding]
    if step // (channels * size) != width:
        raise ValueError(f"rows of {step} bytes do not hold {width} pixels")
    flat = np.frombuffer(data, dtype=kind)
    return flat.reshape(height, width) if channels == 1 else flat.reshape(height, width, channels)


def pixel_rows(images: DataFrame) -> DataFrame:
    """Decode raw images to their pixels: a DataFrame of the input's columns with ``pixels`` array<double>, row-major.

    Unknown encodings and padded rows raise. Images of one encoding are decoded together.
    """
    names = [c for c in images.columns if c != "data"]
    schema = StructType([*(images.schema[n] for n in names), StructField("pixels", ArrayType(DoubleType()))])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            code = np.asarray(pc.index_in(batch.column("encoding"), pa.array(list(ENCODINGS), pa.string())).fill_null(-1))
            if n and code.min() < 0:
                raise NotImplementedError(f"unsupported encoding: {batch.column('encoding')[int(np.argmin(code))].as_py()}")
            parts, order = [], []
            for c in np.unique(code).tolist():
                rows = np.flatnonzero(code == c)
                channels, size, kind = list(ENCODINGS.values())[c]
                own = batch.take(pa.array(rows))
                raw = own.column("data").cast(pa.large_binary())
                held = np.asarray(pc.binary_length(raw)).astype(np.int64)
                width, height, step = (np.asarray(own.column(x)).astype(np.int64) for x in ("width", "height", "step"))
                if ((step // (channels * size) != width) | (held != width * height * channels * size)).any():
                    raise ValueError("image rows do not hold their pixels")
                data = raw.buffers()[2]
                flat = np.frombuffer(data, dtype=np.dtype(kind).newbyteorder("<"))[: int(held.sum()) // size] if data is not None and data.size else np.zeros(0)
                offsets = np.concatenate([[0], np.cumsum(held // size)]).astype(np.int32)
                parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.float64))))
                order.append(rows)
            if parts:
                back = np.empty(n, dtype=np.int64)
                back[np.concatenate(order)] = np.arange(n)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.concat_arrays(parts).take(pa.array(back))], schema.names)

    return images.mapInArrow(decode, schema)


def compressed_image(topic: Column, data: Column, publish_time: Column, log_time: Column, image_format: str = "jpeg", frame_id: str = "") -> Column:
    """A compressed-image message; its stamp is the publish time in seconds and nanoseconds."""
    return _message(topic, "foxglove.CompressedImage", publish_time, log_time, F.struct(F.lit(image_format).alias("format"), F.lit(frame_id).alias("frame_id"), split_stamp(publish_time).alias("timestamp"), data.alias("data")))


def raw_image(topic: Column, image: Column, publish_time: Column, log_time: Column, encoding: str = "", frame_id: str = "") -> Column:
    """A raw-image message from struct<width, height, channels, dtype, data>; the step is that of packed rows."""
    dims = F.when(image["channels"] == 1, 2).otherwise(3)
    name = F.lit(encoding) if encoding else infer_encoding(image["dtype"], dims)
    size = F.when(image["dtype"] == "uint8", 1).when(image["dtype"] == "uint16", 2).otherwise(4)
    step = image["width"] * image["channels"] * size
    payload = F.struct(F.lit(frame_id).alias("frame_id"), image["width"].alias("width"), image["height"].alias("height"), name.alias("encoding"), step.alias("step"), image["data"].alias("data"))
    return _message(topic, "foxglove.RawImage", publish_time, log_time, payload)


def float_array(topic: Column, values: Column, publish_time: Column, log_time: Column) -> Column:
    """A float-vector message; values are stored with 32 bits."""
    return _message(topic, "FloatArray", publish_time, log_time, F.struct(as_float_vector(values).alias("values")))


def _message(topic: Column, schema: str, publish_time: Column, log_time: Column, payload: Column) -> Column:
    return F.struct(topic.alias("topic"), F.lit(schema).alias("schema_name"), publish_time.alias("publish_time"), log_time.alias("log_time"), payload.alias("payload"))


#: Message builders by type name, as the writer dispatches them.
BUILDERS: dict[str, Callable[..., Column]] = {"array": float_array, "raw_image": raw_image, "compressed_image": compressed_image}


def add_message(kind: str, *args: Column, **options: str) -> Column:
    """The message column of a type by name; unknown types raise."""
    if kind not in BUILDERS:
        raise ValueError(f"unknown message type {kind!r}; known: {sorted(BUILDERS)}")
    return BUILDERS[kind](*args, **options)


def fan_out(records: DataFrame, ids: list[str], fields: list[str], topics: dict[str, str] | None = None) -> DataFrame:
    """One message per field of each record: ids, topic, value (the field's name where ``topics`` has no other)."""
    named = [F.col(f).cast("double").alias((topics or {}).get(f, f)) for f in fields]
    return records.select(*ids, *named).unpivot(ids, [(topics or {}).get(f, f) for f in fields], "topic", "value")
