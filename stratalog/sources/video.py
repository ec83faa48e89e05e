"""Video attachments: frames encoded to one file per stream and decoded from it, with a codec as a parameter.

Stamps are this module's own work: they are made to rise, stored relative to the first, and restored exactly; frame counts are
checked and tails padded. What a stream's frames are (packed pixels, or image files of a format) and their geometry are taken from its
first frame, unless the codec has a geometry. Pixels are the codec's. ``RawCodec`` keeps frames as they are, compressed without loss; ``AvCodec`` makes
H.264 in MP4 and needs PyAV, which it imports when it is used.
"""

from __future__ import annotations

import ast
import io
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Mapping
from fractions import Fraction
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from stratalog.functions.columns import NS
from stratalog.operators.stamps import repair_step

#: Bytes of frames that a record batch holds, about.
BATCH_BYTES = 8 << 20
#: The kind of frames that are packed pixels; the kind of others is the format of their image files.
PIXELS = "pixels"
#: White space and comments in the header of a portable pixmap.
_GAP = rb"(?:\s|#[^\n]*\n)+"


class Codec(Protocol):
    """Frames of one stream to a file and back. ``comment`` is free text that the file carries."""

    def encode(self, frames: Iterator[tuple[int, bytes]], comment: str, time_base: int) -> bytes: ...

    def decode(self, data: bytes) -> tuple[str, int, Fraction, Iterator[tuple[int, bytes]]]:
        """(comment, announced frame count, time base, (pts, frame) in order)."""


def decode_ppm(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, rgb pixels) of a binary portable pixmap of 8 bits a channel."""
    head = re.match(rb"P6" + _GAP + rb"(\d+)" + _GAP + rb"(\d+)" + _GAP + rb"255\s", data)
    if head is None:
        raise ValueError("not a portable pixmap of 8 bits a channel")
    width, height = int(head[1]), int(head[2])
    if len(data) - head.end() != width * height * 3:
        raise ValueError("a portable pixmap of another size than it names")
    return width, height, data[head.end() :]


#: What makes (width, height, pixels) of an image file, by format. Other formats are given by the caller.
DECODERS: dict[str, Callable[[bytes], tuple[int, int, bytes]]] = {"ppm": decode_ppm}


class RawCodec:
    """Lossless frames behind a small header."""

    MAGIC = b"RAWFRAME"

    def encode(self, frames: Iterator[tuple[int, bytes]], comment: str, time_base: int) -> bytes:
        body = [struct.pack("<qI", pts, len(packed)) + packed for pts, packed in ((p, zlib.compress(f)) for p, f in frames)]
        head = comment.encode()
        return self.MAGIC + struct.pack("<IQQ", len(head), time_base, len(body)) + head + b"".join(body)

    def decode(self, data: bytes) -> tuple[str, int, Fraction, Iterator[tuple[int, bytes]]]:
        if not data.startswith(self.MAGIC):
            raise ValueError("not a raw frame file")
        size, time_base, count = struct.unpack_from("<IQQ", data, 8)
        comment = data[28 : 28 + size].decode()

        def frames() -> Iterator[tuple[int, bytes]]:
            at = 28 + size
            while at < len(data):
                pts, n = struct.unpack_from("<qI", data, at)
                yield pts, zlib.decompress(data[at + 12 : at + 12 + n])
                at += 12 + n

        return comment, count, Fraction(1, time_base), frames()


class AvCodec:
    """H.264 in MP4 through PyAV; frames are packed pixels of one format, of the given geometry or of that of a stream's first frame."""

    def __init__(self, width: int | None = None, height: int | None = None, pixels: str = "bgr24", preset: str = "fast", stream_format: str = "yuv420p") -> None:
        self.width, self.height, self.pixels, self.preset, self.stream_format = width, height, pixels, preset, stream_format

    def configured(self, width: int, height: int) -> AvCodec:
        """This codec for a stream whose first frame has this geometry."""
        return self if self.width else AvCodec(width, height, self.pixels, self.preset, self.stream_format)

    @staticmethod
    def _av() -> Any:
        try:
            import av
        except ImportError as e:
            raise RuntimeError("this codec needs the package av") from e
        return av

    def encode(self, frames: Iterator[tuple[int, bytes]], comment: str, time_base: int) -> bytes:
        av = self._av()
        import numpy as np

        out = io.BytesIO()
        container = av.open(out, mode="w", format="mp4")
        container.metadata["comment"] = comment
        stream = container.add_stream("h264", options={"preset": self.preset})
        stream.width, stream.height, stream.pix_fmt = self.width, self.height, self.stream_format
        stream.codec_context.time_base = Fraction(1, time_base)
        for pts, data in frames:
            frame = av.VideoFrame.from_ndarray(np.frombuffer(data, np.uint8).reshape(self.height, self.width, 3), format=self.pixels)
            frame.pts, frame.time_base = pts, Fraction(1, time_base)
            for packet in stream.encode(frame):
                container.mux(packet)
        for packet in stream.encode():
            container.mux(packet)
        container.close()
        return out.getvalue()

    def decode(self, data: bytes) -> tuple[str, int, Fraction, Iterator[tuple[int, bytes]]]:
        container = self._av().open(io.BytesIO(data))
        stream = container.streams.video[0]
        stream.thread_type = "AUTO"
        frames = ((f.pts, f.to_ndarray(format=self.pixels).tobytes()) for f in container.decode(stream))
        return container.metadata.get("comment", ""), stream.frames, Fraction(stream.time_base), frames


def parse_base_stamp(comment: str, ensure: bool = True) -> int:
    """base_stamp of a comment that is the text of a dict; missing is 0, or an error with ``ensure``."""
    try:
        found = ast.literal_eval(comment) if comment else {}
    except (ValueError, SyntaxError):
        found = {}
    value = found.get("base_stamp") if isinstance(found, dict) else None
    if value is None:
        if ensure:
            raise ValueError("the video has no base stamp")
        return 0
    return int(value)


def _described(kind: str | None, width: int | None, height: int | None, data: bytes, decoders: Mapping[str, Callable[[bytes], tuple[int, int, bytes]]]) -> tuple[str, int, int, bytes]:
    """(kind, width, height, pixels) of a frame."""
    if not kind:
        if not width or not height or width < 0 or height < 0 or not data or len(data) % (width * height):
            raise ValueError("packed pixels need a width and a height that divide them")
        return PIXELS, width, height, data
    if kind not in decoders:
        raise TypeError(f"frames of format {kind!r} have no decoder")
    return kind, *decoders[kind](data)


def encode_streams(frames: DataFrame, codec: Codec, time_base: int = NS, decoders: Mapping[str, Callable[[bytes], tuple[int, int, bytes]]] | None = None) -> DataFrame:
    """(stream, data, n_frames) from frames (stream, idx, stamp, data): one file per stream, frames in order of idx.

    A first stamp that is not positive raises; one that does not rise is set a thousandth of the time base beyond the one before.
    Frames are fed to the codec one by one from sorted partitions; what a task holds is the codec's output.

    Frames with the columns format, width and height are described: a format (null or empty: packed pixels of that width and
    height) names the decoder in ``decoders``, besides DECODERS, that makes pixels of the image file. A stream's kind and geometry
    are those of its first frame, for which a codec that has ``configured`` is set up; a later frame of another kind or geometry
    raises, as does a format without a decoder. kind, width and height are then returned too. No frames give no files.
    """
    known = DECODERS | dict(decoders or {})
    described = {"format", "width", "height"} <= set(frames.columns)
    columns = ["stream", "stamp", "data", *(["format", "width", "height"] if described else [])]
    configuration = [StructField("kind", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType())]
    schema = StructType([frames.schema["stream"], StructField("data", BinaryType()), StructField("n_frames", LongType()), *(configuration if described else [])])
    dealt = frames.select("idx", *columns).repartition("stream").sortWithinPartitions("stream", "idx")
    step = repair_step(time_base)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def frames_in() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("stream").type
                yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)

        rows = frames_in()
        pending = next(rows, None)
        while pending is not None:
            stream, base, count = pending[0], pending[1], 0
            if base is None or base <= 0:
                raise ValueError("the first stamp must be positive")
            first = _described(*pending[3:], pending[2], known)[:3] if described else ()
            own_codec = codec.configured(*first[1:]) if first and hasattr(codec, "configured") else codec

            def own() -> Iterator[tuple[int, bytes]]:
                nonlocal pending, count
                last = None
                while pending is not None and pending[0] == stream:  # noqa: B023
                    stamp, data = pending[1], pending[2]
                    if described:
                        *shape, data = _described(*pending[3:], data, known)
                        if tuple(shape) != first:  # noqa: B023
                            raise ValueError(f"a frame {tuple(shape)} in a stream of {first}")  # noqa: B023
                    last = stamp if last is None or stamp > last else last + step
                    yield last - base, data  # noqa: B023
                    count += 1  # noqa: B023
                    pending = next(rows, None)

            data = own_codec.encode(own(), str({"base_stamp": base}), time_base)
            more = [pa.array([v], t) for v, t in zip(first, (pa.string(), pa.int32(), pa.int32()), strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([stream], kind), pa.array([data], pa.binary()), pa.array([count], pa.int64()), *more], schema.names)

    return dealt.mapInArrow(encode, schema)


def decode_streams(videos: DataFrame, codec: Codec, indices: list[int] | None = None, tolerance: int = 0, ensure_base_stamp: bool = True, target_time_base: int = NS) -> DataFrame:
    """Frames (stream, idx, pts, data, padded) of videos (stream, data), all or those at the distinct ``indices``.

    pts is (base stamp + stored stamp) in the target time base, exactly (0 keeps the stream's own). Up to ``tolerance`` frames that
    the file announces but does not hold repeat its last one; a larger deficit, or a surplus, raises. Decoding stops after the
    last index.
    """
    wanted = None if indices is None else sorted(set(indices))
    if wanted is not None and (not wanted or wanted[0] < 0):
        raise ValueError("frame indexes are 0 or more, and one at least")
    schema = StructType([videos.schema["stream"], StructField("idx", LongType()), StructField("pts", LongType()), StructField("data", BinaryType()), StructField("padded", BooleanType())])

    def frames_of(data: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
        comment, count, unit, frames = codec.decode(data)
        base = parse_base_stamp(comment, ensure_base_stamp)
        if wanted is not None and wanted[-1] >= count:
            raise ValueError("frame index out of range")
        seen, last = 0, None
        for pts, frame in frames:
            at = (base + pts) * unit * target_time_base if target_time_base else Fraction(base + pts)
            last = (int(at), frame)
            if wanted is None or seen in wanted:
                yield seen, *last, False
            seen += 1
            if wanted is not None and seen > wanted[-1]:
                return
        if seen > count or count - seen > tolerance or (count > seen and last is None):
            raise ValueError(f"{seen} frames where {count} are announced")
        for i in range(seen, count):
            if wanted is None or i in wanted:
                yield i, *last, True

    def batch_of(stream: Any, rows: list[tuple[int, int, bytes, bool]], kind: pa.DataType) -> pa.RecordBatch:
        idx, pts, frames, padded = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([stream] * len(rows), kind), pa.array(idx), pa.array(pts), pa.array(frames, pa.binary()), pa.array(padded)], schema.names)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("stream").type
            for stream, data in zip(batch.column("stream").to_pylist(), batch.column("data").to_pylist(), strict=True):
                held, size = [], 0
                for row in frames_of(data):
                    held.append(row)
                    size += len(row[2])
                    if size >= BATCH_BYTES:
                        yield batch_of(stream, held, kind)
                        held, size = [], 0
                if held:
                    yield batch_of(stream, held, kind)

    return videos.select("stream", "data").mapInArrow(decode, schema)
