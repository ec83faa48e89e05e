"""The MCAP container as bytes, after its public specification: a chunk-by-chunk writer, a reader of records, and one of byte ranges.

Chunks may be plain, zstd or (reading only, through Arrow) lz4. Files have chunk, message, attachment and metadata indexes, so a reader
of ranges takes the summary from the file's end and then the chunks and records that it wants only.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, BinaryIO

import pyarrow as pa

MAGIC = b"\x89MCAP0\r\n"
#: Record opcodes of the specification (fixed values).
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX = 1, 2, 3, 4, 5, 6, 7, 8
ATTACHMENT, ATTACHMENT_INDEX, STATISTICS, METADATA, METADATA_INDEX, SUMMARY_OFFSET, DATA_END = 9, 10, 11, 12, 13, 14, 15


@dataclass(frozen=True)
class Schema:
    id: int
    name: str
    encoding: str
    data: bytes


@dataclass(frozen=True)
class Channel:
    id: int
    schema_id: int
    topic: str
    message_encoding: str
    metadata: dict[str, str] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Message:
    channel_id: int
    sequence: int
    log_time: int
    publish_time: int
    data: bytes


@dataclass(frozen=True)
class Attachment:
    log_time: int
    create_time: int
    name: str
    media_type: str
    data: bytes


@dataclass(frozen=True)
class Metadata:
    name: str
    metadata: dict[str, str] = field(hash=False)


@dataclass(frozen=True)
class Statistics:
    message_count: int
    channel_message_counts: dict[int, int] = field(hash=False)


def _text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<I", len(raw)) + raw


def _map(values: dict[str, str]) -> bytes:
    body = b"".join(_text(k) + _text(v) for k, v in sorted(values.items()))
    return struct.pack("<I", len(body)) + body


def _record(opcode: int, body: bytes) -> bytes:
    return struct.pack("<BQ", opcode, len(body)) + body


class _Cursor:
    def __init__(self, data: bytes | memoryview) -> None:
        self.data, self.at = memoryview(data), 0

    def take(self, form: str) -> int:
        (value,) = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return value

    def raw(self, n: int) -> bytes:
        out = bytes(self.data[self.at : self.at + n])
        if len(out) < n:
            raise ValueError("truncated MCAP record")
        self.at += n
        return out

    def text(self) -> str:
        return self.raw(self.take("I")).decode()

    def map(self) -> dict[str, str]:
        end = self.take("I") + self.at
        out = {}
        while self.at < end:
            key = self.text()
            out[key] = self.text()
        return out


def _unpressed(kind: str, data: bytes, size: int) -> bytes:
    if not kind:
        return data
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    if kind == "lz4":
        return pa.decompress(data, decompressed_size=size, codec="lz4", asbytes=True)
    raise ValueError(f"unknown chunk compression {kind!r}")


def _records(data: bytes | memoryview, start: int, end: int) -> Iterator[tuple[int, memoryview]]:
    view, at = memoryview(data), start
    while at < end:
        opcode, size = struct.unpack_from("<BQ", view, at)
        at += 9
        if at + size > end:
            raise ValueError("truncated MCAP record")
        yield opcode, view[at : at + size]
        at += size


def _decoded(opcode: int, body: memoryview) -> Any:  # noqa: ANN401
    c = _Cursor(body)
    if opcode == SCHEMA:
        return Schema(c.take("H"), c.text(), c.text(), c.raw(c.take("I")))
    if opcode == CHANNEL:
        return Channel(c.take("H"), c.take("H"), c.text(), c.text(), c.map())
    if opcode == MESSAGE:
        return Message(c.take("H"), c.take("I"), c.take("Q"), c.take("Q"), bytes(body[c.at :]))
    if opcode == ATTACHMENT:
        return Attachment(c.take("Q"), c.take("Q"), c.text(), c.text(), c.raw(c.take("Q")))
    if opcode == METADATA:
        return Metadata(c.text(), c.map())
    if opcode == STATISTICS:
        total = c.take("Q")
        c.raw(2 + 4 * 4 + 2 * 8)
        end = c.take("I") + c.at
        counts = {}
        while c.at < end:
            key = c.take("H")
            counts[key] = c.take("Q")
        return Statistics(total, counts)
    if opcode == CHUNK_INDEX:
        head = [c.take("Q") for _ in range(4)]
        end, places = c.take("I") + c.at, {}
        while c.at < end:
            key = c.take("H")
            places[key] = c.take("Q")
        return ChunkIndex(*head, places, c.take("Q"), c.text(), c.take("Q"), c.take("Q"))
    if opcode == ATTACHMENT_INDEX:
        return AttachmentIndex(c.take("Q"), c.take("Q"), c.take("Q"), c.take("Q"), c.take("Q"), c.text(), c.text())
    if opcode == METADATA_INDEX:
        return MetadataIndex(c.take("Q"), c.take("Q"), c.text())
    return None


def _check(data: bytes | memoryview) -> None:
    if len(data) < 2 * len(MAGIC) or data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a complete MCAP file")


def read_summary(data: bytes | memoryview) -> list:
    """Schemas, channels and statistics of the summary section; empty if the file has none."""
    _check(data)
    footer = len(data) - 8 - 29
    opcode, size = struct.unpack_from("<BQ", data, footer)
    if opcode != FOOTER or size != 20:
        raise ValueError("MCAP file without footer")
    start, offsets = struct.unpack_from("<QQ", data, footer + 9)
    if not start:
        return []
    found = (_decoded(op, body) for op, body in _records(data, start, offsets or footer))
    return [x for x in found if isinstance(x, (Schema, Channel, Statistics))]


def read_records(data: bytes | memoryview) -> Iterator[Schema | Channel | Message | Attachment | Metadata]:
    """Records of the data section in file order, chunks opened."""
    _check(data)
    for opcode, body in _records(data, 8, len(data) - 8):
        if opcode == DATA_END:
            return
        if opcode == CHUNK:
            for op, part in _chunk_records(bytes(body)):
                if op in (SCHEMA, CHANNEL, MESSAGE):
                    yield _decoded(op, part)
        elif opcode in (SCHEMA, CHANNEL, MESSAGE, ATTACHMENT, METADATA):
            yield _decoded(opcode, body)


@dataclass(frozen=True)
class ChunkIndex:
    """Where a chunk lies, what times it spans and where its message indexes lie, by channel."""

    start_time: int
    end_time: int
    offset: int
    length: int
    index_offsets: dict[int, int] = field(hash=False)
    index_length: int = 0
    compression: str = ""
    compressed_size: int = 0
    size: int = 0


@dataclass(frozen=True)
class AttachmentIndex:
    offset: int
    length: int
    log_time: int
    create_time: int
    size: int
    name: str
    media_type: str


@dataclass(frozen=True)
class MetadataIndex:
    offset: int
    length: int
    name: str


def _numbers(values: dict[int, int]) -> bytes:
    body = b"".join(struct.pack("<HQ", k, v) for k, v in sorted(values.items()))
    return struct.pack("<I", len(body)) + body


@dataclass(frozen=True)
class Chunk:
    """Messages of a chunk as they lie in the file: the chunk's record, its message indexes, and what the summary says of it."""

    record: bytes
    indexes: dict[int, bytes] = field(hash=False)
    counts: dict[int, int] = field(hash=False)
    start_time: int
    end_time: int
    compression: str
    compressed_size: int
    size: int


class ChunkBuilder:
    """Messages in order of time up to a size, one after the other."""

    def __init__(self, compression: str = "zstd") -> None:
        self._compression = compression
        self._rows: list[bytes] = []
        self._index: dict[int, list[tuple[int, int]]] = {}
        self.size = 0

    def add(self, channel: int, sequence: int, log_time: int, publish_time: int, data: bytes) -> None:
        if not 0 <= sequence < 1 << 32:
            raise ValueError(f"sequence {sequence} does not fit in the 32 bits that the format has for it")
        row = _record(MESSAGE, struct.pack("<HIQQ", channel, sequence, log_time, publish_time) + data)
        self._index.setdefault(channel, []).append((log_time, self.size))
        self._rows.append(row)
        self.size += len(row)

    def build(self) -> Chunk:
        inner = b"".join(self._rows)
        pressed = inner
        if self._compression == "zstd":
            import zstandard

            pressed = zstandard.ZstdCompressor().compress(inner)
        times = [t for own in self._index.values() for t, _ in own]
        body = struct.pack("<QQQI", min(times), max(times), len(inner), zlib.crc32(inner)) + _text(self._compression) + struct.pack("<Q", len(pressed)) + pressed
        indexes = {}
        for channel, own in sorted(self._index.items()):
            entries = b"".join(struct.pack("<QQ", *entry) for entry in own)
            indexes[channel] = _record(MESSAGE_INDEX, struct.pack("<HI", channel, len(entries)) + entries)
        return Chunk(_record(CHUNK, body), indexes, {c: len(own) for c, own in self._index.items()}, min(times), max(times), self._compression, len(pressed), len(inner))


class Writer:
    """Writes one file chunk by chunk, to a stream with write() or, without one, to memory. Ids are handed out in order of registration, from 1.

    A chunk closes at ``chunk_bytes``. ``by_topic`` gives each channel chunks of its own, so that reading a topic reads its share of the
    file only; else messages stay in the order in which they are added.
    """

    def __init__(self, compression: str = "zstd", profile: str = "", library: str = "stratalog", out: BinaryIO | None = None, chunk_bytes: int = 4 << 20, by_topic: bool = False) -> None:
        self._compression, self._chunk_bytes, self._by_topic = compression, chunk_bytes, by_topic
        self._memory = io.BytesIO() if out is None else None
        self._out: BinaryIO = self._memory if out is None else out
        self.size = 0
        self._schemas: dict[str, Schema] = {}
        self._channels: dict[str, Channel] = {}
        self._open: dict[int, ChunkBuilder] = {}
        self._counts: dict[int, int] = {}
        self._index: tuple[list[bytes], list[bytes], list[bytes]] = ([], [], [])
        self._times: tuple[int, int] | None = None
        self._put(MAGIC)
        self._put(_record(HEADER, _text(profile) + _text(library)))

    def _put(self, data: bytes) -> int:
        """Write, and say where it begins."""
        self._out.write(data)
        self.size += len(data)
        return self.size - len(data)

    def register_schema(self, name: str, encoding: str = "flatbuffer", data: bytes = b"") -> int:
        if name not in self._schemas:
            self._schemas[name] = schema = Schema(len(self._schemas) + 1, name, encoding, data)
            self._put(self._schema(schema))
        return self._schemas[name].id

    def register_channel(self, topic: str, schema: str | None, strict: bool = True, message_encoding: str = "flatbuffer", metadata: dict[str, str] | None = None) -> int:
        """The channel's id; a known topic raises if ``strict``, and otherwise has its id given back. Without a schema its number is 0."""
        if topic in self._channels:
            if strict:
                raise ValueError(f"channel {topic!r} exists")
            return self._channels[topic].id
        self._channels[topic] = channel = Channel(len(self._channels) + 1, 0 if schema is None else self.register_schema(schema), topic, message_encoding, metadata or {})
        self._put(self._channel(channel))
        return channel.id

    def add_message(self, topic: str, data: bytes, log_time: int, publish_time: int, sequence: int = 0) -> None:
        channel = self._channels[topic].id
        key = channel if self._by_topic else 0
        chunk = self._open.setdefault(key, ChunkBuilder(self._compression))
        chunk.add(channel, sequence, log_time, publish_time, data)
        if chunk.size >= self._chunk_bytes:
            self.add_chunk(self._open.pop(key).build())

    def add_chunk(self, chunk: Chunk) -> None:
        """A chunk that was built elsewhere, for this file's channels."""
        at = self._put(chunk.record)
        places = {channel: self._put(record) for channel, record in sorted(chunk.indexes.items())}
        length = self.size - at - len(chunk.record)
        body = struct.pack("<QQQQ", chunk.start_time, chunk.end_time, at, len(chunk.record)) + _numbers(places)
        self._index[0].append(_record(CHUNK_INDEX, body + struct.pack("<Q", length) + _text(chunk.compression) + struct.pack("<QQ", chunk.compressed_size, chunk.size)))
        first, last = self._times or (chunk.start_time, chunk.end_time)
        self._times = min(first, chunk.start_time), max(last, chunk.end_time)
        for channel, n in chunk.counts.items():
            self._counts[channel] = self._counts.get(channel, 0) + n

    def add_attachment(self, a: Attachment) -> None:
        body = struct.pack("<QQ", a.log_time, a.create_time) + _text(a.name) + _text(a.media_type) + struct.pack("<Q", len(a.data)) + a.data
        record = _record(ATTACHMENT, body + struct.pack("<I", zlib.crc32(body)))
        at = self._put(record)
        self._index[1].append(_record(ATTACHMENT_INDEX, struct.pack("<QQQQQ", at, len(record), a.log_time, a.create_time, len(a.data)) + _text(a.name) + _text(a.media_type)))

    def add_metadata(self, m: Metadata) -> None:
        record = _record(METADATA, _text(m.name) + _map(m.metadata))
        at = self._put(record)
        self._index[2].append(_record(METADATA_INDEX, struct.pack("<QQ", at, len(record)) + _text(m.name)))

    def finish(self) -> bytes:
        """Close open chunks, write the summary and the footer; the file's bytes if it was built in memory."""
        for key in sorted(self._open):
            self.add_chunk(self._open.pop(key).build())
        self._put(_record(DATA_END, struct.pack("<I", 0)))
        start = self.size
        first, last = self._times or (0, 0)
        stats = struct.pack("<QHIIIIQQ", sum(self._counts.values()), len(self._schemas), len(self._channels), len(self._index[1]), len(self._index[2]), len(self._index[0]), first, last)
        groups = [
            (SCHEMA, [self._schema(s) for s in self._schemas.values()]), (CHANNEL, [self._channel(c) for c in self._channels.values()]), (STATISTICS, [_record(STATISTICS, stats + _numbers(self._counts))]),
            (CHUNK_INDEX, self._index[0]), (ATTACHMENT_INDEX, self._index[1]), (METADATA_INDEX, self._index[2]),
        ]
        crc, offsets = 0, []
        for opcode, records in groups:
            at = self.size
            for record in records:
                self._put(record)
                crc = zlib.crc32(record, crc)
            if records:
                offsets.append(_record(SUMMARY_OFFSET, struct.pack("<BQQ", opcode, at, self.size - at)))
        offset_start = self.size
        for record in offsets:
            self._put(record)
            crc = zlib.crc32(record, crc)
        footer = struct.pack("<BQQQ", FOOTER, 20, start, offset_start)
        self._put(footer + struct.pack("<I", zlib.crc32(footer, crc)))
        self._put(MAGIC)
        return self._memory.getvalue() if self._memory is not None else b""

    @staticmethod
    def _schema(s: Schema) -> bytes:
        return _record(SCHEMA, struct.pack("<H", s.id) + _text(s.name) + _text(s.encoding) + struct.pack("<I", len(s.data)) + s.data)

    @staticmethod
    def _channel(c: Channel) -> bytes:
        return _record(CHANNEL, struct.pack("<HH", c.id, c.schema_id) + _text(c.topic) + _text(c.message_encoding) + _map(c.metadata))


class Ranges:
    """A file that is read by byte ranges, from its end: an object with read_at(length, offset) and its size. ``taken`` counts bytes."""

    def __init__(self, source: Any, size: int) -> None:  # noqa: ANN401
        self._source, self.size, self.taken = source, size, 0

    def at(self, offset: int, length: int) -> bytes:
        data = self._source.read_at(length, offset)
        if len(data) < length:
            raise ValueError("truncated MCAP file")
        self.taken += length
        return bytes(data)

    def summary(self) -> list:
        """All records of the summary section; a file without one is scanned record by record, bodies of chunks and attachments unread."""
        tail = 29 + len(MAGIC)
        if self.size < 2 * len(MAGIC) + 29:
            raise ValueError("not a complete MCAP file")
        raw = self.at(self.size - tail, tail)
        opcode, length = struct.unpack_from("<BQ", raw)
        if raw[-8:] != MAGIC or opcode != FOOTER or length != 20:
            raise ValueError("not a complete MCAP file")
        start, offsets = struct.unpack_from("<QQ", raw, 9)
        if not start:
            return list(self._scanned())
        end = offsets or self.size - tail
        body = self.at(start, end - start)
        found = [x for op, part in _records(body, 0, len(body)) if (x := _decoded(op, part)) is not None]
        if any(isinstance(x, Statistics) for x in found) and not any(isinstance(x, ChunkIndex) for x in found):
            total = next(x.message_count for x in found if isinstance(x, Statistics))
            if total:  # a summary that leaves the index out
                return [x for x in found if isinstance(x, Statistics)] + list(self._scanned())
        return found

    def _scanned(self) -> Iterator[Any]:
        at = len(MAGIC)
        while True:
            opcode, length = struct.unpack("<BQ", self.at(at, 9))
            whole = 9 + length
            if opcode in (DATA_END, FOOTER):
                return
            if opcode in (SCHEMA, CHANNEL):
                yield _decoded(opcode, memoryview(self.at(at + 9, length)))
            elif opcode == CHUNK:
                head = self.at(at + 9, min(length, 64))
                c = _Cursor(head)
                first, last, size, _, kind = c.take("Q"), c.take("Q"), c.take("Q"), c.take("I"), c.text()
                yield ChunkIndex(first, last, at, whole, {}, 0, kind, c.take("Q"), size)
                # Schemas and channels may lie inside chunks only.
                for op, part in _chunk_records(self.at(at + 9, length)):
                    if op in (SCHEMA, CHANNEL):
                        yield _decoded(op, part)
            elif opcode == MESSAGE:  # outside of chunks: a chunk of its own
                head = struct.unpack("<HIQQ", self.at(at + 9, 22))
                yield ChunkIndex(head[2], head[2], at, whole, {head[0]: -1})
            elif opcode == ATTACHMENT:
                c = _Cursor(self.at(at + 9, min(length, 1 << 16)))
                log_time, create_time, name, kind, size = c.take("Q"), c.take("Q"), c.text(), c.text(), c.take("Q")
                yield AttachmentIndex(at, whole, log_time, create_time, size, name, kind)
            elif opcode == METADATA:
                yield MetadataIndex(at, whole, _Cursor(self.at(at + 9, length)).text())
            at += whole

    def record(self, offset: int, length: int) -> Any:  # noqa: ANN401
        """The attachment or metadata record there."""
        raw = self.at(offset, length)
        return _decoded(raw[0], memoryview(raw)[9:])

    def offsets(self, chunk_offset: int, chunk_length: int, index_length: int, channels: set[int]) -> list[int] | None:
        """Where in the chunk messages of these channels lie, from its message indexes; None without them."""
        if not index_length:
            return None
        raw = self.at(chunk_offset + chunk_length, index_length)
        out: list[int] = []
        for op, part in _records(raw, 0, len(raw)):
            if op == MESSAGE_INDEX:
                channel, size = struct.unpack_from("<HI", part)
                if channel in channels:
                    out += struct.unpack_from(f"<{size // 8}Q", part, 6)[1::2]
        return sorted(out)

    def messages(self, offset: int, length: int, channels: set[int], start: int | None = None, end: int | None = None, index_length: int = 0) -> Iterator[tuple[int, int, int, int, memoryview]]:
        """(channel, sequence, log time, publish time, data) of a chunk's messages of some channels and times from ``start`` to ``end``."""
        raw = self.at(offset, length)
        if raw[0] == MESSAGE:
            parts: Iterator[tuple[int, memoryview]] = iter([(MESSAGE, memoryview(raw)[9:])])
        else:
            places = self.offsets(offset, length, index_length, channels)
            inner = _chunk_bytes(memoryview(raw)[9:])
            parts = _records(inner, 0, len(inner)) if places is None else (r for at in places for r in _record_at(inner, at))
        for op, part in parts:
            if op != MESSAGE:
                continue
            channel, sequence, log_time, publish_time = struct.unpack_from("<HIQQ", part)
            if channel in channels and (start is None or log_time >= start) and (end is None or log_time <= end):
                yield channel, sequence, log_time, publish_time, part[22:]


def _record_at(data: bytes, at: int) -> Iterator[tuple[int, memoryview]]:
    opcode, size = struct.unpack_from("<BQ", data, at)
    yield opcode, memoryview(data)[at + 9 : at + 9 + size]


def _chunk_bytes(body: memoryview) -> bytes:
    c = _Cursor(body)
    c.raw(16)
    size, crc, kind = c.take("Q"), c.take("I"), c.text()
    inner = _unpressed(kind, c.raw(c.take("Q")), size)
    if crc and zlib.crc32(inner) != crc:
        raise ValueError("MCAP chunk fails its checksum")
    return inner


def _chunk_records(body: bytes) -> Iterator[tuple[int, memoryview]]:
    inner = _chunk_bytes(memoryview(body))
    return _records(inner, 0, len(inner))
