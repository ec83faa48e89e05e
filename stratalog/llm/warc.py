"""WARC archives with a two-level capture index.

Pages become gzip members of WARC/1.1 archives; pages with a payload that another page has too become revisits of the one with the
largest id. The capture index sorts one line per record by reversed-host URL key into compressed blocks of lines; a sparse
directory keeps each block's first key. A look-up binary-searches the directory, then its block, and reads the byte range that the
line names. Archives and index are tables in the shared folder: an archive is a row with the file's bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import save

ARCHIVE_BYTES = 4 << 20
BLOCK_LINES = 3000
#: Directory bytes that are broadcast at once; a larger directory is searched in pieces of this size.
DIRECTORY_BYTES = 64 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^#]*)")
_CAPTURES = "array<struct<line:string,offset:bigint,length:bigint>>"


def surt(url: str | None) -> str:
    """Sort-friendly key of a URL: host labels reversed, then port, path and query without fragment.

    >>> surt("http://www.Example.com/a?b=1#c")
    'com,example,www)/a?b=1'
    """
    found = _URL.match(url or "")
    if not found or not found[1]:
        key = url or ""
    else:
        host = found[1].lower()
        labels = [host] if host.startswith("[") or re.fullmatch(r"[\d.]+", host) else reversed(host.split("."))
        port = f":{found[2]}" if found[2] and found[2] not in ("80", "443") else ""
        key = f"{','.join(labels)}{port}){found[3] or '/'}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", key)


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record, uncompressed; with ``refers_to`` a revisit, which has the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of one uncompressed record.

    A record whose block is shorter than its Content-Length, or that lacks the closing line ends, raises ValueError.
    """
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) < size + 4 or rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("truncated WARC record")
    return headers, rest[:size]


def read_payload(headers: dict[str, str], block: bytes) -> tuple[int, bytes]:
    """(payload size by the HTTP header, payload bytes of the block)."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return size, payload


def write_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives of all pages: (archive, data, captures), captures being each record's index line and byte range.

    Null html is the empty payload. Of pages with equal payloads of ``least_bytes`` or more that with the largest page_id is a
    response and the others revisit it; rows that repeat that id are responses too, and so are all if no id is known. Which page
    is the largest comes from digests alone, so no group of equal payloads ever meets in one task.
    """
    named = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digests = save(named.select("page_id", F.sha1(F.encode("html", "utf-8")).alias("digest"), (F.octet_length("html") >= least_bytes).alias("joins")).distinct(), "warc-digests")
    keepers = digests.where("joins").groupBy("digest").agg(F.max("page_id").alias("keeper"))
    refers = digests.where("joins").join(keepers, "digest").where("not (page_id <=> keeper)").select(F.col("page_id").alias("page"), F.col("digest").alias("sum"), "keeper")
    rows = named.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    rows = rows.join(refers, (F.col("page_id").eqNullSafe(F.col("page"))) & (F.col("digest") == F.col("sum")), "left").select("page_id", "url", "html", "keeper")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        data, captures, size = [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([b"".join(data)], pa.binary()), pa.array([captures], kind)], ["archive", "data", "captures"])

        kind = pa.list_(pa.struct([("line", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for page, url, html, keeper in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "keeper")), strict=True):
                own = "" if page is None else str(page)
                press = zlib.compressobj(6, zlib.DEFLATED, 31)
                record = press.compress(make_record(own, url, html.encode("utf-8", "surrogatepass"), None if keeper is None else str(keeper))) + press.flush()
                captures.append({"line": f"{surt(url)} {own}", "offset": size, "length": len(record)})
                data.append(record)
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    number, data, captures, size = number + 1, [], [], 0
        if captures:
            yield close()

    return save(rows.mapInArrow(pack, f"archive bigint, data binary, captures {_CAPTURES}"), "warc-archives")


def build_index(archives: DataFrame) -> DataFrame:
    """The capture index: (block, first, lines, data), blocks of sorted lines, compressed; block numbers rise with their keys.

    A line is the key, a space, the record's page, a space and a JSON object with archive, offset and length. Lines are sorted by
    range partitioning over key, page and place, so captures of one URL or host spread over tasks too.
    """
    captures = archives.select("archive", F.explode("captures").alias("c")).select("archive", "c.line", "c.offset", "c.length")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        lines: list[str] = []
        first = ""

        def close() -> pa.RecordBatch:
            cols = [pa.array([number], pa.int64()), pa.array([first]), pa.array([len(lines)], pa.int64()), pa.array([zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"))], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["block", "first", "lines", "data"])

        for batch in batches:
            for line, archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("line", "archive", "offset", "length")), strict=True):
                if not lines:
                    first = line
                lines.append(f"{line} {json.dumps({'archive': archive, 'offset': offset, 'length': length})}")
                if len(lines) == BLOCK_LINES:
                    yield close()
                    number, lines = number + 1, []
        if lines:
            yield close()

    ordered = captures.orderBy("line", "archive", "offset")
    return save(ordered.mapInArrow(fold, "block bigint, first string, lines bigint, data binary"), "warc-index")


def locate(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, archive, offset, length) of every capture of the wanted lines ("key page"), repeats in ``wanted`` counting once.

    The directory is searched in pieces of bounded size; the blocks that hold wanted lines are read once each.
    """
    spark = index.sparkSession
    wanted = wanted.select("line").distinct()
    size = index.agg(F.sum(F.octet_length("first") + 16), F.count(F.lit(1))).first()
    pieces = max(1, -(-int(size[0] or 0) // DIRECTORY_BYTES))
    numbers = [r[0] for r in index.select("block").orderBy("block").collect()] if pieces > 1 else []
    cuts = [numbers[i * len(numbers) // pieces] for i in range(1, pieces)]
    found = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        own = index if low is None else index.where(F.col("block") >= low)
        own = own if high is None else own.where(F.col("block") < high)
        directory = sorted((r.first, r.block) for r in own.select("first", "block").collect())
        shared = spark.sparkContext.broadcast(([d[0] for d in directory], [d[1] for d in directory]))

        def route(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            firsts, blocks = shared.value
            for batch in batches:
                lines, at = [], []
                for line in batch.column("line").to_pylist():
                    # Equal lines may fill several blocks: all from the one before the first that begins with it.
                    a, b = max(0, bisect_left(firsts, line) - 1), bisect_right(firsts, line)
                    lines += [line] * (b - a)
                    at += blocks[a:b]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(at, pa.int64())], ["line", "block"])

        def search(asked: pa.Table, blocks: pa.Table) -> pa.Table:
            out: dict[str, list] = {"line": [], "archive": [], "offset": [], "length": []}
            for data in blocks.column("data").to_pylist() if asked.num_rows else ():
                lines = zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")
                for line in asked.column("line").to_pylist():
                    at = bisect_left(lines, line + " ")
                    while at < len(lines) and lines[at].startswith(line + " {"):
                        place = json.loads(lines[at][len(line) + 1 :])
                        for k, v in zip(out, (line, place["archive"], place["offset"], place["length"]), strict=True):
                            out[k].append(v)
                        at += 1
            return pa.table([pa.array(out["line"], pa.string()), *(pa.array(out[k], pa.int64()) for k in ("archive", "offset", "length"))], list(out))

        asked = wanted.mapInArrow(route, "line string, block bigint")
        part = asked.groupBy("block").cogroup(own.select("block", "data").groupBy("block")).applyInArrow(search, "line string, archive bigint, offset bigint, length bigint")
        found = part if found is None else found.unionByName(part)
    return found


def wanted_lines(pages: DataFrame) -> DataFrame:
    """The index lines ("key page") of pages by url and page_id."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([f"{surt(u)} {'' if i is None else i}" for i, u in zip(ids, urls, strict=True)], pa.string())], ["line"])

    return pages.select("page_id", "url").mapInArrow(key, "line string")


def read_ranges(archives: DataFrame, places: DataFrame) -> DataFrame:
    """Records at (archive, offset, length): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Response payloads are checked against the digest of their header; a wrong one raises. A revisit has a null payload.
    """
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]

    def page_of(urn: str | None) -> int | None:
        name = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(name) if name else None

    def read(asked: pa.Table, files: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k, _ in kinds}
        for data in files.column("data").to_pylist() if asked.num_rows else ():
            for offset, length in zip(asked.column("offset").to_pylist(), asked.column("length").to_pylist(), strict=True):
                headers, block = parse_record(zlib.decompress(data[offset : offset + length], 31))
                size, payload = read_payload(headers, block)
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                response = headers["warc-type"] == "response"
                if response and (payload_digest(payload) != digest or len(payload) != size):
                    raise ValueError(f"payload of {headers['warc-record-id']} does not fit its digest")
                row = (page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], page_of(headers.get("warc-refers-to")), size, digest, payload if response else None)
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
        return pa.table([pa.array(out[k], t) for k, t in kinds], [k for k, _ in kinds])

    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    return places.groupBy("archive").cogroup(archives.select("archive", "data").groupBy("archive")).applyInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives, index them, and read every page back through the index: one row per input row."""
    archives = write_archives(pages)
    index = build_index(archives)
    return read_ranges(archives, locate(index, wanted_lines(pages)))
