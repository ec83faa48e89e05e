"""Container files as a Spark data source: read, written and streamed under the name ``episodes``.

Reading: ``spark.read.format("episodes").load(path)`` gives messages; the option ``table`` names messages, channels, attachments or metadata.
Filters on topic and log_time (equality, in, comparisons) are pushed to the files' chunk indexes: chunks that cannot match are not read.
An input partition is a run of chunks of one file. The options ``topics`` (comma-separated), ``start`` and ``end`` do the same by name.

Writing: ``df.write.format("episodes").mode("append").save(directory)`` takes the parts that ``sources.indexed.file_parts`` makes, each
episode's in one partition and in order (``dealt_parts``). Files lie in a hidden folder until the job commits; a job that aborts leaves none.

Streaming: ``spark.readStream.format("episodes").load(directory)`` gives the messages of files as they arrive, in runs of chunks. A file must
appear complete, as the writer's do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from stratalog import model
from stratalog.sources import mcap_format as mf

_TABLES = {"messages": model.MESSAGES, "channels": model.CHANNELS, "attachments": model.ATTACHMENTS, "metadata": model.METADATA}
#: Bytes of chunks of an input partition, about.
RUN_BYTES = 64 << 20


@dataclass
class Ranges(InputPartition):
    """Chunks (or records) of one file: (offset, length, length of the message indexes) of each."""

    path: str
    parts: list[tuple[int, int, int]] = field(default_factory=list)


@dataclass
class Wanted:
    """What was pushed down: topics (None: all) and the range of log times."""

    topics: set[str] | None = None
    start: int | None = None
    end: int | None = None

    def narrow(self, topics: set[str] | None = None, start: int | None = None, end: int | None = None) -> None:
        if topics is not None:
            self.topics = topics if self.topics is None else self.topics & topics
        if start is not None:
            self.start = start if self.start is None else max(self.start, start)
        if end is not None:
            self.end = end if self.end is None else min(self.end, end)


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _system(path: str) -> tuple[Any, str]:
    """(Arrow file system, path in it) of a path or URI."""
    from pyarrow import fs

    local = _local(path)
    return fs.FileSystem.from_uri(local) if "://" in local else (fs.LocalFileSystem(), local)


def _listed(path: str) -> list[str]:
    """Container files at a path, sorted."""
    from pyarrow import fs

    system, inner = _system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [inner]
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".mcap"))


class EpisodeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "episodes"

    def schema(self) -> str:
        return _TABLES[self.options.get("table", "messages")]

    def reader(self, schema) -> EpisodeReader:  # noqa: ANN001
        return EpisodeReader(self.options)

    def streamReader(self, schema) -> EpisodeStream:  # noqa: ANN001, N802
        return EpisodeStream(self.options)

    def writer(self, schema, overwrite: bool) -> EpisodeWriter:  # noqa: ANN001
        if overwrite:
            raise ValueError("container files are only appended")
        return EpisodeWriter(self.options["path"])


class EpisodeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.table = options["path"], options.get("table", "messages")
        time = lambda name: int(options[name]) if options.get(name) else None
        self.wanted = Wanted(set(options["topics"].split(",")) if options.get("topics") else None, time("start"), time("end"))

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        """Narrow what is read; Spark checks all filters again, as chunks hold more than what matches."""
        if self.table == "messages":
            for f in filters:
                self._push(f)
        yield from filters

    def _push(self, f: ds.Filter) -> None:
        column = getattr(f, "attribute", None)
        if column == ("topic",) and isinstance(f, ds.EqualTo):
            self.wanted.narrow({f.value})
        elif column == ("topic",) and isinstance(f, ds.In):
            self.wanted.narrow(set(f.value))
        elif column == ("log_time",) and isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)):
            low = isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual))
            high = isinstance(f, (ds.EqualTo, ds.LessThan, ds.LessThanOrEqual))
            self.wanted.narrow(start=f.value + isinstance(f, ds.GreaterThan) if low else None, end=f.value - isinstance(f, ds.LessThan) if high else None)

    def _ranges(self, path: str) -> mf.Ranges:
        system, _ = _system(self.path)
        source = system.open_input_file(path)
        return mf.Ranges(source, source.size())

    def partitions(self) -> list[Ranges]:
        """Runs of the chunks that may match, by the files' summaries; of other tables one partition a file."""
        files = _listed(self.path)
        if self.table != "messages":
            return [Ranges(path) for path in files]
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(16) as pool:
            found = list(pool.map(self._runs, files))
        return [run for runs in found for run in runs] or [Ranges(self.path)]

    def _runs(self, path: str) -> list[Ranges]:
        w, runs, size = self.wanted, [], 0
        summary = self._ranges(path).summary()
        own = {c.id for c in summary if isinstance(c, mf.Channel) and (w.topics is None or c.topic in w.topics)}
        for x in summary:
            if not isinstance(x, mf.ChunkIndex) or (x.index_offsets and not own & set(x.index_offsets)) or not own:
                continue
            if (w.start is not None and x.end_time < w.start) or (w.end is not None and x.start_time > w.end):
                continue
            if not runs or size >= RUN_BYTES:
                runs.append(Ranges(path))
                size = 0
            runs[-1].parts.append((x.offset, x.length, x.index_length))
            size += x.length
        return runs

    def read(self, partition: Ranges) -> Iterator[tuple]:
        if self.table == "messages" and not partition.parts:
            return
        ranges = self._ranges(partition.path)
        summary = ranges.summary()
        channels = {c.id: c for c in summary if isinstance(c, mf.Channel)}
        if self.table == "channels":
            for c in channels.values():
                yield partition.path, c.id, c.topic, c.message_encoding, c.schema_id, dict(c.metadata)
        elif self.table in ("attachments", "metadata"):
            kind = mf.AttachmentIndex if self.table == "attachments" else mf.MetadataIndex
            for x in (x for x in summary if isinstance(x, kind)):
                r = ranges.record(x.offset, x.length)
                yield (partition.path, r.name, r.media_type, r.create_time, r.log_time, r.data) if self.table == "attachments" else (partition.path, r.name, dict(r.metadata))
        else:
            schemas = {s.id: s.name for s in summary if isinstance(s, mf.Schema)}
            w = self.wanted
            own = {i for i, c in channels.items() if w.topics is None or c.topic in w.topics}
            for offset, length, indexes in partition.parts:
                for channel, sequence, log_time, publish_time, data in ranges.messages(offset, length, own, w.start, w.end, indexes if len(own) < len(channels) else 0):
                    c = channels[channel]
                    yield partition.path, channel, c.topic, schemas.get(c.schema_id), log_time, publish_time, sequence, bytes(data)


class EpisodeStream(DataSourceStreamReader):
    """Files as they arrive. An offset is the last name seen and how many names there are up to it; a batch is what lies between two.

    Nothing but offsets is remembered, so a stream that starts again from its checkpoint reads the same files for the same batch and none
    twice. Names have to sort in order of arrival; a file that sorts before the last one seen raises.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self._reader = EpisodeReader(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": 0, "last": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = _listed(self._reader.path)
        return {"files": len(found), "last": found[-1] if found else ""}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        found = _listed(self._reader.path)
        if sum(f <= start["last"] for f in found) != start["files"]:
            raise ValueError("a file arrived or went among those that were read")
        return [run for f in found if start["last"] < f <= end["last"] for run in self._reader._runs(f)]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        return self._reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written in the hidden folder."""

    names: list[str]


class EpisodeWriter(DataSourceArrowWriter):
    """Files of whole episodes, in a hidden folder of the directory until all tasks are done."""

    def __init__(self, directory: str) -> None:
        import uuid

        self._directory, self._job = directory, uuid.uuid4().hex

    def _folder(self) -> tuple[Any, str, str]:
        system, base = _system(self._directory)
        return system, base.rstrip("/"), f"{base.rstrip('/')}/.{self._job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import uuid

        from stratalog.sources.indexed import FileWriter

        system, _, hidden = self._folder()
        # A task may run twice: each attempt has a folder, and only what a committed one names is moved.
        attempt = uuid.uuid4().hex
        system.create_dir(f"{hidden}/{attempt}", recursive=True)
        names: list[str] = []
        episode, out, writer = None, None, None

        def close() -> None:
            if writer is not None:
                writer.finish()
                out.close()

        for batch in iterator:
            for row in range(batch.num_rows):  # a row may be megabytes
                r = {c: v[0] for c, v in batch.slice(row, 1).to_pydict().items()}
                if r["episode_id"] != episode:
                    close()
                    episode = r["episode_id"]
                    if f"{attempt}/{episode}" in names:
                        raise ValueError(f"the parts of {episode} are not in order")
                    names.append(f"{attempt}/{episode}")
                    out = system.open_output_stream(f"{hidden}/{names[-1]}")
                    writer = FileWriter(out)
                writer.add(r)
        close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, base, hidden = self._folder()
        names = [n for m in messages if m is not None for n in m.names]
        if len({n.split("/", 1)[1] for n in names}) < len(names):
            system.delete_dir(hidden)
            raise ValueError("an episode has parts in two partitions")
        for name in names:
            system.move(f"{hidden}/{name}", f"{base}/{name.split('/', 1)[1]}")
        if names:
            system.delete_dir(hidden)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, _, hidden = self._folder()
        if system.get_file_info(hidden).type != fs.FileType.NotFound:
            system.delete_dir(hidden)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EpisodeSource)
