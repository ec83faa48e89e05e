"""The dataset API: configuration, and sample and episode datasets as lazily planned DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.payload import decode_columns
from stratalog.operators import assemble as asm
from stratalog.operators import catalog as cat
from stratalog.operators import pipeline as pipe
from stratalog.operators import zipping
from stratalog.plans.slices import Index, pick, resolve_slices
from stratalog.sources import episodes as src
from stratalog.sources import indexed
from stratalog.sources.video import Codec, RawCodec, decode_streams

#: Frames that a video announces but does not hold and that repeat its last one, at most.
FRAME_TOLERANCE = 5
#: Positions of a block in which a filtered dataset looks up an index.
LOOKUP_BLOCK = 65_536


@dataclass(frozen=True)
class Levels:
    """A setting for samples, episodes and the dataset's file lists."""

    sample: Any = None
    episode: Any = None
    dataset: Any = None


@dataclass(frozen=True)
class DatasetConfig:
    """Settings of a dataset; unset ones change nothing.

    ``slices.dataset`` is a dict by root or a list for all roots; slices at other levels are rejected. ``rearrange.dataset`` orders
    roots, ``rearrange.episode`` each root's files; ``rearrange.episode`` of a single file may be "reverse", which scans it from
    the end. ``seed`` makes every order reproducible, also between iterations. ``codec`` decodes video attachments, whose items are
    structs of stamp and frame. Without ``flatten`` a dataset's rows are its episodes, and its items their datasets.
    """

    data_root: str | list[str]
    keys: list[str] = field(default_factory=list)
    topics: list[str] | None = field(default_factory=list)
    attachments: list[str] | None = field(default_factory=list)
    slices: Levels = Levels()
    rearrange: Levels = Levels(cat.NONE, cat.NONE, cat.NONE)
    shuffle_buffer_size: int = 0
    seed: int = 0
    world_size: int = 1
    rank: int = 0
    num_workers: int = 1
    worker_id: int = 0
    resume_from_sample: int = 0
    filter_fn: Column | Callable[[DataFrame], DataFrame] | None = None
    transform: Callable[[DataFrame], DataFrame] | None = None
    cache: bool = False
    flatten: bool = True
    strict: bool = True
    codec: Codec = field(default_factory=RawCodec)

    def __post_init__(self) -> None:
        if self.world_size < 1 or not 0 <= self.rank < self.world_size:
            raise ValueError("rank lies between 0 and world_size - 1")
        if self.slices.sample or self.slices.episode:
            raise ValueError("only slices of the dataset level are supported")
        for kind in (self.rearrange.episode, self.rearrange.dataset):
            if kind not in (cat.NONE, cat.SORT, cat.SHUFFLE, cat.REVERSE):
                raise ValueError(f"unknown rearrangement {kind!r}")
        if self.rearrange.dataset == cat.REVERSE:
            raise ValueError("roots cannot be reversed")
        if self.rearrange.sample not in (None, cat.NONE):
            raise ValueError("samples are not rearranged; shuffle_buffer_size shuffles them")


class IterableDataset:
    """A stream of rows under the sample pipeline. Subclasses, or a callable, give the stream with an order in ``order``."""

    order: tuple[str, ...] = ("sample_idx",)

    def __init__(self, spark: SparkSession, config: DatasetConfig, read: Callable[[SparkSession, DatasetConfig], DataFrame] | None = None) -> None:
        self.spark, self.config, self._read = spark, config, read
        self._frame: DataFrame | None = None
        self._length: int | None = None

    def load(self) -> IterableDataset:
        """Plan the stream; with ``cache`` its result is persisted (and recomputed where an executor is lost)."""
        if self._frame is None:
            self._frame = self._pipeline(self.read_stream())
            if self.config.cache:
                self._frame = self._frame.persist()
        return self

    def read_stream(self) -> DataFrame:
        """(episode_id, the columns of ``order``, values) before the pipeline."""
        if self._read is None:
            raise NotImplementedError("a subclass or a callable reads the stream")
        return self._read(self.spark, self.config)

    def _pipeline(self, stream: DataFrame) -> DataFrame:
        c = self.config
        return pipe.run_pipeline(
            stream, list(self.order), world_size=c.world_size, rank=c.rank, num_workers=c.num_workers, worker_id=c.worker_id, resume_from_sample=c.resume_from_sample,
            filter_fn=c.filter_fn, transform=c.transform, shuffle_buffer_size=c.shuffle_buffer_size, seed=c.seed,
        )

    @property
    def frame(self) -> DataFrame:
        """The pipeline's output with pos, its position in it."""
        return self.load()._frame

    def __iter__(self) -> Iterator[Row]:
        """Rows in order, one partition at a time."""
        return iter(self.frame.orderBy("pos").toLocalIterator())

    def __len__(self) -> int:
        if self._length is None:
            self._length = self.frame.count()
        return self._length

    def __getitem__(self, index: int) -> Row:
        found = self.frame
        if self.config.filter_fn is not None:  # positions have gaps: the index counts rows
            row = self._lookup(found, index)
        else:
            row = pipe.nth(found, index).first()
        if row is None:
            raise IndexError(f"no sample {index}")
        return row

    def _lookup(self, found: DataFrame, index: int) -> Row | None:
        """Row ``index`` of a frame whose positions have gaps: counts of blocks say which one holds it, and only that is sorted."""
        block = F.expr(f"pos div {LOOKUP_BLOCK}")
        sizes = found.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("block").desc() if index < 0 else F.col("block"))
        left = -index - 1 if index < 0 else index
        for at, n in sizes.toLocalIterator():
            if left < n:
                return found.where(block == at).orderBy(F.col("pos").desc() if index < 0 else F.col("pos")).limit(left + 1).collect()[-1]
            left -= n
        return None

    def batches(self, size: int, item: str, strict: bool = False) -> DataFrame:
        return pipe.batches(self.frame, size, ["pos"], item, strict=strict)

    def close(self) -> None:
        """Free the cache; may be repeated."""
        if self._frame is not None and self.config.cache:
            self._frame.unpersist()
        self._frame = None

    def __enter__(self) -> IterableDataset:
        return self.load()

    def __exit__(self, *exc: object) -> None:
        self.close()


class EpisodeDataset(IterableDataset):
    """Samples of the container files of one or more roots, in catalogue order."""

    def __init__(self, spark: SparkSession, config: DatasetConfig) -> None:
        super().__init__(spark, config)
        roots = [config.data_root] if isinstance(config.data_root, str) else list(config.data_root)
        slices = resolve_slices(config.slices.dataset)
        listed = self._rearranged(roots, config.rearrange.dataset)
        self._files: dict[str, list[str]] = {}
        for root in listed:
            names = self._rearranged(src.list_items(spark, root, ".mcap"), config.rearrange.episode)
            own: list[Index] = slices.get(root, []) if isinstance(slices, dict) else (slices or [])
            self._files[root] = pick(names, own)
        if not any(self._files.values()):
            raise ValueError(f"no episodes in {roots}")

    def _rearranged(self, names: list[str], kind: str) -> list[str]:
        if kind == cat.SHUFFLE:
            import hashlib

            return sorted(names, key=lambda n: (hashlib.md5(f"{self.config.seed}:{n}".encode()).hexdigest(), n))
        return sorted(names, reverse=kind == cat.REVERSE) if kind != cat.NONE else list(names)

    @property
    def all_files(self) -> dict[str, list[str]]:
        return self._files

    def episode_count(self) -> int:
        return sum(map(len, self._files.values()))

    def _paths(self) -> list[str]:
        return [f"{root.removesuffix('/')}/{name}" for root, names in self._files.items() for name in names]

    def read_stream(self) -> DataFrame:
        """Samples; without ``flatten`` a row per episode: (episode_id, sample_idx, path), whose files are not opened."""
        paths = self._paths()
        if self.config.flatten:
            return read_samples(self.spark, paths, self.config)
        rows = [(f"{i:09d}:{p}", 0, p) for i, p in enumerate(paths)]
        return self.spark.createDataFrame(rows, "episode_id string, sample_idx bigint, path string")

    def episode(self, path: str) -> SampleDataset:
        """The dataset of one file, under the same settings but those that choose files and parts of the stream."""
        own = replace(self.config, data_root=path, flatten=True, slices=Levels(), rearrange=Levels(cat.NONE, cat.NONE, cat.NONE), world_size=1, rank=0, num_workers=1, worker_id=0, resume_from_sample=0, filter_fn=None, transform=None, shuffle_buffer_size=0)
        return SampleDataset(self.spark, own)

    def __iter__(self) -> Iterator[Row]:
        if self.config.flatten:
            return super().__iter__()
        return (self.episode(row.path) for row in super(EpisodeDataset, self).__iter__())

    def __getitem__(self, index: int) -> Row | SampleDataset:
        found = super().__getitem__(index)
        return found if self.config.flatten else self.episode(found.path)


class SampleDataset(EpisodeDataset):
    """Samples of one container file; ``rearrange.episode`` "reverse" scans it from the end."""

    def __init__(self, spark: SparkSession, config: DatasetConfig) -> None:
        root = config.data_root if isinstance(config.data_root, str) else None
        if root is None and len(config.data_root) == 1:
            root = config.data_root[0]
        if root is None or not root.endswith(".mcap"):
            raise ValueError("a sample dataset has one .mcap file")
        if not config.flatten:
            raise ValueError("a single file has samples only")
        if config.rearrange.episode in (cat.SORT, cat.SHUFFLE) or config.rearrange.dataset != cat.NONE or config.slices.dataset:
            raise ValueError("a single file can only be reversed")
        IterableDataset.__init__(self, spark, config)
        head, _, name = root.rpartition("/")
        self._files = {head or ".": [name]}


def attachment_items(items: DataFrame, names: list[str], codec: Codec) -> DataFrame:
    """(episode_id, idx, one column per name): JSON elements as text, video frames as struct<pts, data>; unequal lengths raise.

    A name has one media type in all episodes; types but JSON and video raise.
    """
    videos = {r.name for r in items.where(F.col("media_type") == zipping.VIDEO).select("name").distinct().collect()}
    out = None
    for of_video, own in ((True, sorted(videos)), (False, sorted(set(names) - videos))):
        if not own:
            continue
        mine = items.where(F.col("name").isin(own))
        if of_video:
            streams = mine.select(F.struct("episode_id", "name").alias("stream"), "data")
            frames = decode_streams(streams, codec, tolerance=FRAME_TOLERANCE, ensure_base_stamp=False)
            listed = frames.select("stream.episode_id", "stream.name", "idx", F.struct("pts", "data").alias("item"))
        else:
            listed = zipping.json_elements(mine)
        part = zipping.zip_items(listed, own)
        out = part if out is None else zipping.strict_zip(out, part, ["episode_id", "idx"])
    return out


class _Files:
    """Questions about container files: by their indexes, or, in stores that only Spark opens, from whole files."""

    def __init__(self, spark: SparkSession, paths: list[str]) -> None:
        self._index = indexed.survey(indexed.list_files(spark, paths)) if all(map(indexed.by_ranges, paths)) else None
        self._whole = src.read_bytes(spark, paths) if self._index is None else None

    def names(self) -> tuple[dict[str, str], set[str]]:
        """(schema name by topic, attachment names), from summaries, in one job."""
        if self._index is not None:
            rows = self._index.where("kind in ('channel', 'attachment')").select("kind", "name", "schema_name").distinct().collect()
            return {r.name: r.schema_name or "" for r in rows if r.kind == "channel"}, {r.name for r in rows if r.kind == "attachment"}
        listed = src.channels(self._whole).join(src.schemas(self._whole), ["episode_id", "schema_id"], "left").select("topic", "name").distinct().collect()
        return {r.topic: r.name or "" for r in listed}, {r.name for r in src.attachments(self._whole).select("name").distinct().collect()}

    def messages(self, topics: list[str]) -> DataFrame:
        return indexed.messages(self._index, topics) if self._index is not None else src.messages(self._whole, topics)

    def attachments(self, names: list[str]) -> DataFrame:
        return indexed.attachments(self._index, names) if self._index is not None else src.attachments(self._whole).where(F.col("name").isin(names))

    def counts(self) -> DataFrame:
        return (indexed.counts(self._index) if self._index is not None else src.counts(self._whole)).where("n > 0")


def read_samples(spark: SparkSession, paths: list[str], config: DatasetConfig) -> DataFrame:
    """(episode_id, sample_idx, one column per topic and attachment); episodes are numbered in the order of ``paths``."""
    files = _Files(spark, paths)
    schemas, known = files.names()
    topics, attachments = cat.resolve_keys(set(schemas), known, config.keys, config.topics, config.attachments)
    place = spark.createDataFrame([(p, src.qualified(spark, p), i) for i, p in enumerate(dict.fromkeys(paths))], "_path string, episode_id string, _place bigint")
    reverse = config.rearrange.episode == cat.REVERSE and len(paths) == 1
    out = None
    if topics:
        # Payloads are decoded after assembly: values that a later one replaces never are.
        messages = files.messages(sorted(topics)).withColumnRenamed("data", "value")
        out = decode_columns(asm.assemble(messages, topics, reverse=reverse, strict=config.strict and not attachments, counts=files.counts().where(F.col("topic").isin(sorted(topics)))), {t: schemas[t] for t in topics})
    if attachments:
        if reverse:
            raise ValueError("attachments cannot be read from the end")
        right = attachment_items(files.attachments(sorted(attachments)), sorted(attachments), config.codec)
        out = right.withColumnRenamed("idx", "sample_idx") if out is None else zipping.zip_samples(out, right)
    if out is None:
        out = zipping.empty_samples(cat.equal_counts(files.counts()).withColumnRenamed("common", "length"))
    own = F.broadcast(place) if len(paths) <= 100_000 else place
    named = out.join(own, "episode_id")
    return named.withColumn("episode_id", F.concat(F.lpad(F.col("_place").cast("string"), 9, "0"), F.lit(":"), F.col("_path"))).drop("_path", "_place")
