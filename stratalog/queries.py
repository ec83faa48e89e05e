"""One query per operator over the star-schema tables (see model.py for what stands for what)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog import model as m
from stratalog.functions import columns as col
from stratalog.functions import payload as pay
from stratalog.operators import assemble as asm
from stratalog.operators import catalog as cat
from stratalog.operators import pipeline as pipe
from stratalog.operators import segments as seg
from stratalog.operators import series, zipping
from stratalog.operators import stamps as st
from stratalog.plans.dataset import attachment_items
from stratalog.plans.slices import slice_indexes
from stratalog.sources import episodes as src
from stratalog.sources import video

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _user(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("episode_id", "user_id")


# ---- sample assembly


@query
def assemble_2(spark: SparkSession, d: str) -> DataFrame:
    return _user(asm.assemble(m.msg_log(spark, d), ["click", "view"]))


@query
def assemble_3(spark: SparkSession, d: str) -> DataFrame:
    return _user(asm.assemble(m.msg_log(spark, d), ["click", "view", "purchase"]))


@query
def assemble_reverse(spark: SparkSession, d: str) -> DataFrame:
    return _user(asm.assemble(m.msg_log(spark, d), ["click", "view"], reverse=True))


@query
def assemble_catalyst(spark: SparkSession, d: str) -> DataFrame:
    return _user(asm.assemble_in_columns(m.msg_log(spark, d), ["click", "view"]))


@query
def assemble_strict_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return asm.assemble(m.aligned_log(spark, d), ["size", "price"], strict=True).withColumnRenamed("episode_id", "p_brand")


# ---- catalogues and counts


@query
def topic_counts(spark: SparkSession, d: str) -> DataFrame:
    return _user(cat.topic_counts(m.msg_log(spark, d)))


@query
def equal_counts(spark: SparkSession, d: str) -> DataFrame:
    return _user(cat.equal_counts(cat.topic_counts(m.msg_log(spark, d))))


@query
def episode_length_ok(spark: SparkSession, d: str) -> DataFrame:
    return cat.episode_lengths(m.aligned_log(spark, d)).withColumnRenamed("episode_id", "p_brand")


@query
def topic_catalog(spark: SparkSession, d: str) -> DataFrame:
    return _user(cat.topic_catalog(m.msg_log(spark, d)))


@query
def attachment_catalog(spark: SparkSession, d: str) -> DataFrame:
    return cat.attachment_catalog(m.json_items(spark, d)).withColumnRenamed("episode_id", "conv_id")


@query
def unknown_topics(spark: SparkSession, d: str) -> DataFrame:
    return cat.unknown_names(["click", "view", "camera", "joint"], m.msg_log(spark, d), "topic")


@query
def requested_union(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([("click",), ("camera",)], "topic string")
    return m.msg_log(spark, d).select("topic").union(asked).distinct()


@query
def catalog_sorted(spark: SparkSession, d: str) -> DataFrame:
    return cat.require_rows(cat.episode_catalog(m.episode_files(spark, d)), "no episodes")


@query
def catalog_shuffled(spark: SparkSession, d: str) -> DataFrame:
    return cat.episode_catalog(m.episode_files(spark, d), cat.SHUFFLE, 42)


@query
def catalog_reversed(spark: SparkSession, d: str) -> DataFrame:
    return cat.episode_catalog(m.episode_files(spark, d), cat.REVERSE)


@query
def catalog_sliced(spark: SparkSession, d: str) -> DataFrame:
    return cat.episode_catalog(m.episode_files(spark, d), slices={"ASIA": slice_indexes([(1, 3), 0]), "EUROPE": [-1, 0], "AFRICA": slice_indexes((0, 0))})


@query
def catalog_by_root(spark: SparkSession, d: str) -> DataFrame:
    return cat.all_files(cat.episode_catalog(m.episode_files(spark, d))).select("root", F.array_join("files", ",").alias("files"))


@query
def catalog_size(spark: SparkSession, d: str) -> DataFrame:
    return m.episode_files(spark, d).groupBy("root").agg(F.count(F.lit(1)).alias("n_files"))


@query
def extension_filter(spark: SparkSession, d: str) -> DataFrame:
    files = m.episode_files(spark, d)
    return src.filter_files(files, "file", "mcap").select(col.joined_path(F.concat("root", F.lit("/")), F.col("file")).alias("path"))


@query
def slice_index_table(spark: SparkSession, d: str) -> DataFrame:
    cases = {"int": 4, "pair": (5, 8), "suffix": (5, 7, "_x"), "list": [(1, 4), (8, 10), 12], "empty": ()}
    rows = [(name, pos, str(i)) for name, case in cases.items() for pos, i in enumerate(slice_indexes(case))]
    named = spark.createDataFrame(rows, "name string, pos bigint, idx string")
    n = m.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("idx"), F.concat("n_name", F.lit(".mcap")).alias("file"))
    return n.join(F.broadcast(named), "idx", "right").select("name", "pos", "idx", "file")


# ---- the pipeline


@query
def shard(spark: SparkSession, d: str) -> DataFrame:
    return pipe.shard(pipe.number(m.samples(spark, d), ["sample_id"]), world_size=2, rank=1, num_workers=3, worker_id=2).select("episode_id", "sample_id", "pos")


@query
def resume(spark: SparkSession, d: str) -> DataFrame:
    return pipe.skip(pipe.shard(pipe.number(m.samples(spark, d), ["sample_id"]), 2, 0), 100).select("episode_id", "sample_id", "pos")


@query
def pipeline_full(spark: SparkSession, d: str) -> DataFrame:
    def transform(df: DataFrame) -> DataFrame:
        return df.withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))

    out = pipe.run_pipeline(m.samples(spark, d), ["sample_id"], world_size=2, rank=1, resume_from_sample=10, filter_fn=F.col("o_orderstatus") == "F", transform=transform, shuffle_buffer_size=64, seed=42)
    return out.select("episode_id", "sample_id", "cents", "pos")


@query
def pipeline_nested_literal(spark: SparkSession, d: str) -> DataFrame:
    return pipe.nested_shards(m.samples(spark, d), ["sample_id"], 2, 0).select("episode_id", "sample_id", "pos")


@query
def filter_map(spark: SparkSession, d: str) -> DataFrame:
    rows = m.table(spark, d, "lineitem").where((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R"))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))


@query
def block_shuffle(spark: SparkSession, d: str) -> DataFrame:
    events = m.table(spark, d, "events").select("user_id", "event_id")
    return pipe.block_shuffle(pipe.number(events, ["event_id"], "user_id"), 64, 42, "event_id").select("event_id", "pos", "out_pos")


@query
def bounded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    events = m.table(spark, d, "events").select(F.col("user_id").alias("episode_id"), "event_id")
    return pipe.bounded_shuffle(events, 16, 42, ["event_id"])


@query
def nth(spark: SparkSession, d: str) -> DataFrame:
    return pipe.nth(pipe.number(m.samples(spark, d), ["sample_id"]), 37).select("sample_id", "pos")


@query
def nth_negative(spark: SparkSession, d: str) -> DataFrame:
    return pipe.nth(pipe.number(m.samples(spark, d), ["sample_id"]), -3).select("sample_id", "pos")


@query
def first_k(spark: SparkSession, d: str) -> DataFrame:
    return m.samples(spark, d).orderBy("episode_id", "sample_id").limit(25).select("episode_id", "sample_id")


@query
def batches(spark: SparkSession, d: str) -> DataFrame:
    return pipe.batches(m.samples(spark, d), 4, ["sample_id"], "sample_id").select("episode_id", "batch_idx", F.array_join("items", ",").alias("items"))


@query
def batches_strict(spark: SparkSession, d: str) -> DataFrame:
    rows = m.table(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    rows = rows.select(F.col("p_partkey").alias("episode_id"), F.col("i").cast("bigint").alias("idx"), (F.col("p_partkey") * 10 + F.col("i")).alias("log_time"))
    return pipe.batches(rows, 5, ["idx"], "log_time", strict=True).select("episode_id", "batch_idx", F.array_join("items", ",").alias("items"))


# ---- zips


@query
def zip_json(spark: SparkSession, d: str) -> DataFrame:
    return zipping.zip_items(m.json_items(spark, d), ["role", "text"]).withColumnsRenamed({"episode_id": "conv_id", "idx": "turn"})


@query
def zip_samples(spark: SparkSession, d: str) -> DataFrame:
    samples = asm.assemble(m.msg_log(spark, d), ["click", "view"])
    items = samples.select("episode_id", F.col("sample_idx").alias("idx"), (F.col("sample_idx") * 10).alias("log_stamp"))
    return _user(zipping.zip_samples(samples, items))


@query
def json_attachments(spark: SparkSession, d: str) -> DataFrame:
    c = m.table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]).alias("roles"))
    files = c.select(F.col("conv_id").alias("episode_id"), F.lit("roles").alias("name"), F.lit("application/json").alias("media_type"), F.to_json("roles").cast("binary").alias("data"))
    return zipping.json_elements(files).select(F.col("episode_id").alias("conv_id"), F.col("idx").alias("turn"), F.col("item").alias("role"))


@query
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return m.table(spark, d, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query
def empty_samples(spark: SparkSession, d: str) -> DataFrame:
    return zipping.empty_samples(cat.episode_lengths(m.aligned_log(spark, d))).withColumnRenamed("episode_id", "p_brand")


# ---- stamps and frames


@query
def nearest_frame(spark: SparkSession, d: str) -> DataFrame:
    e = m.msg_log(spark, d)
    targets = e.where("topic = 'error'").select("episode_id", F.col("sequence").alias("target_id"), F.col("log_time").alias("t"))
    frames = e.where("topic = 'view'").select("episode_id", F.col("log_time").alias("pts"), F.col("sequence").alias("event_id"))
    return _user(st.nearest_frames(targets, frames, ["event_id"])).select("user_id", "target_id", F.coalesce("event_id", F.lit(-1)).alias("event_id"))


@query
def monotonic_ms(spark: SparkSession, d: str) -> DataFrame:
    return _user(st.monotonic(m.stamps(spark, d), st.repair_step(1_000_000))).select("user_id", "idx", "fixed")


@query
def monotonic_long(spark: SparkSession, d: str) -> DataFrame:
    """The same repair with each episode in as many tasks as it needs."""
    return _user(seg.monotonic_long(m.stamps(spark, d), st.repair_step(1_000_000))).select("user_id", "idx", "fixed")


@query
def assemble_long(spark: SparkSession, d: str) -> DataFrame:
    """All events as one episode, assembled in many tasks."""
    return seg.assemble_long(m.msg_log(spark, d).withColumn("episode_id", F.lit("all")), ["click", "view", "purchase"]).drop("episode_id")


@query
def monotonic_unit(spark: SparkSession, d: str) -> DataFrame:
    return _user(st.monotonic_unit(m.stamps(spark, d))).select("user_id", "idx", "fixed")


@query
def relative_stamp(spark: SparkSession, d: str) -> DataFrame:
    return _user(st.relative(st.monotonic_unit(m.stamps(spark, d)))).select("user_id", "idx", "base", "pts")


@query
def absolute_stamp(spark: SparkSession, d: str) -> DataFrame:
    pts = st.relative(st.monotonic_unit(m.stamps(spark, d)))
    return _user(pts.select("episode_id", "idx", st.absolute(F.col("base"), F.col("pts"), 1_000_000_000, 1, 90_000).alias("ns")))


@query
def sec_nsec(spark: SparkSession, d: str) -> DataFrame:
    return m.msg_log(spark, d).select(F.col("sequence").alias("event_id"), col.split_stamp(F.col("log_time")).alias("s")).select("event_id", "s.sec", "s.nsec")


@query
def tail_pad(spark: SparkSession, d: str) -> DataFrame:
    f = m.frames(spark, d)
    expected = f.groupBy("stream").agg((F.count(F.lit(1)) + F.pmod("stream", F.lit(4))).alias("expected"))
    return st.pad_tail(f.select("stream", "idx", "vec_id"), expected, 5)


@query
def frame_indices(spark: SparkSession, d: str) -> DataFrame:
    return st.select_frames(m.frames(spark, d).select("stream", "idx", "vec_id"), [7, 0, 3, 7])


@query
def base_stamps(spark: SparkSession, d: str) -> DataFrame:
    e = m.table(spark, d, "events")
    comment = F.concat(F.lit("{'base_stamp': "), F.col("event_id") * 1000, F.lit("}"))
    return e.select("event_id", col.base_stamp(F.when(F.col("event_id") % 3 > 0, comment).otherwise("")).alias("base"))


# ---- payloads


@query
def float_explode(spark: SparkSession, d: str) -> DataFrame:
    return series.long_form(m.table(spark, d, "embeddings"), ["vec_id"], "embedding")


@query
def array_length(spark: SparkSession, d: str) -> DataFrame:
    e = m.table(spark, d, "embeddings").withColumn("v", F.when(F.col("vec_id") % 7 > 0, F.col("embedding")))
    return e.select("vec_id", col.vector_length(F.col("v")).alias("n"), col.vector_is_none(F.col("v")).alias("is_none"))


@query
def array_element(spark: SparkSession, d: str) -> DataFrame:
    return m.table(spark, d, "embeddings").select("vec_id", col.vector_element(F.col("embedding"), 3).cast("double").alias("v3"), col.vector_element(F.col("embedding"), 99).cast("double").alias("v99"))


@query
def floatarray_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    e = m.table(spark, d, "embeddings").select("vec_id", pay.encode_float_arrays("embedding").alias("data"))
    return series.long_form(e.select("vec_id", pay.decode_float_arrays("data").alias("v")), ["vec_id"], "v")


@query
def field_fanout(spark: SparkSession, d: str) -> DataFrame:
    rows = m.table(spark, d, "lineitem")
    return pay.fan_out(rows, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"], {"l_quantity": "/line/quantity"})


@query
def message_builders(spark: SparkSession, d: str) -> DataFrame:
    e = m.msg_log(spark, d)
    made = e.select("sequence", pay.add_message("compressed_image", F.col("topic"), F.col("topic").cast("binary"), F.col("log_time"), F.col("log_time") + 1).alias("m"))
    return made.select("sequence", "m.topic", "m.schema_name", "m.log_time", F.col("m.payload.format").alias("format"), F.col("m.payload.timestamp.sec").alias("sec"), F.col("m.payload.timestamp.nsec").alias("nsec"))


@query
def encoding_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, pay.ENCODINGS))
    p = m.table(spark, d, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % len(pay.ENCODINGS)).cast("int")).alias("encoding"))
    return p.select("p_partkey", "encoding", pay.encoding_shape(F.col("encoding")).alias("s")).select("p_partkey", "encoding", F.col("s.channels").cast("bigint").alias("channels"), F.col("s.itemsize").cast("bigint").alias("itemsize"), "s.dtype")


@query
def encoding_inference(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("uint8", "uint8", "uint16", "float32")))
    case = (F.col("p_partkey") % 4).cast("int")
    cases = m.table(spark, d, "part").select("p_partkey", F.get(kinds, case).alias("dtype"), F.when(case == 1, 3).otherwise(2).cast("bigint").alias("dims"))
    return cases.select("p_partkey", "dtype", "dims", pay.infer_encoding(F.col("dtype"), F.col("dims")).alias("encoding"))


@query
def raw_image_check(spark: SparkSession, d: str) -> DataFrame:
    p = m.table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5 + 1).alias("width"), (F.col("p_size") % 3 + 1).alias("height"))
    images = p.select("p_partkey", "width", "height", (F.col("width") * 3).alias("step"), F.lit("rgb8").alias("encoding"), F.expr("cast(repeat('x', int(width * height * 3)) as binary)").alias("data"))
    return pay.check_raw_images(images).select("p_partkey", F.length("data").cast("bigint").alias("n_bytes"), F.col("channels").cast("bigint").alias("channels"), "dtype")


@query
def pixel_sums(spark: SparkSession, d: str) -> DataFrame:
    p = m.table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5 + 1).alias("width"), (F.col("p_size") % 3 + 1).alias("height"))
    images = p.select("p_partkey", "width", "height", (F.col("width") * 3).alias("step"), F.lit("rgb8").alias("encoding"), F.expr("cast(repeat('x', int(width * height * 3)) as binary)").alias("data"))
    return pay.pixel_rows(images).select("p_partkey", F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("total"))


@query
def all_encodings(spark: SparkSession, d: str) -> DataFrame:
    """Raw images of all ten encodings in one column, as payload bytes and back to pixels."""
    names = F.array(*map(F.lit, pay.ENCODINGS))
    p = m.table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5 + 1).cast("bigint").alias("width"), (F.col("p_size") % 3 + 1).cast("bigint").alias("height"), F.get(names, (F.col("p_partkey") % len(pay.ENCODINGS)).cast("int")).alias("encoding"))
    p = p.select("*", pay.encoding_shape(F.col("encoding")).alias("s"))
    pixel = F.when(F.col("s.itemsize") == 1, "78").when(F.col("s.itemsize") == 2, "7801").otherwise("0000803F")
    data = F.unhex(F.repeat(pixel, (F.col("width") * F.col("height") * F.col("s.channels")).cast("int")))
    image = F.struct(F.lit("").alias("frame_id"), "width", "height", "encoding", (F.col("width") * F.col("s.channels") * F.col("s.itemsize")).alias("step"), data.alias("data"))
    read = pay.decode_columns(pay.encode_raw_images(p.select("p_partkey", image.alias("image")), "image"), {"image": "foxglove.RawImage"})
    back = read.select("p_partkey", "image.*").select("p_partkey", "width", "height", "encoding", "data", pay.encoding_shape(F.col("encoding")).alias("s"))
    rows = pay.pixel_rows(back.select("p_partkey", "width", "height", "encoding", (F.col("width") * F.col("s.channels") * F.col("s.itemsize")).alias("step"), "data"))
    return rows.select("p_partkey", "encoding", F.size("pixels").cast("bigint").alias("n"), F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("total"))


# ---- conversion and containers


@query
def convert_union(spark: SparkSession, d: str) -> DataFrame:
    e = m.table(spark, d, "events")
    messages = e.select(F.lit("e").alias("episode_id"), F.col("event_type").alias("topic"), F.lit("FloatArray").alias("schema_name"), F.col("event_id").alias("log_time"), F.col("event_id").alias("publish_time"), F.col("event_id").alias("sequence"), F.col("props").cast("binary").alias("data"))
    f = m.frames(spark, d).select(F.lit("e").alias("episode_id"), F.concat(F.lit("cam"), "stream").alias("name"), F.col("idx").alias("pts"), F.col("vec_id").cast("string").cast("binary").alias("data"))
    kinds = f.select("episode_id", "name").distinct().select("episode_id", "name", F.when(F.col("name") == "cam3", "application/json").otherwise("video/mp4").alias("media_type"))
    out, _ = src.convert_videos(messages, kinds, f)
    is_image = F.col("schema_name") == "foxglove.CompressedImage"
    images = pay.decode_columns(out.where(is_image), {"data": "foxglove.CompressedImage"}).select("topic", "schema_name", "log_time", F.col("data.data").alias("data"))
    return out.where(~is_image).select("topic", "schema_name", "log_time", "data").unionByName(images).select("topic", "schema_name", "log_time", F.col("data").cast("string").alias("payload"))


@query
def configured_streams(spark: SparkSession, d: str) -> DataFrame:
    """Streams of packed pixels and streams of image files, each set up by its first frame: encoded, and decoded again."""
    f = m.frames(spark, d).withColumn("w", (F.col("stream") % 4 + 1).cast("int")).withColumn("h", (F.col("stream") % 3 + 1).cast("int"))
    pixels = F.repeat(F.char(97 + F.col("vec_id") % 26), F.col("w") * F.col("h") * 3)
    as_file = F.col("stream") % 2 == 1
    frames = f.select(
        "stream",
        "idx",
        (F.col("idx") * 10 + 10).alias("stamp"),
        F.when(as_file, F.concat(F.lit("P6\n"), F.col("w").cast("string"), F.lit(" "), F.col("h").cast("string"), F.lit("\n255\n"), pixels)).otherwise(pixels).cast("binary").alias("data"),
        F.when(as_file, "ppm").alias("format"),
        F.when(~as_file, F.col("w")).alias("width"),
        F.when(~as_file, F.col("h")).alias("height"),
    )
    streams = video.encode_streams(frames, video.RawCodec())
    known = F.struct("stream", "kind", "width", "height", "n_frames").alias("stream")
    decoded = video.decode_streams(streams.select(known, "data"), video.RawCodec())
    return decoded.select("stream.*", "idx", F.length("data").cast("bigint").alias("n_bytes"), F.substring(F.col("data").cast("string"), 1, 1).alias("pixel"))


@query
def video_zip(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a video and elements of a JSON attachment per stream, zipped at their positions as the dataset API does."""
    f = m.frames(spark, d).select(F.col("stream").cast("string").alias("stream"), "idx", (F.col("idx") * 10 + 10).alias("stamp"), F.col("vec_id").cast("string").cast("binary").alias("data"))
    videos = video.encode_streams(f, video.RawCodec()).select(F.col("stream").alias("episode_id"), F.lit("camera").alias("name"), F.lit("video/mp4").alias("media_type"), "data")
    stamps = f.groupBy("stream").agg(F.to_json(F.sort_array(F.collect_list("stamp"))).cast("binary").alias("data"))
    both = videos.unionByName(stamps.select(F.col("stream").alias("episode_id"), F.lit("stamps").alias("name"), F.lit("application/json").alias("media_type"), "data"))
    return attachment_items(both, ["camera", "stamps"], video.RawCodec()).select("episode_id", "idx", F.col("camera.data").cast("string").alias("frame"), F.col("stamps").cast("bigint").alias("stamp"))


@query
def attachment_media(spark: SparkSession, d: str) -> DataFrame:
    kinds = m.frames(spark, d).select(F.concat(F.lit("color/"), "stream").alias("name"), F.when(F.col("stream") % 2 == 0, "video/mp4").otherwise("application/json").alias("media_type"))
    return kinds.where((F.col("media_type") == zipping.VIDEO) & F.col("name").contains("color")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query
def container_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    e = m.msg_log(spark, d)
    rows = e.select(F.col("episode_id").cast("string").alias("episode_id"), "topic", F.lit("FloatArray").alias("schema_name"), "log_time", F.col("log_time").alias("publish_time"), "sequence", pay.encode_float_arrays(F.array(F.col("value").cast("float"))).alias("data"))
    read = src.messages(src.to_files(rows), ["click", "view"])
    return read.select("episode_id", "topic", "log_time", "sequence", F.round(pay.decode_float_arrays("data")[0].cast("double"), 2).alias("value"))


@query
def container_counts(spark: SparkSession, d: str) -> DataFrame:
    e = m.msg_log(spark, d)
    rows = e.select(F.col("episode_id").cast("string").alias("episode_id"), "topic", F.lit("x").alias("schema_name"), "log_time", F.col("log_time").alias("publish_time"), "sequence", F.lit(b"").alias("data"))
    return src.counts(src.to_files(rows))


@query
def channel_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = m.msg_log(spark, d).withColumn("schema_name", F.lit("FloatArray"))
    return src.channel_ids(rows).select("episode_id", "topic", F.col("channel_id").cast("bigint").alias("channel_id"))


# ---- series


@query
def field_range(spark: SparkSession, d: str) -> DataFrame:
    rows = series.padded_range(m.table(spark, d, "events"), "event_type", "value", manual={"error": (0.0, 5.0)})
    return rows.select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query
def sliding_last_n(spark: SparkSession, d: str) -> DataFrame:
    return series.last_n(m.table(spark, d, "events"), ["event_type"], ["event_id"], 200).select("event_type", "event_id", "value")


@query
def sliding_count(spark: SparkSession, d: str) -> DataFrame:
    rows = m.table(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return series.sliding_mean(rows, ["user_id"], ["event_id"], "cents", 10).select("event_id", F.round("mean", 6).alias("mean"), "held")


@query
def series_shape(spark: SparkSession, d: str) -> DataFrame:
    """A synthetic series per region, named after it."""
    r = m.table(spark, d, "region").select(F.concat(F.lit("Field_"), F.col("r_regionkey") + 1).alias("field"), "r_name")
    made = series.sample_series(spark, fields=r.count()).groupBy("field").agg(F.count(F.lit(1)).alias("steps"), F.sum(F.size("values")).cast("bigint").alias("points"))
    return r.join(made, "field").select("r_name", "field", "steps", "points")
