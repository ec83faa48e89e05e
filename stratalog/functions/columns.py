"""Scalar functions of stamps, labels, paths and vectors as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000


def sec(ns: Column) -> Column:
    """Whole seconds of a nanosecond stamp, rounded towards minus infinity."""
    return F.floor((ns - F.pmod(ns, F.lit(NS))) / F.lit(NS)).cast("bigint")


def nsec(ns: Column) -> Column:
    """Nanoseconds within the second, 0 to 999,999,999."""
    return F.pmod(ns, F.lit(NS)).cast("bigint")


def split_stamp(ns: Column) -> Column:
    """struct<sec, nsec>; sec is exact for stamps of any size."""
    whole = (ns.cast("decimal(38,0)") - F.pmod(ns, F.lit(NS)).cast("decimal(38,0)")) / F.lit(NS).cast("decimal(10,0)")
    return F.struct(whole.cast("bigint").alias("sec"), nsec(ns).alias("nsec"))


def wall_clock_ms() -> Column:
    """Milliseconds since the epoch, one value a query."""
    return F.unix_millis(F.current_timestamp())


def index_label(index: Column, suffix: str) -> Column:
    return F.concat(index.cast("string"), F.lit(suffix))


def joined_path(directory: Column, name: Column) -> Column:
    """directory/name with exactly one slash between (one trailing slash of the directory is dropped)."""
    return F.concat(F.regexp_replace(directory, "/$", ""), F.lit("/"), name)


def with_extension(name: Column, extension: str) -> Column:
    """Whether a file name ends with the extension, its leading dot optional."""
    return name.endswith(extension if extension.startswith(".") else f".{extension}")


def vector_length(values: Column) -> Column:
    """Elements of a vector; 0 for an absent one."""
    return F.coalesce(F.size(values), F.lit(0)).cast("bigint")


def vector_element(values: Column, j: int) -> Column:
    """Element j from 0; 0 for an absent vector or an index outside it."""
    return F.when(values.isNull(), F.lit(0.0)).otherwise(F.coalesce(F.get(values, F.lit(j)), F.lit(0.0)))


def vector_is_none(values: Column) -> Column:
    return values.isNull()


def as_float_vector(values: Column) -> Column:
    """Doubles rounded to 32 bits, as they are stored."""
    return F.transform(values, lambda x: x.cast("float"))


def guard(ok: Column, message: str) -> Column:
    """A filter predicate that is true, or raises: unlike a guard in a projection, it cannot be pruned."""
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def base_stamp(comment: Column, ensure: bool = False) -> Column:
    """The base_stamp of a video comment (the text of a dict), as bigint; missing is 0, or raises with ``ensure``."""
    found = F.regexp_extract(comment, r"""["']base_stamp["']\s*:\s*["']?(-?[0-9]+)""", 1)
    value = F.when((found.isNotNull()) & (found != ""), found.cast("bigint"))
    return F.coalesce(value, F.raise_error(F.lit("the video has no base stamp")).cast("bigint") if ensure else F.lit(0).cast("bigint"))
