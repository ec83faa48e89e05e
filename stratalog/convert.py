"""``python -m stratalog.convert SOURCE... TARGET``: convert container files into others, video attachments into image channels."""

from __future__ import annotations

import argparse

from stratalog.session import build_session
from stratalog.sources import indexed
from stratalog.sources.video import AvCodec, RawCodec


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m stratalog.convert", description=__doc__)
    p.add_argument("source", nargs="+", help="container files, or directories of them")
    p.add_argument("target", help="directory of the new files, which keep their names")
    p.add_argument("--compression", choices=["zstd", "none"], default="zstd", help="of the new chunks")
    p.add_argument("--codec", choices=["keep", "raw", "h264"], default="keep", help="decodes video attachments; keep leaves them as they are")
    p.add_argument("--width", type=int, default=640, help="of decoded frames")
    p.add_argument("--height", type=int, default=480)
    p.add_argument("--image-format", default="jpeg", help="that the new image messages name")
    a = p.parse_args(arguments)
    codec = {"keep": lambda: None, "raw": RawCodec, "h264": lambda: AvCodec(a.width, a.height)}[a.codec]()
    spark = build_session("convert")
    index = indexed.convert(spark, a.source, a.target, codec, a.image_format, "" if a.compression == "none" else a.compression)
    print(f"{index.select('episode_id').distinct().count()} files in {a.target}")


if __name__ == "__main__":
    main()
