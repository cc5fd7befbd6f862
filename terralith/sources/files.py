"""Documents of many megabytes as streams: how tasks get at the bytes of a file."""

from __future__ import annotations

import codecs
import contextlib
import io
import zipfile
from collections.abc import Iterator
from urllib.parse import quote
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of more bytes are opened by the task that parses them, through pyarrow's file systems (mounted folders, HDFS with
#: libhdfs, S3, GCS); smaller ones come through Spark, from any store that it reads.
STREAMED = 32 << 20
CHUNK = 1 << 16


def documents(spark: SparkSession, path: str, streamed: int = STREAMED) -> DataFrame:
    """(path, content) of files, one row each; content is null for those that opened() reads as a stream.  Spark lists
    both and reads the content of the small ones only."""
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= streamed).select("path", "content")
    large = files.filter(F.col("length") > streamed).select("path", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a path as Hadoop writes it (not escaped), and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


@contextlib.contextmanager
def opened(path: str, content: bytes | None) -> Iterator[io.IOBase]:
    """A seekable stream of the file's bytes."""
    if content is not None:
        yield io.BytesIO(content)
        return
    system, inner = system_of(path)
    with system.open_input_file(inner) as stream:
        yield stream


@contextlib.contextmanager
def member(stream: io.IOBase, *endings: str) -> Iterator[tuple[str | None, io.IOBase]]:
    """The first member of a zip archive whose name has one of the endings, as a stream; any other file is itself."""
    start = stream.read(2)
    stream.seek(0)
    if start != b"PK":
        yield None, stream
        return
    with zipfile.ZipFile(stream) as z:
        name = next((n for n in z.namelist() if n.lower().endswith(endings)), None)
        if name is None:
            raise ValueError(f"no {' or '.join(endings)} document in the archive")
        with z.open(name) as inner:
            yield name, inner


def xml_events(stream: io.IOBase) -> Iterator[tuple[str, ElementTree.Element]]:
    """(start or end, element) of an XML document in UTF-8, read in chunks; undecodable bytes are replaced and what
    stands before the first tag is skipped.  Whoever reads the events takes elements that are done out of their parents."""
    decoder, parser, begun = codecs.getincrementaldecoder("utf-8-sig")("replace"), ElementTree.XMLPullParser(("start", "end")), False
    while True:
        data = stream.read(CHUNK)
        text = decoder.decode(data, final=not data)
        if not begun:
            text = text.lstrip("﻿ \t\r\n")
            begun = bool(text)
        parser.feed(text)
        yield from parser.read_events()
        if not data:
            parser.close()
            yield from parser.read_events()
            return
