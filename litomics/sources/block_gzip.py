"""Lines of gzip files as a data source. A file of gzip blocks that tell their sizes (as genome tools write them) is read by many tasks; a plain gzip file by one.

    spark.read.format("block_gzip").load(path)                    # value string
    lines.write.format("block_gzip").mode("append").save(path)    # one file of blocks for each task

A task owns the blocks that begin in its range of bytes. It finds the first of them by itself: a header that gives its block's size, followed by a block that unpacks with the right
checksum. A line belongs to the task whose blocks hold the end of the line before, so a task that does not begin the file skips to the first line end, and reads on past its last block
for one more. Paths are opened through Arrow's file systems: local files, hdfs:// and object stores. Lines end with a line feed, with or without a carriage return; bytes that are no UTF-8 are replaced.
An empty file has no lines; a file that breaks off is an error."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a file that one task reads, where nothing else is asked for.
SPLIT_BYTES = 64_000_000
#: No block is longer, packed or unpacked.
MOST_BLOCK = 1 << 16
#: Bytes of text that a block holds, so that it stays below MOST_BLOCK even where nothing can be packed.
BLOCK_TEXT = 65_000
BATCH_LINES = 10_000
# The head of a block up to its extra field, and the empty block that ends a file.
HEAD = b"\x1f\x8b\x08\x04"
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block_size(data: bytes, at: int = 0) -> int | None:
    """The size of the block that begins at `at`; None if none does."""
    if data[at : at + 4] != HEAD or len(data) < at + 18:
        return None
    end = at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    at += 12
    while at + 4 <= min(end, len(data)):
        kind, length = data[at : at + 2], struct.unpack_from("<H", data, at + 2)[0]
        if kind == b"BC" and length == 2 and at + 6 <= len(data):
            return struct.unpack_from("<H", data, at + 4)[0] + 1
        at += 4 + length
    return None


def unpacked(block: bytes) -> bytes | None:
    """The text of a whole block; None if it is none."""
    try:
        return zlib.decompress(block, 31)
    except zlib.error:
        return None


def packed(text: bytes) -> bytes:
    """A block that tells its size."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(text) + deflate.flush()
    head = HEAD + bytes(5) + b"\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text) & 0xFFFFFFFF)


def first_block(file, start: int, size: int) -> int:
    """Where the first block at or after `start` begins; the file's size if there is none."""
    if start == 0:
        return 0
    file.seek(start)
    data = file.read(3 * MOST_BLOCK)
    at = data.find(HEAD)
    while at >= 0:
        n = block_size(data, at)
        if n is not None and unpacked(data[at : at + n]) is not None:
            return start + at
        at = data.find(HEAD, at + 1)
    return size


def blocks(file, start: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of each block from `start` on."""
    file.seek(start)
    data, at = b"", start
    while True:
        if len(data) < MOST_BLOCK:
            data += file.read(16 * MOST_BLOCK)
        if not data:
            return
        n = block_size(data)
        text = None if n is None else unpacked(data[:n])
        if text is None:
            raise ValueError(f"no whole gzip block at byte {at}")
        yield at, text
        data, at = data[n:], at + n


def gzip_text(file) -> Iterator[bytes]:
    """The text of a plain gzip file, of one member or more."""
    file.seek(0)
    unpack, fed = zlib.decompressobj(31), False
    while data := file.read(1 << 20):
        while data:
            yield unpack.decompress(data)
            fed = True
            data = unpack.unused_data
            if unpack.eof:
                unpack, fed = zlib.decompressobj(31), False
                data = data.lstrip(b"\0")
    if fed:
        raise ValueError("the gzip file breaks off")


def lines_of(texts: Iterator[bytes]) -> Iterator[bytes]:
    """Whole lines of pieces of text."""
    rest: list[bytes] = []
    for text in texts:
        first, *more = text.split(b"\n")
        rest.append(first)
        if more:
            yield b"".join(rest)
            yield from more[:-1]
            rest = [more[-1]]
    if any(rest):
        yield b"".join(rest)


def owned_lines(file, start: int, end: int, size: int) -> Iterator[bytes]:
    """The lines of the task with the bytes from `start` to `end`."""

    def texts() -> Iterator[bytes]:
        skipping = start > 0
        for at, text in blocks(file, first_block(file, start, size)):
            if at >= end:
                if skipping:
                    return
                # one line more: up to its end
                cut = text.find(b"\n")
                yield text if cut < 0 else text[: cut + 1]
                if cut >= 0:
                    return
                continue
            if skipping:
                cut = text.find(b"\n")
                if cut < 0:
                    continue
                skipping, text = False, text[cut + 1 :]
            yield text

    yield from lines_of(texts())


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int
    size: int
    by_block: bool


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class BlockGzipReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int) -> None:
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Part]:
        store, path = opened(self.path)
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if not f.size:
                continue
            with store.open_input_file(f.path) as file:
                by_block = block_size(file.read(64)) is not None
            step = self.split_bytes if by_block else f.size
            out += [Part(prefix + f.path, a, min(a + step, f.size), f.size, by_block) for a in range(0, f.size, step)]
        return out or [Part("", 0, 0, 0, False)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.size:
            return
        store, path = opened(part.path)
        with store.open_input_file(path) as file:
            found = owned_lines(file, part.start, part.end, part.size) if part.by_block else lines_of(gzip_text(file))
            some: list[str] = []
            for line in found:
                some.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                if len(some) >= BATCH_LINES:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["value"])
                    some = []
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["value"])


class BlockGzipWriter(DataSourceArrowWriter):
    """Each task writes one file, by a name of its own; files of tasks that failed are removed."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path = path
        store, at = opened(path)
        store.create_dir(at, recursive=True)
        if overwrite:
            store.delete_dir_contents(at)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, at = opened(self.path)
        name = f"{at}/part-{uuid.uuid4().hex}.gz"
        with store.open_output_stream(name, compression=None) as file:
            held, size = [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                data = "\n".join([line or "" for line in batch.column(0).to_pylist()]).encode() + b"\n"
                held.append(data)
                size += len(data)
                if size >= BLOCK_TEXT:
                    text = b"".join(held)
                    whole = len(text) - len(text) % BLOCK_TEXT
                    for k in range(0, whole, BLOCK_TEXT):
                        file.write(packed(text[k : k + BLOCK_TEXT]))
                    held, size = [text[whole:]], len(text) - whole
            if size:
                file.write(packed(b"".join(held)))
            file.write(LAST)
        return Written(name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = opened(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.name)


@dataclass
class Written(WriterCommitMessage):
    name: str


class BlockGzip(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_gzip"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> BlockGzipReader:
        return BlockGzipReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> BlockGzipWriter:
        return BlockGzipWriter(self.options["path"], overwrite)


def lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The lines of a text file, in blocks where it is gzip and has them."""
    if not path.endswith((".gz", ".bgz")) and not options:
        return spark.read.text(path)
    spark.dataSource.register(BlockGzip)
    return spark.read.format("block_gzip").options(**options).load(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """One text column as files of blocks."""
    rows.sparkSession.dataSource.register(BlockGzip)
    rows.write.format("block_gzip").mode("append").save(path)
