"""A data source for baskets: spark.read.format("baskets").load(path) and df.write.format("baskets").save(path), after register(spark).

A basket is a line of whole numbers. A file is read in splits of about `splitBytes`: each split has the lines that begin in it, so every line
is read once, however the file is cut. A task reads several splits, so small ones don't make more tasks than the bytes do. A task writes a file of its own under a hidden name; commit gives the files their names, abort
deletes them, so readers never see a part of a result. Paths are of any file system that pyarrow knows by its address; a path without one is a
local one, which all executors must share.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a split, and of what is read at once; what is read beyond a split's end for its last line.
SPLIT_BYTES, READ_BYTES, BEYOND_BYTES = 128 << 20, 1 << 20, 1 << 10
#: Small splits are dealt to so many tasks, or to more of about TASK_BYTES.
TASKS, TASK_BYTES = 64, 32 << 20
#: Lines of a batch.
BATCH_LINES = 10_000
_ITEMS = re.compile(rb"\s*([+-]?\d+(?:\s+[+-]?\d+)*)")


def _opened(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][\w+.-]*:/", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """The files of a path and their sizes; hidden ones aren't read."""
    from pyarrow import fs

    system, at = _opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def items_of(line: bytes) -> list[int]:
    """The leading run of whole numbers of 64 bits, as parse_items has it."""
    found, out = _ITEMS.match(line), []
    for x in found[1].split() if found else ():
        if not -(1 << 63) <= int(x) < 1 << 63:
            break
        out.append(int(x))
    return out


def lines_of(source, start: int, end: int) -> Iterator[bytes]:
    """The lines of an open file that begin at start or later and before end. Reads on to the end of the last one."""
    at = max(start - 1, 0)  # from the byte before: a line begins at start if that one ends a line
    source.seek(at)
    rest, skip = b"", start > 0
    read = at
    while block := source.read(min(READ_BYTES, max(end - read, 0) + BEYOND_BYTES)):
        read += len(block)
        rest += block
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if not skip:
                if at >= end:
                    return
                yield line
            skip, at = False, at + len(line) + 1
        if at >= end and not skip:
            return
    if rest and not skip and at < end:
        yield rest


@dataclass
class Splits(InputPartition):
    """Runs of neighbouring splits: (path, start, end), each to be cut every splitBytes from its start."""

    runs: list[tuple[str, int, int]]


def dealt(files: list[tuple[str, int]], size: int) -> list[Splits]:
    """The splits of files (path, bytes), in order, for at most TASKS tasks, or as many as there are TASK_BYTES."""
    count = sum(-(-n // size) for _, n in files)
    tasks = min(count, max(TASKS, -(-sum(n for _, n in files) // TASK_BYTES)))
    out: list[Splits] = [Splits([]) for _ in range(tasks)]
    before = 0  # splits
    for path, n in files:
        own = -(-n // size)
        at = 0
        while at < own:
            task = (before + at) * tasks // count
            end = min(own, -(-(task + 1) * count // tasks) - before)  # the first split of the next task
            out[task].runs.append((path, at * size, min(end * size, n)))
            at = end
        before += own
    return out


class BasketReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.skip = options.get("skipcomments", "false").lower() == "true"

    def partitions(self) -> list[Splits]:
        return dealt(_files(self.path), self.size) or [Splits([])]

    def lines(self, splits: Splits) -> Iterator[bytes]:
        system, _ = _opened(self.path)
        for path, start, end in splits.runs:
            with system.open_input_file(path) as source:
                for at in range(start, end, self.size):
                    yield from lines_of(source, at, min(at + self.size, end))

    def read(self, splits: Splits) -> Iterator[pa.RecordBatch]:
        lines = self.lines(splits)
        if self.skip:
            lines = (x for x in lines if (text := x.strip()) and not text.startswith(b"#"))
        while some := list(islice(lines, BATCH_LINES)):
            yield pa.record_batch({"items": pa.array(map(items_of, some), pa.list_(pa.int64()))})


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    name: str


def text_of(baskets: pa.Array) -> bytes:
    """A line for each array; an empty one for null."""
    joined = pc.binary_join(baskets.cast(pa.list_(pa.string())), " ")
    if joined.null_count > baskets.null_count:  # null items
        return "".join(" ".join(map(str, x or ())) + "\n" for x in baskets.to_pylist()).encode()
    return "".join(x + "\n" for x in pc.fill_null(joined, "").to_pylist()).encode()


class BasketWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, at = _opened(self.path)
        system.create_dir(at, recursive=True)
        name = f"part-{uuid.uuid4().hex}.txt"
        hidden = f"{at}/_{self.job}-{name}"
        with system.open_output_stream(hidden) as out:
            for batch in batches:
                out.write(text_of(batch.column("items")))
        return Written(hidden, f"{at}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _opened(self.path)
        old = [f for f, _ in _files(self.path)] if self.overwrite else []
        for m in filter(None, messages):
            system.move(m.hidden, m.name)
        for f in old:
            system.delete_file(f)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, at = _opened(self.path)
        for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.job}-"):
                system.delete_file(f.path)


class BasketSource(DataSource):
    """Options: splitBytes, skipComments (blank lines and those that start with # are left out)."""

    @classmethod
    def name(cls) -> str:
        return "baskets"

    def schema(self) -> str:
        return "items array<bigint>"

    def reader(self, schema) -> BasketReader:
        return BasketReader(self.options)

    def writer(self, schema, overwrite: bool) -> BasketWriter:
        return BasketWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BasketSource)
