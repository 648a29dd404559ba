"""Record files of a folder as a source that Spark reads in parts, in batch and as a stream that can be replayed.

The files of a folder, in order of their names, are one sequence of lines: three header lines in the first file, records
behind. An offset is a file's name and a byte in it; all that lies before is behind it. Files may grow at their end, and
later names may come; only whole lines are read. A range between two offsets is cut into byte ranges, each a task that
reads the lines which begin in it, so that any range gives the same lines whenever it is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .records import Header, decode, typed

NAME = "record_lines"
#: Bytes of a task's part, and bytes read at once.
SPLIT_BYTES, READ_BYTES = 64 * 2**20, 2**20


class Part(InputPartition):
    """Lines of a file that begin at a byte from begin to end (excluded)."""

    def __init__(self, path: str, file: str, begin: int, end: int):
        self.path, self.file, self.begin, self.end = path, file, begin, end


class _Folder:
    """A folder's files by name. Path: a local or shared path, or an address that Arrow's file systems know."""

    def __init__(self, path: str):
        self.path = path
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def names(self) -> list[tuple[str, int]]:
        found = self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))

    def open(self, file: str):
        return self.files.open_input_file(f"{self.root}/{file}")

    def header(self) -> tuple[list[str], int] | None:
        """The header's lines and where the records begin in the first file; None while there is no file with three whole lines."""
        names = self.names()
        if not names:
            return None
        head = b""
        with self.open(names[0][0]) as f:
            while head.count(b"\n") < 3:
                part = f.read(4096)
                if not part:
                    return None
                head += part
        lines = head.split(b"\n")[:3]
        return [x.decode("utf-8-sig").rstrip("\r") for x in lines], sum(len(x) + 1 for x in lines)

    def whole(self, file: str, size: int, begin: int = 0) -> int:
        """Where a file's last whole line ends; of a file that is finished by a later one, its size."""
        with self.open(file) as f:
            at = size
            while at > begin:
                start = max(begin, at - READ_BYTES)
                f.seek(start)
                place = f.read(at - start).rfind(b"\n")
                if place >= 0:
                    return start + place + 1
                at = start
        return begin

    def parts(self, start: tuple[str, int], end: tuple[str, int], split: int) -> list[Part]:
        first = self.header()
        names = self.names()
        out = []
        for file, size in names:
            if first is None or file < start[0] or file > end[0]:
                continue
            begin = max(start[1] if file == start[0] else 0, first[1] if file == names[0][0] else 0)
            last = end[1] if file == end[0] else size
            out += [Part(self.path, file, a, min(a + split, last)) for a in range(begin, last, split)]
        return out


def lines_of(part: Part) -> Iterator[pa.RecordBatch]:
    """file, at (byte where the line begins), line: the lines that begin in a part, to their ends."""
    with _Folder(part.path).open(part.file) as f:
        at, rest = part.begin, b""
        if part.begin:  # a line that began before belongs to the part before
            f.seek(part.begin - 1)
            at, rest = part.begin - 1, f.read(READ_BYTES)
            while b"\n" not in rest:
                at += len(rest)
                rest = f.read(READ_BYTES)
                if not rest:
                    return
            place = rest.index(b"\n") + 1
            at, rest = at + place, rest[place:]
        while at < part.end:
            data = f.read(READ_BYTES)
            held = rest + data
            lines = held.split(b"\n")
            rest = lines.pop()
            if not data and rest:
                lines, rest = [*lines, rest], b""
            places, texts = [], []
            for x in lines:
                if at < part.end:
                    places.append(at)
                    texts.append(x.decode("utf-8", "replace").rstrip("\r"))
                at += len(x) + 1
            yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(places)), pa.array(places, pa.int64()), pa.array(texts, pa.string())], names=["file", "at", "line"])
            if not data:
                return


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.split = _Folder(options["path"]), int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Part]:
        names = self.folder.names()
        return self.folder.parts(("", 0), names[-1], self.split) if names else []

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return lines_of(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.split = _Folder(options["path"]), int(options.get("split_bytes", SPLIT_BYTES))

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0}

    def latestOffset(self) -> dict:
        names = self.folder.names()
        if not names or self.folder.header() is None:
            return self.initialOffset()
        file, size = names[-1]
        return {"file": file, "byte": self.folder.whole(file, size)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.folder.parts((start["file"], start["byte"]), (end["file"], end["byte"]), self.split)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return lines_of(partition)


class RecordLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, at bigint, line string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)


def header_of(path: str) -> Header:
    found = _Folder(path).header()
    if found is None:
        raise ValueError(f"no file with a header in {path}")
    return Header.parse(found[0])


def observed(spark: SparkSession, path: str, **options) -> DataFrame:
    """rec_no and the typed fields of all records in a folder of record files."""
    spark.dataSource.register(RecordLines)
    return typed(spark.read.format(NAME).options(**options).load(path), header_of(path))


def observed_stream(spark: SparkSession, path: str, header: Header | None = None, **options) -> DataFrame:
    """file, at and the typed fields of records as they come; (file, at) rises with the records. A header is needed while there is no file."""
    spark.dataSource.register(RecordLines)
    header = header or header_of(path)
    lines = spark.readStream.format(NAME).options(**options).load(path).select("file", "at", F.split("line", ",").alias("cells"))
    return lines.select("file", "at", *[decode(F.get("cells", i), k).alias(n, metadata={"flag": f}) for i, (n, k, f) in enumerate(zip(header.names, header.kinds, header.flags))])
