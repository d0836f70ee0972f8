"""A growing log file as a stream (S1-S4): half lines are held back, rotation and truncation noticed, the place kept in the checkpoint.

The place is the file's number, the byte after the last complete line, and a digest of the file's first bytes, which tells a
file that was emptied and written anew from one that grew. A batch is planned as byte ranges of some SPLIT bytes that
executors read on their own, so a large backlog is dealt out; only places pass through the driver. Batches that are run
again read the same ranges. After a rotation the rest of the renamed file, found in the same folder by its number, comes
first, then files that came and went in between, then the new one; a last line without an end counts once its file is
renamed. What was overwritten before it was read is lost, as no reader can see it; lines read after a
truncation, or after a rotation whose old file is gone, are marked `truncated`.

The file must lie where the driver and all executors see it. Compressed rotated files are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import parsers
from ..session import share_code

SCHEMA = "value string, inode long, at long, truncated boolean"
#: Bytes of one range, of the digest at the head of a file, and of one step in a range.
SPLIT, HEAD, STEP = 64 << 20, 256, 1 << 20


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, stop) of a file of this number; `stop` is no farther than `end`, where complete lines end."""

    path: str
    inode: int
    first: int
    start: int
    stop: int
    end: int
    truncated: bool


def _complete(path: str) -> int:
    """The byte after the last line end; looks at the file's end only."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            step = min(STEP, at)
            f.seek(at - step)
            found = f.read(step).rfind(b"\n")
            if found >= 0:
                return at - step + found + 1
            at -= step
    return 0


def _digest(path: str, size: int) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read(size)).hexdigest()


def lines(r: Range) -> Iterator[pa.RecordBatch]:
    """The lines of a range, which starts with a line only if it is the first of its file."""
    with open(r.path, "rb") as f:
        if os.fstat(f.fileno()).st_ino != r.inode:
            raise OSError(f"{r.path} is another file now; the batch must be planned again")
        at = r.start
        if at > r.first:  # a line that began before belongs to the range before
            f.seek(at - 1)
            at += len(f.readline()) - 1
        f.seek(at)
        values, places, size = [], [], 0
        while at < r.stop:
            raw = f.readline(r.end - at)
            if not raw:
                break
            values.append(raw.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
            places.append(at)
            at, size = at + len(raw), size + len(raw)
            if size >= STEP:
                yield _batch(r, values, places)
                values, places, size = [], [], 0
        if values:
            yield _batch(r, values, places)


def _batch(r: Range, values: list[str], places: list[int]) -> pa.RecordBatch:
    n = len(values)
    return pa.record_batch([pa.array(values, pa.string()), pa.array([r.inode] * n, pa.int64()), pa.array(places, pa.int64()), pa.array([r.truncated] * n, pa.bool_())], names=["value", "inode", "at", "truncated"])


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        self.last = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"inode": 0, "byte": 0, "head": "", "size": 0}

    def latestOffset(self) -> dict:
        """The end of the complete lines now; while the file is away, the place last seen."""
        try:
            inode, byte = os.stat(self.path).st_ino, _complete(self.path)
            size = min(HEAD, byte)
            self.last = {"inode": inode, "byte": byte, "head": _digest(self.path, size), "size": size}
        except FileNotFoundError:
            pass
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if not end["inode"]:
            return []
        found = self._found()
        here = found.get(end["inode"], (0, self.path))[1]
        same = start["inode"] == end["inode"]
        if same and start["byte"] <= end["byte"] and (not start["size"] or _digest(here, start["size"]) == start["head"]):
            return self._ranges(here, end["inode"], start["byte"], end["byte"], False)
        out, lost = [], same
        if start["inode"] and not same:
            # A renamed file keeps its number; those that were renamed later are newer.
            old = found.get(start["inode"])
            lost = old is None or old[1] == here or start["size"] > 0 and _digest(old[1], start["size"]) != start["head"]
            if not lost:
                out += self._ranges(old[1], start["inode"], start["byte"], os.path.getsize(old[1]), False)
                between = sorted((when, inode, p) for inode, (when, p) in found.items() if when > old[0] and inode != end["inode"] and p != self.path)
                for _, inode, p in between:
                    out += self._ranges(p, inode, 0, os.path.getsize(p), False)
        return out + self._ranges(here, end["inode"], 0, end["byte"], lost)

    def _found(self) -> dict[int, tuple[int, str]]:
        """Files of this name and its renamed forms: number -> time of change, path."""
        folder, name = os.path.split(os.path.abspath(self.path))
        out = {}
        for x in os.scandir(folder):
            if (x.name == name or x.name.startswith(name + ".") or x.name.startswith(name + "-")) and x.is_file() and not x.name.endswith((".gz", ".bz2", ".xz", ".zst")):
                s = x.stat()
                out[s.st_ino] = (s.st_mtime_ns, x.path)
        return out

    def _ranges(self, path: str, inode: int, start: int, end: int, truncated: bool) -> list[Range]:
        return [Range(path, inode, start, a, min(a + self.split, end), end, truncated) for a in range(start, end, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return lines(partition)

    def commit(self, end: dict) -> None:
        """Spark's checkpoint holds the place."""


class GrowingFile(DataSource):
    """Format `growing_file`; option `split`: bytes of one range."""

    @classmethod
    def name(cls) -> str:
        return "growing_file"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)))


def stream_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """value, inode, at (byte), truncated of every line of a file that grows, is rotated and may be truncated."""
    share_code(spark).dataSource.register(GrowingFile)
    return spark.readStream.format("growing_file").option("split", split).load(path)


def stream_events(spark: SparkSession, path: str, parser: str, fallback: Column, split: int = SPLIT) -> DataFrame:
    """The events of such a file; lines that do not parse are left out. `truncated` says that lines before them may be lost."""
    e = parsers.PARSERS[parser](F.col("value"), fallback)
    rows = stream_lines(spark, path, split).select(e.alias("e"), "truncated").where("e is not null")
    return rows.select("e.*", F.col("truncated").alias("_lost")).withColumn("truncated", F.col("truncated") | F.col("_lost")).drop("_lost")
