"""The message log as a stream of changes: a Python data source whose offset is the highest id seen.

    spark.dataSource.register(BusTail)
    spark.readStream.format("bus_tail").load(log)      (change, id, consumed_at): 'message', and 'reset'

A batch takes the messages above the highest id of the batch before. Where the highest id has fallen, the log was begun
anew: a 'reset' comes first, and every message is new. Which files hold ids of the range is read off their footers, each
once; the files are dealt out to tasks, and a batch that is run again reads the same range.

What has been read comes from the append-only log of marks, whose files Spark's own file source follows.
"""

from __future__ import annotations

import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from veilframe.sources.messages import MARK_SCHEMA

CHANGES = "change STRING, id BIGINT, consumed_at TIMESTAMP"
ARROW = pa.schema([("change", pa.string()), ("id", pa.int64()), ("consumed_at", pa.timestamp("us", "UTC"))])
TASK_BYTES = 64 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), urllib.parse.unquote(urllib.parse.urlparse(path).path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Messages(InputPartition):
    """Files of which the ids above ``low`` and up to ``high`` are taken; none of them for a reset."""

    files: list[str]
    low: int
    high: int


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path
        self.known: dict[tuple[str, int], tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"last": 0}

    def _files(self) -> list[tuple[str, int, int, int]]:
        """(file, bytes, lowest id, highest id) of the log's files that hold rows."""
        fs, root = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        files, ranges = [f for f in found if f.is_file and f.base_name.endswith(".parquet") and f.base_name[0] not in "._"], {}
        for f in files:
            key = (f.path, f.size)
            ranges[key] = self.known.get(key) or self._range(fs, f.path)
        self.known = ranges
        return [(f.path, f.size, *ranges[f.path, f.size]) for f in files if ranges[f.path, f.size][1] >= ranges[f.path, f.size][0]]

    @staticmethod
    def _range(fs: pafs.FileSystem, path: str) -> tuple[int, int]:
        with fs.open_input_file(path) as source:
            file = pq.ParquetFile(source)
            at = file.schema_arrow.get_field_index("id")
            low, high = 1, 0
            for group in range(file.metadata.num_row_groups):
                stats = file.metadata.row_group(group).column(at).statistics
                if stats is None or not stats.has_min_max:
                    ids = file.read_row_group(group, ["id"]).column("id")
                    least, most = pc.min(ids).as_py(), pc.max(ids).as_py()
                else:
                    least, most = stats.min, stats.max
                if least is not None:
                    low, high = (least, most) if high < low else (min(low, least), max(high, most))
            return low, high

    def latestOffset(self) -> dict:
        return {"last": max((high for *_, high in self._files()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        begun_anew = end["last"] < start["last"]
        low = 0 if begun_anew else start["last"]
        parts: list[InputPartition] = [Messages([], 0, 0)] if begun_anew else []
        taken, size = [], 0
        for path, length, least, most in sorted(self._files()):
            if most > low and least <= end["last"]:
                taken.append(path)
                size += length
                if size >= TASK_BYTES:
                    parts.append(Messages(taken, low, end["last"]))
                    taken, size = [], 0
        return [*parts, Messages(taken, low, end["last"])] if taken else parts

    def read(self, partition: Messages) -> Iterator[pa.RecordBatch]:
        if not partition.files:
            yield pa.record_batch([pa.array(["reset"]), pa.nulls(1, pa.int64()), pa.nulls(1, ARROW.field(2).type)], schema=ARROW)
        fs, _ = filesystem(self.path)
        for path in partition.files:
            with fs.open_input_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(columns=["id", "consumed_at"]):
                    ids = batch.column("id")
                    part = batch.filter(pc.and_(pc.greater(ids, partition.low), pc.less_equal(ids, partition.high)))
                    read_at = part.column("consumed_at")
                    read_at = read_at.cast(pa.timestamp("us"), safe=False) if read_at.type.tz is None else read_at
                    yield pa.record_batch([pa.array(["message"] * part.num_rows, pa.string()), part.column("id"), read_at.cast(ARROW.field(2).type, safe=False)], schema=ARROW)


class BusTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bus_tail"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])


def tail(spark: SparkSession, log: str, marks: str) -> DataFrame:
    """What happens on the bus, as a stream: (change, id, consumed_at) with 'message', 'consumed' and 'reset'.

    A message that is marked as read gives 'consumed' once a mark, also when both come in one batch. ``marks`` is a folder.
    """
    spark.dataSource.register(BusTail)
    messages = spark.readStream.format("bus_tail").load(log)
    read = spark.readStream.schema(MARK_SCHEMA).parquet(marks)
    return messages.unionByName(read.select(F.lit("consumed").alias("change"), "id", "consumed_at"))
