"""Recordings as one JSON document each, written as a stream of events: a Python data source with a commit.

Rows come sorted by recording; a task keeps one document open and writes each event as it comes, so a recording of any
length passes through without being held. Documents lie in a folder of the task attempt until all tasks are done; the
commit moves them to ``<root>/<id>.json``, and an aborted job leaves nothing there.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from veilframe.sources.bus_tail import filesystem

LINES = "rec_id STRING, line STRING, is_header BOOLEAN"


@dataclass
class Attempt(WriterCommitMessage):
    folder: str


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.pending = f"{self.root}/_pending/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        fs, folder = filesystem(f"{self.pending}/{uuid.uuid4().hex}")
        fs.create_dir(folder, recursive=True)
        current, out, begun = None, None, False
        for batch in iterator:
            for rec, line, is_header in zip(*[batch.column(c).to_pylist() for c in ("rec_id", "line", "is_header")], strict=True):
                if out is None or rec != current:
                    if out is not None:
                        out.write(b"]}")
                        out.close()
                    current, begun = rec, False
                    out = fs.open_output_stream(f"{folder}/{urllib.parse.quote(rec, safe='')}.json")
                    head = line if is_header else json.dumps({"id": rec})
                    out.write(f'{head[:-1]},"events":['.encode())
                if not is_header:
                    out.write((("," if begun else "") + line).encode())
                    begun = True
        if out is not None:
            out.write(b"]}")
            out.close()
        return Attempt(folder)

    def commit(self, messages: list[Attempt | None]) -> None:
        fs, root = filesystem(self.root)
        for message in messages:
            if message is not None:
                for file in fs.get_file_info(pafs.FileSelector(message.folder)):
                    fs.move(file.path, f"{root}/{file.base_name}")
        self._clear()

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, pending = filesystem(self.pending)
        if fs.get_file_info(pending).type == pafs.FileType.Directory:
            fs.delete_dir(pending)


class RecordingDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording_documents"

    def schema(self) -> str:
        return LINES

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def write_recording_documents(headers: DataFrame, events: DataFrame, root: str) -> None:
    """One document per recording below ``root``; recordings without a header have their id only, those without events none.

    Events go by time, then by event and data. A document that is written again replaces the one before.
    """
    headers.sparkSession.dataSource.register(RecordingDocuments)
    head = F.struct(
        F.col("rec_id").alias("id"), F.col("started_at").alias("startedAt"), F.col("duration_ms").alias("durationMs"), "params",
        F.col("model").alias("prodModel"), "verdict", "summary", F.col("event_count").alias("eventCount"),
    )
    first = headers.select("rec_id", F.to_json(head).alias("line"), F.lit(True).alias("is_header"), F.lit(None).cast("bigint").alias("t_ms"))
    each = events.select("rec_id", F.to_json(F.struct(F.col("t_ms").alias("t"), "event", "data")).alias("line"), F.lit(False).alias("is_header"), "t_ms")
    lines = first.unionByName(each).where(F.col("rec_id").isNotNull())
    ordered = lines.repartition("rec_id").sortWithinPartitions("rec_id", F.desc("is_header"), "t_ms", "line")
    ordered.select("rec_id", "line", "is_header").write.format("recording_documents").mode("append").save(root)
