"""A sink that shows all of a write or nothing of it: JSON lines in parts, and a manifest that names those that count.

Tasks write parts under names of their own, and tell the driver what they have written. The commit replaces the manifest, by
one rename; readers go by it. A task that is tried again leaves a part that no manifest names, and the commit deletes it; a
write that fails deletes what it wrote and leaves the manifest as it was. A stream's batch is in the manifest with its number,
so a batch that is committed again changes nothing. Folders are reached by their URI, through Arrow's file systems."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from .landed import _store

MANIFEST = "manifest.json"


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    rows: int


def _read_manifest(store, base: str) -> dict:
    from pyarrow import fs

    if store.get_file_info(f"{base}/{MANIFEST}").type == fs.FileType.NotFound:
        return {"parts": [], "rows": 0, "batches": {}}
    with store.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


class _Parts:
    def __init__(self, folder: str):
        self.folder, self.write_id = folder, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Part:
        store, base = _store(self.folder)
        store.create_dir(base, recursive=True)
        place, n = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        name = f"part-{self.write_id}-{place:05d}-{uuid.uuid4().hex[:8]}.jsonl"
        with store.open_output_stream(f"{base}/{name}") as out:
            for r in rows:
                out.write((json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) + "\n").encode())
                n += 1
        return Part(place, name, n)

    def _publish(self, parts: list[Part], keep: dict, batch: int | None) -> None:
        store, base = _store(self.folder)
        store.create_dir(base, recursive=True)
        named = [p.name for p in sorted(parts, key=lambda p: p.partition) if p.rows]
        new = {"parts": keep["parts"] + named, "rows": keep["rows"] + sum(p.rows for p in parts), "batches": dict(keep["batches"])}
        if batch is not None:
            new["batches"][str(batch)] = named
        part = f"{base}/.{MANIFEST}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(json.dumps(new).encode())
        store.move(part, f"{base}/{MANIFEST}")
        self._sweep(set(new["parts"]))

    def _sweep(self, counted: set[str]) -> None:
        """Parts of this write that don't count, and those that an overwriting one has replaced."""
        from pyarrow import fs

        store, base = _store(self.folder)
        for x in store.get_file_info(fs.FileSelector(base)):
            if x.is_file and x.base_name.startswith("part-") and x.base_name not in counted and (self.write_id in x.base_name or self.replaces):
                store.delete_file(x.path)

    replaces = False

    def _undo(self) -> None:
        store, base = _store(self.folder)
        self.replaces = False
        self._sweep(set(_read_manifest(store, base)["parts"]))


class ExportWriter(_Parts, DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        super().__init__(folder)
        self.replaces = overwrite

    def commit(self, messages: list[Part | None]) -> None:
        keep = {"parts": [], "rows": 0, "batches": {}} if self.replaces else _read_manifest(*_store(self.folder))
        self._publish([m for m in messages if m], keep, None)

    def abort(self, messages: list[Part | None]) -> None:
        self._undo()


class ExportStream(_Parts, DataSourceStreamWriter):
    def commit(self, messages: list[Part | None], batchId: int) -> None:
        keep = _read_manifest(*_store(self.folder))
        if str(batchId) in keep["batches"]:
            self._undo()
        else:
            self._publish([m for m in messages if m], keep, batchId)

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        self._undo()


class Export(DataSource):
    """Option: path, of a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "whole_export"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> ExportWriter:
        return ExportWriter(self.options["path"], overwrite)

    def streamWriter(self, schema, overwrite: bool) -> ExportStream:
        return ExportStream(self.options["path"])


def read_export(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What counts of an export, by its manifest."""
    parts = _read_manifest(*_store(folder))["parts"]
    return spark.read.schema(schema).json([f"{folder.rstrip('/')}/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)
