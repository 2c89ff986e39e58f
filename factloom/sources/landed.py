"""A source of landed JSON-lines files, by Spark's Python data source API, as a table and as a stream: one partition a file,
with the filters that the files' names can answer pushed down to the choice of files. Files are listed and opened by their URI, through
Arrow's file systems, so the folder may be in any store that these reach. A line that is no JSON object becomes a row
with its text as payload and the error, rather than ending the job."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

SCHEMA = "source string, source_id string, url string, fetched_at string, payload string, error string"


def _store(uri: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"[A-Za-z][\w+.-]*://", uri) else f"file://{uri}")


class _File(InputPartition):
    def __init__(self, path: str, source: str):
        super().__init__(path)
        self.path, self.source = path, source


class LandedReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.source = folder, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source",):
                self.source = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = _store(self.folder)
        names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(base)) if x.is_file and x.base_name.endswith(".jsonl"))
        return [_File(f"{self.folder.rstrip('/')}/{x}", x.split("__")[0]) for x in names if self.source in (None, x.split("__")[0])] or [_File("", "")]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _records(partition)


def _records(file: _File, keywords: tuple[str, ...] = ()) -> Iterator[tuple]:
    """The rows of a file; with keywords (in small letters), those lines that hold one of them."""
    if not file.path:
        return
    store, path = _store(file.path)
    with store.open_input_stream(path) as raw:
        for line in io.TextIOWrapper(raw, encoding="utf-8"):
            if not line.strip() or keywords and not any(k in line.lower() for k in keywords):
                continue
            try:
                x = json.loads(line)
                if not isinstance(x, dict):
                    raise ValueError("not a record")
            except ValueError as e:
                yield file.source, None, None, None, line.rstrip("\n"), str(e)
            else:
                yield file.source, x.get("source_id"), x.get("url"), x.get("fetched_at"), json.dumps(x.get("payload"), sort_keys=True), None


class _Named:
    """What a file's name says: <source>__<area>__<stamp>__<records>.jsonl. A run of a source has one stamp in all its areas; stamps
    sort by time."""

    def __init__(self, name: str):
        self.name = name
        self.source, self.area, self.stamp, self.records = name.removesuffix(".jsonl").split("__")


class LandedStream(DataSourceStreamReader):
    """An offset holds for each source the stamp of the last run that counts. A run below its source's band (least records of a
    healthy run, over all areas) isn't counted: the source's offset stays, until a healthy run moves it past both, and then the
    weak run's files are read with it. So what a broken page left out isn't taken for all there is, and nothing is lost.

    Files are chosen by their names: sources and areas that aren't asked for are never opened. Each file is a partition, read by
    the executors; the driver only lists names."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.bands = json.loads(options.get("bands", "{}"))
        self.sources, self.areas, self.keywords = (tuple(x for x in options.get(k, "").lower().split(",") if x) for k in ("sources", "areas", "keywords"))

    def _files(self) -> list[_Named]:
        from pyarrow import fs

        store, base = _store(self.folder)
        names = [x.base_name for x in store.get_file_info(fs.FileSelector(base)) if x.is_file and x.base_name.endswith(".jsonl") and x.base_name.count("__") == 3]
        files = [_Named(n) for n in sorted(names)]
        return [f for f in files if not self.sources or f.source.lower() in self.sources]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        runs: dict[tuple[str, str], int] = {}
        for f in self._files():
            runs[f.source, f.stamp] = runs.get((f.source, f.stamp), 0) + int(f.records)
        out: dict[str, str] = {}
        for (source, stamp), records in runs.items():
            if records >= self.bands.get(source, 0):
                out[source] = max(stamp, out.get(source, ""))
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = [f for f in self._files() if start.get(f.source, "") < f.stamp <= end.get(f.source, "") and (not self.areas or f.area.lower() in self.areas)]
        return [_File(f"{self.folder.rstrip('/')}/{f.name}", f.source) for f in new] or [_File("", "")]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _records(partition, self.keywords)

    def commit(self, end: dict) -> None:
        pass


class LandedSource(DataSource):
    """Files are named <source>__<anything>.jsonl, in a folder that driver and executors share. Option: path; of a stream (see
    LandedStream for names) also bands (JSON: source to least records of a run), sources, areas and keywords (by commas)."""

    @classmethod
    def name(cls) -> str:
        return "landed_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options["path"])

    def streamReader(self, schema) -> LandedStream:
        return LandedStream(self.options)
