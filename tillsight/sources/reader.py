"""Captured job folders as a Spark data source, for batches and for streams.

    register(spark)
    spark.read.format("captures").option("path", root).load()
    spark.readStream.format("captures").option("path", root).load()

The driver lists the devices below the root and nothing else. A task has a device and a slice of its job folders by a hash of
their names; it lists them, opens the markers, and reads and checks the files of committed jobs (``capture.checked``), so neither
markers nor bytes pass through the driver. Any store that pyarrow opens by its URI works.

A stream's offset is a time: a batch takes the jobs whose marker was written after the last offset and no later than the new
one, which lies ``settle`` seconds (2) back, for markers that a store shows late. Markers are written once, so a batch that is run
again has the same jobs.

Defined cases: a folder without a regular marker is invisible; a file that is a link, larger than MAX_FILE or of another size
than listed when it is read is named in ``failures`` and has no content; a root without devices gives no rows.
"""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tillsight.plans.shipping import ship
from tillsight.sources import capture

MARKER = ".ready"


@dataclass
class _Slice(InputPartition):
    """A device's folders whose name's hash has this remainder, with markers written in ``(after, until]`` (nanoseconds)."""

    device: str
    slice: int
    after: int
    until: int


def _store(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:").removeprefix("//") if path.startswith("file:") else path)


class _Folders:
    def __init__(self, options: dict[str, str]):
        self.root, self.slices, self.settle, self.most = options["path"].rstrip("/"), int(options.get("slices", 4)), float(options.get("settle", 2)), int(options.get("maxfile", capture.MAX_FILE))

    def _listed(self, where: str) -> list:
        from pyarrow import fs

        store, _ = _store(self.root)
        return sorted(store.get_file_info(fs.FileSelector(where, allow_not_found=True)), key=lambda i: i.base_name)

    def devices(self) -> list[str]:
        _, top = _store(self.root)
        return [i.base_name for i in self._listed(top) if i.type.name == "Directory"]

    def slices_of(self, after: int = -1, until: int = 1 << 62) -> list[_Slice]:
        return [_Slice(d, k, after, until) for d in self.devices() for k in range(self.slices)]

    def rows(self, part: _Slice | None) -> Iterator[tuple]:
        if part is None:  # Spark's stand-in where there are no partitions
            return
        store, top = _store(self.root)
        for folder in self._listed(f"{top}/{part.device}"):
            if folder.type.name != "Directory" or zlib.crc32(folder.base_name.encode()) % self.slices != part.slice:
                continue
            files = {i.base_name: i for i in self._listed(folder.path)}
            marker = files.get(MARKER)
            if marker is None or marker.type.name != "File" or self._is_link(store, marker.path) or not part.after < marker.mtime_ns <= part.until:
                continue
            have, wrong = {}, []
            for name, info in files.items():
                if name == MARKER or info.type.name != "File":
                    continue
                have[name] = self._read(store, info, wrong)
            body = self._read(store, marker, wrong) or b""
            yield capture.checked(f"{self.root}/{part.device}/{folder.base_name}", part.device, have, body.decode("utf-8", "replace"), wrong)

    @staticmethod
    def _is_link(store, path: str) -> bool:
        return store.type_name == "local" and os.path.islink(path)

    def _read(self, store, info, wrong: list[str]) -> bytes | None:
        if self._is_link(store, info.path):
            wrong.append(f"link:{info.base_name}")
        elif info.size > self.most:
            wrong.append(f"large:{info.base_name}")
        else:
            with store.open_input_stream(info.path) as f:
                body = f.read()
            if len(body) == info.size:
                return body
            wrong.append(f"busy:{info.base_name}")
        return None


class _Batch(_Folders, DataSourceReader):
    def partitions(self) -> list[_Slice]:
        return self.slices_of()

    def read(self, partition: _Slice) -> Iterator[tuple]:
        yield from self.rows(partition)


class _Stream(_Folders, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        return self.slices_of(start["until"], end["until"])

    def read(self, partition: _Slice) -> Iterator[tuple]:
        yield from self.rows(partition)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return capture.JOBS

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format ``captures`` known to the session and its workers."""
    ship(spark)
    spark.dataSource.register(CaptureSource)
