"""Text files of a stream that roll by size, age and hour, and are seen once their batch is done."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

FORMAT = "sluice_rolling"


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: (folder, pending path)."""

    files: list[tuple[str, str]]


class RollingWriter(DataSourceStreamWriter):
    """Tasks write pending files beside the result; when all tasks of a batch are done, its files get their names.

    A name tells the batch and the file's number in it, so a batch that is run again after a failure replaces what it left. Pending files of failed tasks are never named and go with the batch's others.
    """

    def __init__(self, options: dict):
        self.path, self.prefix, self.suffix = options["path"], options.get("prefix", "part"), options.get("suffix", ".log")
        self.most_bytes, self.most_s, self.by_hour = int(options.get("bytes", 128 << 20)), float(options.get("seconds", 900)), options.get("hourly", "true") == "true"
        self.run = uuid.uuid4().hex

    def _root(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, iterator: Iterator) -> Written:
        files, root = self._root()
        pending = f"{root}/.pending/{self.run}"
        files.create_dir(pending, recursive=True)
        done, out, folder, size, since = [], None, "", 0, 0.0
        try:
            for (value, *_) in iterator:
                now = time.time()
                hour = datetime.fromtimestamp(now, UTC).strftime("%Y-%m-%d--%H") if self.by_hour else ""
                if out is not None and (size >= self.most_bytes or now - since >= self.most_s or hour != folder):
                    out.close()
                    out = None
                if out is None:
                    name = f"{pending}/{uuid.uuid4().hex}"
                    out, folder, size, since = files.open_output_stream(name), hour, 0, now
                    done.append((folder, name))
                line = ("" if value is None else value).encode() + b"\n"
                out.write(line)
                size += len(line)
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def _named(self, batch: int) -> str:
        return f"{self.prefix}-{batch:08d}-"

    def commit(self, messages: list, batchId: int) -> None:
        files, root = self._root()
        files.create_dir(root, recursive=True)
        left = [f.path for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.base_name.startswith(self._named(batchId)) and "/.pending/" not in f.path]
        for path in left:
            files.delete_file(path)
        every = sorted(x for m in messages if m is not None for x in m.files)
        for k, (folder, name) in enumerate(every):
            into = f"{root}/{folder}" if folder else root
            files.create_dir(into, recursive=True)
            files.move(name, f"{into}/{self._named(batchId)}{k:05d}{self.suffix}")
        self._forget(files, root)

    def abort(self, messages: list, batchId: int) -> None:
        self._forget(*self._root())

    def _forget(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/.pending/{self.run}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/.pending/{self.run}")


class RollingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def streamWriter(self, schema, overwrite: bool) -> RollingWriter:
        return RollingWriter(dict(self.options))


def rolling_files(stream: DataFrame, path: str, checkpoint: str, text: str = "value", prefix: str = "part", suffix: str = ".log", most_bytes: int = 128 << 20, most_seconds: float = 900, hourly: bool = True, every: str = "10 seconds"):
    """A started query that writes text lines to files prefix-batch-number suffix under path (a folder that all machines mount, or a URI that pyarrow opens), with hourly in a folder for each hour (UTC) of arrival.

    A task begins a new file where the one before has most_bytes or was begun most_seconds ago; a batch's end closes files too. Files are seen when their batch is done. A null is an empty line.
    """
    stream.sparkSession.dataSource.register(RollingFiles)
    options = {"path": path, "prefix": prefix, "suffix": suffix, "bytes": str(most_bytes), "seconds": str(most_seconds), "hourly": str(hourly).lower(), "checkpointLocation": checkpoint}
    return stream.selectExpr(f"CAST(`{text}` AS STRING) AS value").writeStream.format(FORMAT).options(**options).trigger(processingTime=every).start()
