"""One file a row, under the row's own name, as a data source with task commit and abort.

Spark's file writers choose the names of their files; episode files are found by name (S1). Each task
writes a file below a folder of its own attempt and renames it to its place, so a task that is tried
again, or runs twice, replaces a file by the same file. With ``overwrite`` all files are staged next to
the target and the job's commit renames the folder: readers see all files or none, and a failed job
leaves the target as it was. ``append`` renames into the target itself.

Names must be plain and different; a null name, a separator in it or a name that a task meets twice is
an error (``sinks.write_named`` deals rows by name, so equal names meet). With the option ``folders`` a
name may be a path below the target.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a path or URI."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: int
    attempt: str


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, folders: bool = False):
        self.target = path.rstrip("/")
        self.overwrite = overwrite
        self.folders = folders
        self.staging = f"{self.target}.writing-{uuid.uuid4().hex}"

    def _plain(self, name: str | None) -> bool:
        parts = (name or "").split("/")
        return all(p not in ("", ".", "..") for p in parts) and (self.folders or len(parts) == 1)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, staging = file_system(self.staging)
        _, target = file_system(self.target)
        place = f"{staging}/files" if self.overwrite else target
        attempt = f"{staging}/attempt-{TaskContext.get().taskAttemptId()}"
        for folder in (place, attempt):
            fs.create_dir(folder, recursive=True)
        seen: set[str] = set()
        for batch in iterator:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not self._plain(name) or name in seen:
                    raise ValueError(f"file name {name!r} is missing, repeated or not plain")
                seen.add(name)
                folder, _, last = name.rpartition("/")
                if folder:
                    fs.create_dir(f"{place}/{folder}", recursive=True)
                with fs.open_output_stream(f"{attempt}/{last}") as f:
                    f.write((text or "").encode())
                fs.move(f"{attempt}/{last}", f"{place}/{name}")
        return Written(len(seen), attempt)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, staging = file_system(self.staging)
        _, target = file_system(self.target)
        if self.overwrite:
            if fs.get_file_info(target).type != pafs.FileType.NotFound:
                fs.delete_dir(target)
            fs.create_dir(f"{staging}/files", recursive=True)  # a job without rows
            fs.move(f"{staging}/files", target)
        else:
            fs.create_dir(target, recursive=True)
        with fs.open_output_stream(f"{target}/_SUCCESS"):
            pass
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, staging = file_system(self.staging)
        if fs.get_file_info(staging).type != pafs.FileType.NotFound:
            fs.delete_dir(staging)


class NamedFiles(DataSource):
    """``df.select(name, text).write.format("named_files").mode(...).save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], overwrite, self.options.get("folders", "") == "true")
