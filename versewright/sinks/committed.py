"""Files written whole or not at all: a data source writer that stages, commits by messages, and can fall back.

    spark.dataSource.register(CommittedFiles)
    files.write.format("committed_files").mode("append").option("recovery", "file:///data/recovered").save("file:///data/out")

Each attempt of a task writes to a folder of its own below the target, which no reader looks into. Only attempts whose message
reaches the commit are moved to their places; what a failed or repeated attempt has left goes with the staging folder.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STAGING = "_staging"


@dataclass
class Written(WriterCommitMessage):
    """An attempt's folder and how many files it has."""

    folder: str
    files: int


def store(uri: str):
    """(file system, path) of a URI, or of a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def inside(path: str) -> str:
    """A path below a folder, ValueError if it leads out of it or is none."""
    clean = posixpath.normpath((path or "").replace("\\", "/"))
    if clean in ("", ".") or clean.startswith(("/", "../")) or clean == ".." or clean.split("/")[0] == STAGING:
        raise ValueError(f"not a path inside the folder: {path!r}")
    return clean


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.target, self.recovery = options["path"].rstrip("/"), options.get("recovery", "").rstrip("/")
        self.job = f"{STAGING}/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = store(self.target)
        folder, n = f"{root}/{self.job}/{uuid.uuid4().hex}", 0
        fs.create_dir(folder, recursive=True)
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                place = f"{folder}/{inside(path)}"
                fs.create_dir(posixpath.dirname(place), recursive=True)
                with fs.open_output_stream(place) as out:
                    out.write(content if isinstance(content, bytes) else (content or "").encode())
                n += 1
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = store(self.target)
        back = store(self.recovery) if self.recovery else None
        done, placed = [m for m in messages if m is not None], []
        try:
            for m in done:
                self._moved(fs, m, root, placed)
        except OSError:
            for place in placed:  # the files that weren't there before
                fs.delete_file(place)
            if back is None:
                raise
            for m in done:  # all of them, so that what is there is whole
                self._copied(fs, m, *back)
        self.abort([])

    def _files(self, fs, folder: str) -> list[str]:
        from pyarrow.fs import FileSelector

        return sorted(x.path for x in fs.get_file_info(FileSelector(folder, recursive=True)) if x.is_file)

    def _moved(self, fs, message: Written, root: str, placed: list[str]) -> None:
        from pyarrow.fs import FileType

        files = self._files(fs, message.folder)
        if len(files) != message.files:
            raise ValueError(f"{len(files)} of {message.files} files are in {message.folder}")
        for f in files:
            place = f"{root}/{f[len(message.folder) + 1 :]}"
            fs.create_dir(posixpath.dirname(place), recursive=True)
            fresh = fs.get_file_info(place).type == FileType.NotFound
            fs.copy_file(f, place)  # what is staged stays until all of it is in place
            if fresh:
                placed.append(place)

    def _copied(self, fs, message: Written, other, root: str) -> None:
        for f in self._files(fs, message.folder):
            place = f"{root}/{f[len(message.folder) + 1 :]}"
            other.create_dir(posixpath.dirname(place), recursive=True)
            with fs.open_input_stream(f) as src, other.open_output_stream(place) as out:
                while chunk := src.read(1 << 20):
                    out.write(chunk)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileType

        fs, root = store(self.target)
        if fs.get_file_info(f"{root}/{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")
        if fs.get_file_info(f"{root}/{STAGING}").type == FileType.Directory and not self._any(fs, f"{root}/{STAGING}"):
            fs.delete_dir(f"{root}/{STAGING}")

    def _any(self, fs, folder: str) -> bool:
        from pyarrow.fs import FileSelector

        return bool(fs.get_file_info(FileSelector(folder)))


class CommittedFiles(DataSource):
    """A sink for (path string, content string or binary): a file for each row, below the folder it is saved to. A path that leads
    out of the folder fails the job. Of rows with the same path the last one committed stays. Option recovery: a folder that gets
    all files if they can't be put into place."""

    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)
