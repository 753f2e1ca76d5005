"""A sink that writes texts to files of given names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Folder, below the target, of files that are not committed yet.
STAGING = ".staging"
SCHEMA = "name string, part bigint, content string"


def _open(uri: str):
    """File system and path; a plain path is local, which a cluster mounts everywhere."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{uri}")


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its own staging folder and the number of files there."""

    folder: str
    files: int


class BookFiles(DataSource):
    """`df.write.format("book_files").save(path)` for rows (name, part, content).

    Rows of a name that follow each other become one file. A task writes into a folder of its own; the driver moves
    the files of all tasks into place once every task has ended, and removes them if one has failed. A file that is
    there already is replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "book_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if [f.name for f in schema.fields] != [f.split()[0] for f in SCHEMA.split(", ")]:
            raise ValueError(f"book_files takes {SCHEMA}, not {schema.simpleString()}")
        return BookWriter(self.options["path"].rstrip("/"))


class BookWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.run = path, f"{path}/{STAGING}/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, run = _open(self.run)
        folder = f"{run}/{uuid.uuid4().hex}"  # an attempt that runs again has another one
        system.create_dir(folder, recursive=True)
        name, out, files = None, None, 0
        for batch in iterator:
            for row_name, content in zip(batch.column(0).to_pylist(), batch.column(2)):
                if not row_name or "/" in row_name or row_name.startswith("."):
                    raise ValueError(f"{row_name!r} is no file name")
                if row_name != name:
                    if out:
                        out.close()
                    name, out, files = row_name, system.open_output_stream(f"{folder}/{row_name}", compression=None), files + 1
                if content.is_valid:
                    out.write(content.as_buffer())
        if out:
            out.close()
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, target = _open(self.path)
        for message in filter(None, messages):
            found = system.get_file_info(fs.FileSelector(message.folder))
            if len(found) != message.files:
                raise RuntimeError(f"{message.folder}: {len(found)} of {message.files} files")
            for file in found:
                system.move(file.path, f"{target}/{file.base_name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, run = _open(self.run)
        from pyarrow import fs

        if system.get_file_info(run).type != fs.FileType.NotFound:
            system.delete_dir(run)
