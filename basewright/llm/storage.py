"""Plain files in the folder that all executors share, written whole and renamed into place."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs) and the path in it."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Output:
    """A file that appears under its name only when it is complete, so that repeated or lost tasks do no harm."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = opened(folder)
        self.path, self.part = f"{self.folder}/{name}", f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.folder, recursive=True)
        self.stream, self.size = self.fs.open_output_stream(self.part), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        if self.fs.get_file_info(self.path).type != fs.FileType.NotFound:  # of an attempt that was lost later
            self.fs.delete_file(self.path)
        self.fs.move(self.part, self.path)


def reader(folder: str, name: str):
    where, path = opened(folder)
    return where.open_input_file(f"{path}/{name}")
