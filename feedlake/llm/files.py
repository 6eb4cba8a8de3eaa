"""Files that tasks write and read in a shared folder, by URI."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI such as file:///x, file:/x, s3://x, hdfs://x or an absolute path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class NewFile:
    """A file with a name of its own. Readers learn the name from the rows that the task returns, so what a lost or
    repeated task leaves behind is never read."""

    def __init__(self, folder: str, suffix: str):
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}{suffix}"
        self.uri = f"{folder.rstrip('/')}/{self.name}"
        self.out = store.open_output_stream(f"{path}/{self.name}", compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()


def read_stream(uri: str):
    store, path = open_store(uri)
    return store.open_input_stream(path, compression=None)


def read_random(uri: str):
    store, path = open_store(uri)
    return store.open_input_file(path)
