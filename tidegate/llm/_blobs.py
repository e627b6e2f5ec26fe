"""Files that executors write to and read from the shared folder.

Executors reach the folder by its URI through pyarrow's file systems (local, hdfs, s3, gs), which need
no Spark context. A task writes under a name of its own attempt; only names that successful tasks
return are part of the result, so repeated and speculative attempts leave at most unused files.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def open_fs(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in root and not root.startswith("file:"):
        return pafs.LocalFileSystem(), root
    if root.startswith("file:") and not root.startswith("file://"):
        root = "file://" + root[len("file:") :]
    return pafs.FileSystem.from_uri(root)


class Writer:
    """One file at a time, of about most bytes each; closed files are in names."""

    def __init__(self, root: str, suffix: str):
        self.fs, self.root = open_fs(root)
        self.suffix = suffix
        self.fs.create_dir(self.root, recursive=True)

    def create(self) -> tuple[str, object]:
        name = f"{uuid.uuid4().hex}{self.suffix}"
        return name, self.fs.open_output_stream(f"{self.root}/{name}", compression=None)


def read_file(root: str, name: str) -> bytes:
    fs, path = open_fs(root)
    with fs.open_input_file(f"{path}/{name}") as f:
        return f.read()


def open_file(root: str, name: str):
    fs, path = open_fs(root)
    return fs.open_input_file(f"{path}/{name}")
