"""A data source that lists folders and hashes files in the tasks: empty files count, and files of any size are read in blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK_BYTES = 1 << 20
SPLIT_FOLDERS = 256  # folders from which on the driver's listing stops and tasks go on below them
SCHEMA = "path string, bytes bigint, sha256 string"


class Folder(InputPartition):
    """One folder; with ``deep`` also all below it."""

    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.glob = options["path"], options.get("glob", "*")
        self.hashed = options.get("sha256", "true").lower() == "true"

    def _system(self):
        from pyarrow import fs

        if ":" not in self.root:
            return fs.LocalFileSystem(), self.root.rstrip("/")
        system, path = fs.FileSystem.from_uri(self.root.replace("file:/", "file:///", 1) if self.root.startswith("file:/") and not self.root.startswith("file://") else self.root)
        return system, path.rstrip("/")

    @staticmethod
    def _children(system, folder: str):
        from pyarrow import fs

        return system.get_file_info(fs.FileSelector(folder, recursive=False))

    def partitions(self) -> list[Folder]:
        """Folders level by level until there are enough for the tasks; only names of folders stay on the driver."""
        from pyarrow import fs

        system, root = self._system()
        if system.get_file_info(root).type != fs.FileType.Directory:
            raise FileNotFoundError(root)
        flat, level = [], [root]
        while level and len(level) < SPLIT_FOLDERS:
            flat += [Folder(p, False) for p in level]
            level = [c.path for p in level for c in self._children(system, p) if c.type == fs.FileType.Directory]
        return flat + [Folder(p, True) for p in level]

    def read(self, partition: Folder) -> Iterator[tuple[str, int, str | None]]:
        from pyarrow import fs

        system, _ = self._system()
        todo = [partition.path]
        while todo:
            for entry in self._children(system, todo.pop()):
                if entry.type == fs.FileType.Directory:
                    if partition.deep:
                        todo.append(entry.path)
                elif fnmatchcase(entry.base_name, self.glob):
                    yield entry.path, int(entry.size), self._digest(system, entry.path) if self.hashed else None

    @staticmethod
    def _digest(system, path: str) -> str:
        digest = hashlib.sha256()
        with system.open_input_stream(path) as stream:
            while block := stream.read(BLOCK_BYTES):
                digest.update(block)
        return digest.hexdigest()


class FolderFiles(DataSource):
    """``spark.read.format("folder_files")`` with options ``path``, ``glob`` (of the file name) and ``sha256`` (false: list only)."""

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def folder_files(spark: SparkSession, path: str, glob: str = "*", sha256: bool = True):
    spark.dataSource.register(FolderFiles)
    return spark.read.format("folder_files").option("path", path).option("glob", glob).option("sha256", str(sha256).lower()).load()
