"""Folder listings as a Spark source (S11): files and folders as rows, a task for each folder.

``binaryFile`` knows files only, so an empty ``*_vct`` folder is not seen, and it
lists on the driver. Here the driver lists one level below each registered
folder, and a task lists each of those in full, through Arrow's file systems
(local, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cytotide.sources.zones import arrow_path

FORMAT = "cytotide_listing"
SCHEMA = "root string, path string, is_dir boolean"
BATCH_ROWS = 10_000


class _Folder(InputPartition):
    """What a task lists: everything below ``path`` (a file or folder found below ``root``), as itself or not."""

    def __init__(self, root: str, path: str, is_dir: bool):
        super().__init__(path)
        self.root, self.path, self.is_dir = root, path, is_dir


def _entries(system, path: str, recursive: bool) -> list:
    from pyarrow import fs
    return system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=recursive))


class _ListingReader(DataSourceReader):
    def __init__(self, options):
        self.roots = json.loads(options["roots"])

    def partitions(self):
        from pyarrow import fs
        parts = []
        for root in self.roots:
            system, path = arrow_path(root)
            parts += [_Folder(root, e.path, e.type == fs.FileType.Directory) for e in _entries(system, path, False)]
        return parts

    def read(self, partition):
        import pyarrow as pa
        from pyarrow import fs
        if not isinstance(partition, _Folder):  # nothing was found
            return
        system, base = arrow_path(partition.root)
        rows = [(partition.path, partition.is_dir)]
        if partition.is_dir:
            rows += [(e.path, e.type == fs.FileType.Directory) for e in _entries(system, partition.path, True)]
        # paths as the registered folder is written: its scheme stays
        prefix = partition.root.rstrip("/")
        for at in range(0, len(rows), BATCH_ROWS):
            some = rows[at:at + BATCH_ROWS]
            yield pa.RecordBatch.from_pydict({"root": [partition.root] * len(some), "path": [prefix + p[len(base.rstrip("/")):] for p, _ in some],
                                              "is_dir": [d for _, d in some]})


class ListingDataSource(DataSource):
    """Everything below some folders."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _ListingReader(self.options)


def exists(path: str) -> bool:
    """True if ``path`` is an existing folder."""
    from pyarrow import fs
    system, at = arrow_path(path)
    return system.get_file_info(at).type == fs.FileType.Directory


def list_tree(spark: SparkSession, roots) -> DataFrame:
    """(root, path, is_dir) of every file and folder below the roots. Roots that don't exist are warned of."""
    from cytotide.session import ship_code
    ship_code(spark)
    spark.dataSource.register(ListingDataSource)
    roots = [roots] if isinstance(roots, str) else list(dict.fromkeys(roots))
    missing = [r for r in roots if not exists(r)]
    if missing:
        warnings.warn(f"registered folders that don't exist: {', '.join(missing)}", stacklevel=2)
    return spark.read.format(FORMAT).option("roots", json.dumps([r for r in roots if r not in missing])).load()
