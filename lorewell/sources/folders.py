"""Article folders as a data source: one scan gives each folder's article and sidecar, files of no bytes too."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "article_key string, content string, sidecar string"
#: Folders that one task reads, about; and bytes that it hands on at a time.
FOLDERS, BATCH_BYTES = 500, 8 << 20
#: Kinds of paths that can be opened in a task; others are left to Spark's own readers.
OPENED = ("", "file", "hdfs", "s3", "gs")


def opened(root: str) -> bool:
    return (root.split(":", 1)[0] if "://" in root or root.startswith("file:") else "") in OPENED


def _filesystem(root: str):
    if "://" in root or root.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(root)
    return pyarrow.fs.LocalFileSystem(), root


@dataclass
class Folders(InputPartition):
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, root: str, folders: int):
        self.root, self.folders = root, folders

    def partitions(self) -> list[Folders]:
        """The folders' names, so many a task; the driver sees names alone."""
        fs, base = _filesystem(self.root)
        found = fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/raw", allow_not_found=True))
        names = sorted(f.base_name for f in found if f.type == pyarrow.fs.FileType.Directory)
        return [Folders(names[k : k + self.folders]) for k in range(0, len(names), self.folders)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(self.root)

        def text(path: str) -> str | None:
            try:
                with fs.open_input_stream(path) as f:
                    return f.read().decode("utf-8", "replace")
            except FileNotFoundError:
                return None

        rows, size = [], 0
        for name in partition.names:
            article = text(f"{base}/raw/{name}/article.md")
            if article is None:
                continue
            rows.append((name, article, text(f"{base}/raw/{name}/source.json")))
            size += len(article) + len(rows[-1][2] or "")
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["article_key", "content", "sidecar"])


class ArticleFolders(DataSource):
    """``raw/*/article.md`` and ``source.json`` under ``path``; option ``folders`` says how many folders a task reads."""

    @classmethod
    def name(cls) -> str:
        return "article_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].rstrip("/"), int(self.options.get("folders", FOLDERS)))


def read_folders(spark: SparkSession, root: str, folders: int = FOLDERS) -> DataFrame:
    """(article_key, content, sidecar) of every folder with an article; the sidecar's text is null without one, a missing root gives no rows."""
    spark.dataSource.register(ArticleFolders)
    return spark.read.format("article_folders").option("folders", folders).load(root)
