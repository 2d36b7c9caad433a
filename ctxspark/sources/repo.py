"""A Python data source `repo`: a local tree of source files, listed without entering pruned folders, read in partitions."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .extract import PRUNED, language


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, root: str, files_per_task: int):
        self.root, self.per = root, files_per_task

    def partitions(self) -> list[_Part]:
        found = []
        skip = set(PRUNED) | self._ignored()
        for top, folders, names in os.walk(self.root):
            folders[:] = sorted(d for d in folders if d not in skip)
            found += [os.path.join(top, n) for n in sorted(names)]
        return [_Part(found[i : i + self.per]) for i in range(0, len(found), self.per)] or [_Part([])]

    def _ignored(self) -> set[str]:
        """Plain folder names of the tree's .gitignore."""
        try:
            with open(os.path.join(self.root, ".gitignore"), encoding="utf-8") as f:
                names = {line.strip().strip("/") for line in f if line.strip() and line.strip()[0] not in "#!"}
        except OSError:
            return set()
        return {n for n in names if n and not set(n) & set("/*?[")}

    def read(self, partition: _Part) -> Iterator[tuple]:
        for p in partition.paths:
            try:
                s = os.stat(p)
                with open(p, encoding="utf-8", errors="replace") as f:
                    yield os.path.relpath(p, self.root), language(p), s.st_size, s.st_mtime_ns, f.read()
            except OSError:
                continue


class RepoDataSource(DataSource):
    """spark.dataSource.register(RepoDataSource); spark.read.format("repo").load(root)"""

    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return "rel string, lang string, bytes long, mtime_ns long, content string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("filespertask", "200")))
