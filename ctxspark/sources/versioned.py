"""A table in versions as a data source and sink, `versioned`: what a job writes is seen all at once or never.

Tasks write files that no version names. When all have succeeded, the driver commits: it writes the next version, a list of
files, under a name that must not be there yet, so of two writers one fails instead of losing the other's rows. A job that fails is
aborted: its files go, and the last version stays what it was. Folders must be seen by the driver and all executors.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema


def versions(path: str) -> list[int]:
    folder = f"{path}/versions"
    return sorted(int(n[:-5]) for n in os.listdir(folder) if n.endswith(".json")) if os.path.isdir(folder) else []


def version(path: str, number: int | None = None) -> dict:
    """The files, schema and rows of a version, of the last one if none is named; no files if there is none."""
    known = versions(path)
    if not known and number is None:
        return {"number": 0, "files": [], "schema": None, "rows": 0}
    with open(f"{path}/versions/{known[-1] if number is None else number}.json", encoding="utf-8") as f:
        return json.load(f)


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, keep: int):
        self.path, self.schema, self.overwrite, self.keep = path, schema, overwrite, keep
        self.job, self.base = uuid.uuid4().hex, version(path)["number"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """One file of a task; another attempt of the task writes another one."""
        name, rows, out = f"data/{self.job}/{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if out is None:
                    os.makedirs(os.path.dirname(f"{self.path}/{name}"), exist_ok=True)
                    out = pq.ParquetWriter(f"{self.path}/{name}", batch.schema, compression="zstd")
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return _Written(name if out is not None else None, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        mine = [m for m in messages if m is not None and m.file]
        before = version(self.path, self.base or None)
        if not self.overwrite and before["schema"] and json.loads(before["schema"]) != self.schema.jsonValue():
            self.abort(messages)
            raise ValueError("appended rows have another schema than the table")
        files = [] if self.overwrite else before["files"]
        new = {"number": self.base + 1, "files": files + [m.file for m in mine], "schema": self.schema.json(), "rows": (0 if self.overwrite else before["rows"]) + sum(m.rows for m in mine)}
        os.makedirs(f"{self.path}/versions", exist_ok=True)
        draft = f"{self.path}/versions/.{self.job}"
        with open(draft, "w", encoding="utf-8") as f:
            json.dump(new, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, f"{self.path}/versions/{new['number']}.json")  # fails if another writer was first
        except FileExistsError:
            self.abort(messages)
            raise RuntimeError(f"version {new['number']} was written by another job") from None
        finally:
            os.unlink(draft)
        self._forget(self.job, {m.file for m in mine})
        if self.keep:
            self._prune()

    def abort(self, messages: list[_Written | None]) -> None:
        self._forget(self.job, set())

    def _forget(self, job: str, but: set[str]) -> None:
        """Deletes a job's files that aren't committed: those of failed or repeated attempts."""
        folder = f"{self.path}/data/{job}"
        for name in os.listdir(folder) if os.path.isdir(folder) else []:
            if f"data/{job}/{name}" not in but:
                os.unlink(f"{folder}/{name}")

    def _prune(self) -> None:
        """Deletes versions but the last `keep`, and the files that only those had."""
        known = versions(self.path)
        old, used = known[: -self.keep], {f for n in known[-self.keep :] for f in version(self.path, n)["files"]}
        for n in old:
            for f in set(version(self.path, n)["files"]) - used:
                if os.path.exists(f"{self.path}/{f}"):
                    os.unlink(f"{self.path}/{f}")
            os.unlink(f"{self.path}/versions/{n}.json")


class _Part(InputPartition):
    def __init__(self, file: str | None):
        self.file = file


class _Reader(DataSourceReader):
    def __init__(self, path: str, number: int | None, schema: T.StructType):
        self.path, self.schema = path, schema
        self.files = version(path, number)["files"]

    def partitions(self) -> list[_Part]:
        return [_Part(f) for f in self.files] or [_Part(None)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if part.file is not None:
            yield from pq.ParquetFile(f"{self.path}/{part.file}").iter_batches()
        else:
            yield pa.RecordBatch.from_pylist([], to_arrow_schema(self.schema))


class VersionedDataSource(DataSource):
    """spark.dataSource.register(VersionedDataSource); df.write.format("versioned").mode("append").save(path), and
    spark.read.format("versioned").option("version", n).load(path); option keep: how many versions stay (all)."""

    @classmethod
    def name(cls) -> str:
        return "versioned"

    def schema(self) -> T.StructType:
        found = version(self.options["path"], self._number())["schema"]
        if found is None:
            raise ValueError(f"{self.options['path']} has no version yet")
        return T.StructType.fromJson(json.loads(found))

    def _number(self) -> int | None:
        return int(self.options["version"]) if "version" in self.options else None

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self._number(), schema)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite, int(self.options.get("keep", "0")))
