"""Records of a remote hub as a Python data source: spark.read.format("hub_records")."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.sources.records import RECORD


class File(InputPartition):
    def __init__(self, name: str):
        self.name = name


class HubReader(DataSourceReader):
    """One partition a file; a file is streamed, not stored."""

    def __init__(self, repository: str, files: list[str]):
        self.repository, self.files = repository, files

    def partitions(self) -> list[File]:
        return [File(f) for f in self.files]

    def read(self, partition: File) -> Iterator[tuple]:
        try:
            from datasets import load_dataset
        except ImportError as e:
            raise RuntimeError("hub_records needs the datasets package and a network") from e
        for row in load_dataset(self.repository, data_files=partition.name, split="train", streaming=True):
            yield row["id"], row["text"], {k: v if isinstance(v, str) else json.dumps(v) for k, v in (row.get("metadata") or {}).items()}


class HubRecords(DataSource):
    """Options: repository, and files (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "hub_records"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> HubReader:
        files = [f.strip() for f in self.options.get("files", "").split(",") if f.strip()]
        if "repository" not in self.options or not files:
            raise ValueError("hub_records needs the options repository and files")
        return HubReader(self.options["repository"], files)
