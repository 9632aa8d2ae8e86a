"""A paged record source: every page of JSON files is a partition, read only where it is scanned."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_COLUMNS = ["code", "product_name", "brands", "quantity"]


class PagedRecords(DataSource):
    """``spark.read.format("paged_records").option("path", folder).option("pages", n)``: page k is ``folder/page-k.json`` with a
    list of objects; a missing or broken page gives no rows, as a source that fails softly."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in _COLUMNS)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.first, self.pages = options["path"], int(options.get("start", "1")), int(options.get("pages", "1"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.first, self.first + self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            with open(os.path.join(self.path, f"page-{partition.value}.json"), encoding="utf-8") as file:
                rows = json.load(file)
        except (OSError, ValueError):
            return
        for row in rows if isinstance(rows, list) else []:
            if isinstance(row, dict):
                yield tuple(None if row.get(c) is None else str(row[c]) for c in _COLUMNS)
