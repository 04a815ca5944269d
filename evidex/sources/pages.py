"""A Python data source of saved answer pages: one partition per file, retried, errors as rows."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from glob import glob

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PageSource(DataSource):
    """``spark.read.format("evidex_pages").option("items", "results").load(glob)``: (path, item, error).

    Each file is a JSON object with a list of items; an item is given as JSON text. A file that
    cannot be read after ``retries`` attempts gives one row with the error and no item, so that one
    bad file does not fail the others.
    """

    @classmethod
    def name(cls) -> str:
        return "evidex_pages"

    def schema(self) -> str:
        return "path string, item string, error string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(glob(options["path"]))
        self.field = options.get("items", "results")
        self.retries, self.wait = int(options.get("retries", "3")), float(options.get("wait", "0.1"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for attempt in range(self.retries):
            try:
                with open(partition.value, encoding="utf-8") as file:
                    items = json.load(file).get(self.field, [])
                break
            except (OSError, ValueError) as e:
                if attempt + 1 == self.retries:
                    yield partition.value, None, f"{type(e).__name__}: {e}"
                    return
                time.sleep(self.wait)
        for item in items:
            yield partition.value, json.dumps(item), None
