"""A data source for dictionary dumps: JSON Lines pages as (title, wikitext).

    spark.dataSource.register(DumpSource)
    spark.read.format("wikitext_dump").load("/path/to/*.jsonl")
"""

from __future__ import annotations

import glob
import json

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class DumpSource(DataSource):
    @classmethod
    def name(cls):
        return "wikitext_dump"

    def schema(self):
        return "title string, wikitext string"

    def reader(self, schema):
        return DumpReader(self.options["path"])


class DumpReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition):
        with open(partition.value, encoding="utf-8") as f:
            for line in f:
                page = json.loads(line)
                yield page.get("title"), page.get("wikitext", "")
