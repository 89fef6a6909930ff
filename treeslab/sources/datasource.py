"""The format ``treeslab``: objects of JSON documents as rows, read by workers file by file.

    spark.dataSource.register(DocumentSource)
    spark.read.format("treeslab").option("path", folder).load().where("collection = 'datasets'")

With spark.sql.python.filterPushdown.enabled, equality filters on collection and uuid are taken over, so other objects are never turned into rows. Files are found and
read as local files; for other stores use ``documents.read``.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file_id string, collection string, uuid string, body string"


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "treeslab"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(self.options["path"])


class DocumentReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for x in filters:
            if isinstance(x, EqualTo) and x.attribute in (("collection",), ("uuid",)):
                self.wanted[x.attribute[0]] = x.value
            else:
                yield x

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, "*.json"))) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(x) for x in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8") as source:
            document = json.load(source)
        name = os.path.basename(partition.value).removesuffix(".json")
        for collection in ("groups", "datasets", "datatypes"):
            if self.wanted.get("collection", collection) == collection:
                for uuid, body in document.get(collection, {}).items():
                    if self.wanted.get("uuid", uuid) == uuid:
                        yield name, collection, uuid, json.dumps(body, sort_keys=True)
