"""Any collection as a Spark source: who knows how to list its parts, how to load one and what its records mean registers that, and reads it with spark.read.format."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

Options = dict[str, str]
#: Rows of scores, as converters of nested items give them.
SCORES = "item_id string, system string, metric string, value double"


def item_source(name: str, schema: str, parts: Callable[[Options], list[str]], load: Callable[[str, Options], Iterator[dict]], convert: Callable[[dict], Iterator[tuple]] | None = None) -> type[DataSource]:
    """A data source called name. parts lists what can be loaded side by side (driver), load yields the records of one part and convert the rows of a record (executors).

    Without convert, records are dicts of the schema's columns. Options of the read reach parts and load.
    """

    class Part(InputPartition):
        def __init__(self, value: str) -> None:
            super().__init__(value)

    class Reader(DataSourceReader):
        def __init__(self, options: Options, wanted: StructType) -> None:
            self.options, self.names = options, wanted.fieldNames()

        def partitions(self) -> list[InputPartition]:
            return [Part(x) for x in parts(self.options)] or [Part("")]  # a read without parts has no rows

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            if partition.value == "":
                return
            for record in load(partition.value, self.options):
                if convert is None:
                    yield tuple(record.get(x) for x in self.names)
                else:
                    yield from convert(record)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(dict(self.options), schema)

    return Source


def files_below(options: Options) -> list[str]:
    """The data files of the folder in the option path, in any store that Arrow can open; an option suffix chooses among them."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(options["path"])
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(options.get("suffix", "")) and not f.base_name.startswith(("_", ".")))


def json_lines(path: str, options: Options) -> Iterator[dict]:
    """The records of one file of JSON lines, read as a stream."""
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(options["path"])
    rest = b""
    with store.open_input_stream(path) as stream:
        while block := stream.read(1 << 20):
            *lines, rest = (rest + block).split(b"\n")
            yield from (json.loads(x) for x in lines if x.strip())
    if rest.strip():
        yield json.loads(rest)


def score_rows(item: dict) -> Iterator[tuple]:
    """item_id, system, metric, value of a nested item."""
    for system, metrics in (item.get("scores") or {}).items():
        for metric, value in (metrics or {}).items():
            yield item.get("i"), system, metric, None if value is None else float(value)


def register_json_items(spark: SparkSession, name: str = "siftwell_items") -> None:
    """spark.read.format(name).option("path", folder): the scores of nested items in JSON lines, one task for each file."""
    spark.dataSource.register(item_source(name, SCORES, files_below, json_lines, score_rows))
