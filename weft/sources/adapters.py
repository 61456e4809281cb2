"""Adapters: sources of a project's own, registered by name as Python data sources (L01), and inventories as table functions.

An adapter says how its rows are split, what a part reads and which columns can be looked up early; Spark plans the parts as
partitions and hands equality and IN filters down. Its shape is checked when it is registered.
"""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

ADAPTER_NAME = re.compile(r"[a-z][a-z0-9_]{0,63}")


@dataclass(frozen=True)
class Adapter:
    """name, schema (DDL); ``parts(options)`` lists what is read apart, ``read(part, options, wanted)`` gives the rows of one part.

    ``wanted`` maps a column of ``keys`` to the values that a query asks for; a reader may use it to read less, and rows that
    don't meet it are dropped.
    """

    name: str
    schema: str
    parts: Callable[[dict], list]
    read: Callable[[object, dict, dict], Iterable[tuple]]
    keys: tuple[str, ...] = ()


class _Part(InputPartition):
    def __init__(self, value: object):
        self.value = value


def check_adapter(adapter: Adapter) -> list[str]:
    """What is wrong with an adapter's shape; nothing where it can be registered."""
    wrong = []
    if not isinstance(adapter.name, str) or not ADAPTER_NAME.fullmatch(adapter.name):
        wrong.append("name: lower-case letters, digits and underscores, a letter first")
    wrong += [f"{x}: must be callable" for x in ("parts", "read") if not callable(getattr(adapter, x))]
    try:
        columns = StructType.fromDDL(adapter.schema).names
        wrong += [f"keys: no column {k}" for k in adapter.keys if k not in columns]
    except Exception as error:  # whatever the parser of schemas refuses
        wrong.append(f"schema: {type(error).__name__}")
    return wrong


def register_adapter(spark: SparkSession, adapter: Adapter) -> None:
    """Makes ``spark.read.format(adapter.name)`` read through the adapter; a wrong shape raises a ValueError that names every fault."""
    wrong = check_adapter(adapter)
    if wrong:
        raise ValueError(f"adapter {adapter.name!r}: " + "; ".join(wrong))
    columns = StructType.fromDDL(adapter.schema).names

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options, self.wanted = dict(options), {}

        def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
            for f in filters:
                if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in adapter.keys:
                    values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    key = f.attribute[0]
                    self.wanted[key] = self.wanted[key] & values if key in self.wanted else values
                else:
                    yield f

        def partitions(self) -> list[InputPartition]:
            return [_Part(x) for x in adapter.parts(self.options)]

        def read(self, partition: _Part) -> Iterator[tuple]:
            at = {k: columns.index(k) for k in self.wanted}
            for row in adapter.read(partition.value, self.options, self.wanted):
                if all(row[at[k]] in values for k, values in self.wanted.items()):
                    yield tuple(row)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return adapter.name

        def schema(self) -> str:
            return adapter.schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(self.options)

    spark.dataSource.register(Source)


METHODS = ("get", "put", "post", "delete", "patch", "head", "options")


class Inventory:
    """Table function: kind, setting, file, text to the rows (id, label) of one file. An unknown kind, and what can't be read, gives none."""

    def eval(self, kind: str, setting: str, file: str, text: str) -> Iterator[tuple[str, str]]:
        reader = getattr(self, "_" + (kind or "").replace("-", "_"), None)
        yield from reader(setting or "", file or "", text or "") if reader else ()

    def _glob(self, setting: str, file: str, text: str) -> Iterator[tuple[str, str]]:
        """A file that the pattern matches, labelled by its first heading."""
        if fnmatch.fnmatchcase(file, setting):
            heading = re.search(r"(?m)^#[ \t]+(\S.*)$", text)
            yield file, heading[1].strip() if heading else None

    def _openapi(self, setting: str, file: str, text: str) -> Iterator[tuple[str, str]]:
        """Operations of an OpenAPI document, labelled by their summary."""
        for path, operations in (_object(_object(text).get("paths"))).items():
            for method, operation in _object(operations).items():
                if method in METHODS:
                    yield f"{method.upper()} {path}", _object(operation).get("summary")

    def _i18n_registry(self, setting: str, file: str, text: str) -> Iterator[tuple[str, str]]:
        """Keys below ``setting`` in a file of messages, labelled by their text or by the text under ``label`` or ``title``."""
        found: object = _object(text)
        for key in filter(None, setting.split(".")):
            found = _object(found).get(key)
        for key, value in _object(found).items():
            label = value if isinstance(value, str) else _object(value).get("label") or _object(value).get("title")
            yield key, label if isinstance(label, str) else None

    def _next_app_router(self, setting: str, file: str, text: str) -> Iterator[tuple[str, str]]:
        """The route of a page file; groups and slots are no part of it."""
        found = re.search(r"(?:^|/)app/(.*?)/?page\.(?:tsx|jsx|ts|js|mdx)$", file) or re.search(r"(?:^|/)app/()page\.(?:tsx|jsx|ts|js|mdx)$", file)
        if found:
            yield "/" + "/".join(x for x in found[1].split("/") if x and x[0] not in "(@"), None


def _object(value: object) -> dict:
    """A JSON object, from its text too; empty for anything else."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return {}
    return value if isinstance(value, dict) else {}


def inventories(settings: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, id, label: every inventory's rows, by a lateral join of the table function.

    ``settings``: name, kind, setting, suffix (files that end in it belong to the inventory); ``files``: file, text; ``aliases``: id, label. An alias
    names a row before its own label does; without both the id names it.
    """
    from weft.operators.joins import met_by_start
    from weft.operators.tables import unsent

    spark = settings.sparkSession
    spark.udtf.register("weft_inventory", F.udtf(Inventory, returnType="id string, label string"))
    # Endings of files meet by equality, as beginnings of the names written backwards.
    ends = settings.select("name", "kind", "setting", F.reverse("suffix").alias("back"))
    met = met_by_start(files.select(F.reverse("file").alias("turned")), ends, "turned", "back").select(F.reverse("turned").alias("file"), "name", "kind", "setting")
    rows = met.join(unsent(files), "file")
    listed = spark.sql("SELECT r.name, t.id, t.label FROM {rows} r, LATERAL weft_inventory(r.kind, r.setting, r.file, r.text) t", rows=rows)
    named = aliases.groupBy("id").agg(F.min("label").alias("alias"))
    return listed.join(named, "id", "left").select("name", "id", F.coalesce("alias", F.nullif("label", F.lit("")), "id").alias("label")).distinct()
