"""The default dataset and the registry of datasets for cross-dataset queries."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.sources.scene import DatasetConfig

_current: list[DatasetConfig | None] = [None]


def choose(config: DatasetConfig | None) -> DatasetConfig | None:
    """Sets the default dataset; returns the former one."""
    before, _current[0] = _current[0], config
    return before


def current() -> DatasetConfig:
    if _current[0] is None:
        raise ValueError("no dataset is chosen")
    return _current[0]


@contextmanager
def using(config: DatasetConfig):
    """The default dataset inside a with block; the former one comes back after errors too."""
    before = choose(config)
    try:
        yield config
    finally:
        choose(before)


@dataclass(frozen=True)
class Adapter:
    """What a dataset offers: metadata and ids of a query, partners of ids."""

    name: str
    metadata: Callable[..., DataFrame]
    ids: Callable[..., DataFrame]
    partners: Callable[..., DataFrame]
    shortname: str = ""
    species: str = ""
    sex: str = ""
    age: str = ""
    description: str = ""


_adapters: dict[str, Adapter] = {}


def register(adapter: Adapter) -> None:
    _adapters[adapter.name] = adapter


def require_package(name: str, show_error: bool = True) -> bool:
    """Whether a package is there; an error naming it where it is not and show_error is set."""
    there = importlib.util.find_spec(name) is not None
    if not there and show_error:
        raise ImportError(f"package {name} is needed")
    return there


def query(**queries: str) -> DataFrame:
    """Metadata of several datasets, e.g. query(left="class:A.*", right="type:B"), in one table with a dataset column; missing columns are null."""
    out = None
    for name, text in queries.items():
        if name not in _adapters:
            raise KeyError(f"dataset {name} is not registered")
        rows = _adapters[name].metadata(text).withColumn("dataset", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no dataset asked for")
    return out


def partners_of(name: str, ids, **options) -> DataFrame:
    return _adapters[name].partners(ids, **options)
