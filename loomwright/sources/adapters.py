"""Sources by the name of their adapter, and models by name and time."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from loomwright.sources import shops
from loomwright.sources.tables import newest_model

Search = Callable[[DataFrame], DataFrame]
_SEARCHES: dict[str, Search] = {}


def register(name: str, search: Search) -> None:
    """A function from pages (url, html) to results (page, place, url, ...) under a name."""
    _SEARCHES[name.lower()] = search


def adapter(name: str) -> Search | None:
    """The first registered source, by name, whose name starts with the adapter's."""
    key = name.strip().lower()
    return next((_SEARCHES[n] for n in sorted(_SEARCHES) if key and n.startswith(key)), None)


def search_all(pages: dict[str, DataFrame], names: Iterable[str]) -> dict[str, DataFrame]:
    """Results by adapter; names without a source or pages are left out."""
    return {n: adapter(n)(pages[n]) for n in names if n in pages and adapter(n)}


register("asos", shops.router_search)
register("soliver", shops.tile_search)
register("zalando", shops.cache_search)


def save_model(model: object, folder: str, name: str) -> str:
    """Saves a Spark ML model under a new name; load_newest finds the last one."""
    path = f"{folder.rstrip('/')}/{name}-{time.time_ns()}"
    model.write().overwrite().save(path)
    return path


def load_newest(spark: SparkSession, folder: str, name: str, reader: Callable[[str], object]) -> object | None:
    path = newest_model(spark, folder, name)
    return None if path is None else reader(path)
