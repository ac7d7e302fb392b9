"""A crawl's settings: typed, with defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F


# The defaults.
@dataclass(frozen=True)
class Logic:
    delay_seconds: float = 0.35
    lock_ttl_seconds: int = 120
    recrawl_seconds: int = 86_400
    max_retries: int = 5
    retry_backoff_base_seconds: int = 30
    retry_backoff_max_seconds: int = 3600
    timeout_seconds: float = 25.0
    progress_log_seconds: int = 60


@dataclass(frozen=True)
class Source:
    kind: str = "news"
    enabled: bool = True
    min_words: int = 900
    listing_pages_from: int = 1
    listing_pages_to: int = 60
    seed_categories: tuple[str, ...] = ()
    max_depth: int = 4
    discovery_max_pages: int = 20_000


@dataclass(frozen=True)
class Config:
    logic: Logic = Logic()
    sources: dict[str, Source] = field(default_factory=dict)

    def enabled(self) -> list[str]:
        return [name for name, source in self.sources.items() if source.enabled]

    def sites(self) -> dict[str, tuple[str, int]]:
        """Kind of page and least number of words of each enabled source, as ``web.fetched_documents`` takes them."""
        return {name: (self.sources[name].kind, self.sources[name].min_words) for name in self.enabled()}


def _typed(kind: type, given: dict):
    """A ``kind`` from what is given, each value in its default's type; other keys are ignored."""
    default = kind()
    values = {f.name: getattr(default, f.name) for f in fields(kind)}
    return kind(**{name: type(value)(given[name]) if given.get(name) is not None else value for name, value in values.items()})


def config_from(given: dict | str) -> Config:
    """A ``Config`` from a dictionary, JSON text, or YAML text where a YAML reader is installed."""
    if isinstance(given, str):
        try:
            given = json.loads(given or "null")
        except ValueError:
            import yaml

            given = yaml.safe_load(given)
    given = given or {}
    sources = {name: _typed(Source, values or {}) for name, values in (given.get("sources") or {}).items()}
    return Config(_typed(Logic, given.get("logic") or {}), sources)


def typed_source(given: Column) -> Column:
    """The struct of a ``Source`` from its JSON text in a column: each value in its default's type, the default where there is none."""
    default = Source()
    names = [f.name for f in fields(Source) if not isinstance(getattr(default, f.name), tuple)]
    read = F.from_json(F.coalesce(given, F.lit("{}")), ", ".join(f"{n} string" for n in names))
    kinds = {bool: "boolean", int: "int", str: "string", float: "double"}
    own = lambda n: F.coalesce(read[n].try_cast(kinds[type(getattr(default, n))]), F.lit(getattr(default, n)))
    return F.struct(*[own(n).alias(n) for n in names])
