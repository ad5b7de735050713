"""Configuration of the pipeline: one validated dataclass a step, from YAML mappings."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any, TypeVar

C = TypeVar("C")


def build(kind: type[C], values: dict[str, Any]) -> C:
    """A dataclass from a mapping; unknown keys fail."""
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"{kind.__name__} has no {sorted(unknown)}; it has {sorted(known)}")
    return kind(**values)


def load(kind: type[C], path: str) -> C:
    import yaml

    with open(path, encoding="utf-8") as file:
        return build(kind, yaml.safe_load(file) or {})


@dataclass(frozen=True)
class Panel:
    entity: str = "entity"
    month: str = "month"
    category: str = "category"
    value: str = "value"
    month_kind: str = "date"
    format: str = "long"
    wide_categories: tuple[str, ...] = ()
    total_category: str | None = None
    exclude_categories: tuple[str, ...] = ()
    min_month_coverage: float = 1.0
    max_interp_gap: int = 2
    static_columns: tuple[str, ...] = ()
    static_log: bool = True
    standardize: str = "per_month"

    def __post_init__(self):
        if self.format not in ("long", "wide"):
            raise ValueError("format must be long or wide")
        if self.format == "wide" and not self.wide_categories:
            raise ValueError("wide_categories is empty")


@dataclass(frozen=True)
class Network:
    k: int = 10
    k_alt: int = 20
    rules: tuple[str, ...] = ("cosine", "corr", "lag")
    window: int = 12
    max_lag: int = 2
    geo_type: str = "highway"

    def __post_init__(self):
        if unknown := set(self.rules) - {"cosine", "corr", "geo", "lag"}:
            raise ValueError(f"unknown rules {sorted(unknown)}")


@dataclass(frozen=True)
class Dynamics:
    n_clusters: int = 6
    alpha: float = 0.5
    event_share: float = 0.3
    seed: int = 42
    methods: tuple[str, ...] = ("kmeans", "louvain", "spectral", "ward_net")
    subsample_share: float = 0.8
    subsample_repeats: int = 20


@dataclass(frozen=True)
class Pipeline:
    facts: str = ""
    static: str | None = None
    connection: str | None = None
    out: str = ""
    panel: Panel = field(default_factory=Panel)
    network: Network = field(default_factory=Network)
    dynamics: Dynamics = field(default_factory=Dynamics)

    def __post_init__(self):
        if "geo" in self.network.rules and not self.connection:
            raise ValueError("the geo rule needs a table of distances in connection")

    @staticmethod
    def of(values: dict[str, Any]) -> Pipeline:
        parts = {"panel": Panel, "network": Network, "dynamics": Dynamics}
        return build(Pipeline, {k: build(parts[k], v) if k in parts else v for k, v in values.items()})
